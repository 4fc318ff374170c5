"""Generators of strings: numeric sequences and brace products."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshset.errors import InvalidRangeExpression

LARGEST = (1 << 32) - 1


def bounds(left: str, right: str) -> tuple[str, int, int, int, str]:
    """(prefix, first, last, digits, suffix) of ``left..right``.

    The right side may repeat the prefix; its digits end at the first letter,
    and what follows is the suffix.  A right number below the left one is added
    to it.  Numbers are padded to the wider side.
    """
    digits = re.search(r"[0-9]*$", left)[0]
    head = left[: len(left) - len(digits)]
    rest = right.removeprefix(head) if head else right
    letter = re.search(r"[A-Za-z]", rest)
    number, suffix = (rest[: letter.start()], rest[letter.start() :]) if letter else (rest, "")
    if not digits or not re.fullmatch(r"[0-9]+", number):
        raise InvalidRangeExpression(f"{left}..{right}")
    first, last = int(digits), int(number)
    if last < first:
        last += first
    if max(first, last) > LARGEST:
        raise InvalidRangeExpression(f"{left}..{right}")
    return head, first, last, max(len(digits), len(number)), suffix


def sequence(spark: SparkSession, left: str, right: str) -> DataFrame:
    """The strings of ``left..right``, made on the executors."""
    head, first, last, width, suffix = bounds(left, right)
    return spark.range(first, last + 1).select(F.concat(F.lit(head), F.format_string(f"%0{width}d", "id"), F.lit(suffix)).alias("value"))


def braces(left: DataFrame | None, centre: DataFrame | None, right: DataFrame | None) -> DataFrame | None:
    """Every concatenation of the parts; None stands for an empty part, which is left out."""
    parts = [p for p in (left, centre, right) if p is not None]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:  # a product is what the operator means; its sides are the user's lists
        out = out.crossJoin(p.select(F.col("value").alias("__next"))).select(F.concat("value", "__next").alias("value"))
    return out
