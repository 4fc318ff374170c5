"""Multiset operators on one-column bags (``value``); m and n are a value's counts on both sides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.errors import InvalidRangeExpression


def union(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """max(m, n) of each; ``distinct``: both sides are known to be free of duplicates."""
    if distinct:
        return a.union(b).distinct()
    both = a.select("value", F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select("value", F.lit(0), F.lit(1)))
    sums = both.groupBy("value").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return repeated(sums.select("value", F.greatest("l", "r").alias("times")))


#: Copies of a value that one row of ``repeated`` stands for.
COPIES = 10_000


def repeated(rows: DataFrame) -> DataFrame:
    """``value`` as often as ``times`` says; a value with very many copies is dealt in portions over all tasks."""
    portions = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("times") / COPIES).cast("long") - 1)
    few = rows.where(F.col("times") <= COPIES).select("value", F.col("times").cast("long").alias("n"))
    many = rows.where(F.col("times") > COPIES).select("value", "times", F.explode(portions).alias("k")).repartition("value", "k")
    many = many.select("value", F.least(F.lit(COPIES), F.col("times") - F.col("k") * COPIES).cast("long").alias("n"))
    return few.where("n > 0").unionByName(many).select(F.explode(F.expr("array_repeat(value, cast(n as int))")).alias("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """max(m - n, 0) of each."""
    return a.exceptAll(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """min(m, n) of each."""
    return a.intersectAll(b)


#: POSIX classes and what Java calls them (fixed values).
CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
}


def pattern(regex: str) -> str:
    """A Perl-style pattern in Java's dialect."""
    return re.sub(r"\[:(\w+):\]", lambda m: CLASSES.get(m[1], m[0]), regex)


def matching(a: DataFrame, regex: str, keep: bool = True) -> DataFrame:
    """Values in which the pattern occurs anywhere (or doesn't), duplicates included."""
    p = pattern(regex)
    try:
        a.sparkSession._jvm.java.util.regex.Pattern.compile(p)
    except Exception as e:
        raise InvalidRangeExpression(regex) from e
    hit = F.col("value").rlike(p)
    return a.where(hit if keep else ~hit)
