"""Exact deduplication with a heavy-hitter split (operator 9).

Misra-Gries summaries of the partitions name every digest that may hold more
than a share ``phi`` of all rows; there are at most 2 / phi of them, whatever
the input.  Their exact winners are found by map-side aggregation and broadcast,
so copies of frequent texts leave on the map side and never meet in one task.
All other digests, none with more than that share, take the ordinary shuffle.
The share falls as partitions grow in number, so no digest makes a straggler.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshset.llm.common import materialise, record

PHI = 1 / 1024
SPACE = r"[\x20\x09-\x0D]+"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, digest (SHA-256 of the text without white space, lowercase hex), points (code points of the text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias("digest"), F.length(text).cast("long").alias("points"))


def misra_gries(rows: DataFrame, counters: int) -> DataFrame:
    """Per partition, at most ``counters`` digests with lower bounds of their counts, each short by at most rows / (counters + 1)."""
    schema = "digest string, low long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for x in b.column(0).to_pylist():
                if x in held:
                    held[x] += 1
                elif len(held) < counters:
                    held[x] = 1
                else:
                    held = {k: n - 1 for k, n in held.items() if n > 1}
        yield record({"digest": list(held), "low": list(held.values())}, schema)

    return rows.select("digest").mapInArrow(run, schema)


def heavy_winners(rows: DataFrame, phi: float = PHI) -> DataFrame:
    """Exact (digest, best, size) of all digests with at least a share phi of the rows, and at most 2 / phi rows in all.

    ``rows`` has digest, id, points and a unique uid.  A digest with phi * n rows
    keeps at least half of them in the summaries' sum, and no more than 2 / phi
    digests can have that many, so the collected list has a proven bound.
    """
    n = rows.count()
    low = misra_gries(rows, counters=int(2 / phi)).groupBy("digest").agg(F.sum("low").alias("low"))
    names = [r[0] for r in low.where(F.col("low") >= F.lit(max(2.0, phi * n / 2))).select("digest").collect()]
    spark = rows.sparkSession
    listed = spark.createDataFrame([(x,) for x in names], "digest string")
    return rows.join(F.broadcast(listed), "digest").groupBy("digest").agg(F.min(order(rows)).alias("best"), F.count("*").alias("size"))


def order(rows: DataFrame) -> F.Column:
    """Smallest first: most code points, then smallest id (null last), then any one of repeated rows."""
    return F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))


def share(rows: DataFrame) -> float:
    """From which share of all rows on a digest is heavy: so small that a light one is little beside what a task has anyway."""
    return min(PHI, 0.25 / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space; a null text is empty.
    The row with most code points stays, then the one with the smallest id; a
    null id loses to any other, and of wholly repeated rows exactly one is kept.
    Other columns, whatever their names, are not read.  Empty in, empty out.
    Light digests are added up before they are shuffled, and rows stream past
    their group's one result; no group is held in memory.
    """
    rows = materialise(digests(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "digests")
    heavy = materialise(heavy_winners(rows, phi or share(rows)), "heavy")
    marked = rows.join(F.broadcast(heavy), "digest", "left")  # at most 2 / phi rows
    light = marked.where(F.col("size").isNull()).drop("best", "size")
    groups = light.groupBy("digest").agg(F.min(order(rows)).alias("best"), F.count("*").alias("size"))
    both = marked.where(F.col("size").isNotNull()).unionByName(light.join(groups.hint("merge"), "digest"))
    return both.select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, under the rules of ``exact_groups``.

    Copies of frequent texts are dropped on the map side by the broadcast
    winners; what is left is shuffled once, by digest.  Nulls, empty tables and
    repeated rows are as there.  Columns of ``df`` keep their names even where
    they clash with those used here.
    """
    narrow = materialise(digests(df, id_col, text_col).withColumn("uid", F.lit(0).cast("long")), "digests")
    heavy = heavy_winners(narrow, phi or share(narrow)).select(F.col("digest").alias("h_digest"), F.col("best.points").alias("h_points"), F.col("best.id").alias("h_id"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = df.select(F.struct("*").alias("row"), F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias("digest"), F.length(text).cast("long").alias("points"), F.col(id_col).cast("long").alias("id"))
    near = whole.join(F.broadcast(materialise(heavy, "heavy")), F.col("digest") == F.col("h_digest"), "left")
    wins = (F.col("h_points") == -F.col("points")) & F.col("h_id").eqNullSafe(F.col("id"))
    first = Window.partitionBy("digest").orderBy(F.desc("points"), F.col("id").asc_nulls_last())
    left = near.where(F.col("h_digest").isNull() | wins).withColumn("nth", F.row_number().over(first))  # a group's first is found on the map side, too
    return left.where("nth = 1").select("row.*")
