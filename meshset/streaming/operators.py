"""Structured Streaming: folding a request log into a store, and learning what a quorum accepted."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meshset.errors import CorruptLog
from meshset.model import CHANGELOG
from meshset.sources.store import Request, Store, corrupt


def read_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The log's folder as a stream."""
    return spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fold(log: DataFrame, into: Store, checkpoint: str, source: str = "log", rows: int = 10_000):
    """Apply a stream of requests in the order of their versions; start the query and return it.

    Each request keeps its time and client, and is known in the target by
    ``source`` and its version there; refused ones are remembered.  So whatever the
    target held before, a batch that comes again is skipped up to the last request
    that was applied or refused.  A request whose checksum is wrong stops the query, and
    so does one that comes after later ones, for it can't be applied in order any more.
    """

    def batch(df: DataFrame, _: int) -> None:
        known = into.log().select("source", "request_id").union(into.refused().select("source", "request_id")).where(F.col("source") == source)
        done = known.agg(F.max("request_id")).first()[0] or 0
        late = df.where(F.col("version") <= done).join(known.withColumnRenamed("request_id", "version"), "version", "left_anti")
        if missed := [r.version for r in late.select("version").limit(5).collect()]:
            raise CorruptLog(f"versions {missed} of {source} come after {done}")
        todo = df.where(F.col("version") > done)
        if bad := [r.version for r in corrupt(todo).select("version").limit(5).collect()]:
            raise CorruptLog(f"versions {bad} of {source}")
        part: list[Request] = []
        for r in todo.orderBy("version").toLocalIterator():
            part.append(Request(r.method, tuple(r.args), r.ts, r.client_id, r.version))
            if len(part) == rows:
                into.apply(part, source=source)
                part = []
        into.apply(part, source=source)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quorum(accepters: int, share: float = 0.6) -> int:
    return math.ceil(accepters * share)


def learned(votes: DataFrame, accepters: int, late: str | None = None) -> DataFrame:
    """(proposal, votes) of the proposals that a quorum accepted; an accepter that votes again counts once.

    ``votes`` has proposal and accepter.  On a stream, ``late`` is how long after
    its last vote a proposal may still get one (votes then have ``ts``): each
    proposal has a state of its own with the accepters it was voted for by, is
    given out once, when it has a quorum, and forgotten that long after its last vote.
    """
    if not late:
        counts = votes.groupBy("proposal").agg(F.count_distinct("accepter").alias("votes"))
        return counts.where(F.col("votes") >= quorum(accepters))
    needed = quorum(accepters)
    kind = votes.schema["proposal"].dataType.simpleString()
    span = votes.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {late}"))).alias("ms")).first().ms

    def count(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seen, told, last = state.get if state.exists else ([], False, 0)
        have = set(seen)
        for p in parts:
            have |= set(p["accepter"].astype(str))
            last = max(last, int(p["ms"].max()))
        if len(have) >= needed and not told:
            told = True
            yield pd.DataFrame({"proposal": [key[0]], "votes": [len(have)]})
        state.update((sorted(have), told, last))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))

    grouped = votes.select("proposal", F.col("accepter").cast("string").alias("accepter"), F.unix_millis("ts").alias("ms"), "ts").withWatermark("ts", late).groupBy("proposal")
    return grouped.applyInPandasWithState(count, f"proposal {kind}, votes long", "accepters array<string>, told boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)
