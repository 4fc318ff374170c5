"""Names with and without an environment's prefix, and name resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshset.errors import NodeNotFound
from meshset.model import Snapshot


def prefixed(env: str, node: str) -> str:
    """``env#node``, or whichever of them is not empty."""
    return f"{env}#{node}" if env and node else env or node


def prefix(env: Column, node: Column) -> Column:
    return F.when((env != "") & (node != ""), F.concat(env, F.lit("#"), node)).when(env != "", env).otherwise(node)


def unprefix(value: Column, env: str) -> Column:
    """Without ``env#`` at its start; never split at '#', which names may hold."""
    if not env:
        return value
    return F.when(F.startswith(value, F.lit(env + "#")), F.substr(value, F.lit(len(env) + 2))).otherwise(value)


def resolve(names: DataFrame, snap: Snapshot, env: str, strict: bool = True, unknown: list[DataFrame] | None = None) -> DataFrame:
    """Add ``node``: ``env#value`` where that node exists, else the value itself; strict: unknown nodes raise.

    They raise at once, or, where ``unknown`` is given, their rows are added to it
    for ``refuse`` to look at, so that an expression's names are checked together.
    Not strict: rows of unknown nodes go.
    """
    own = snap.nodes.select(F.col("name").alias("__own"))
    out = names
    if env:
        full = F.when(F.startswith(F.col("value"), F.lit(env + "#")), F.col("value")).otherwise(F.concat(F.lit(env + "#"), F.col("value")))
        out = out.join(own, full == F.col("__own"), "left").withColumn("node", F.coalesce("__own", "value")).drop("__own")
    else:
        out = out.withColumn("node", F.col("value"))
    if not strict:
        return out.join(own, F.col("node") == F.col("__own"), "left_semi")
    missing = out.join(own, F.col("node") == F.col("__own"), "left_anti").select("value")
    if unknown is None:
        refuse([missing])
    else:
        unknown.append(missing)
    return out


def refuse(unknown: list[DataFrame]) -> None:
    """Raise if there is any row; one job for all."""
    if unknown and (rows := reduce(DataFrame.union, unknown).limit(5).collect()):
        raise NodeNotFound(", ".join(r[0] for r in rows))
