"""Functions that expressions can call: planners from bags to a bag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.functions.context import Context
from meshset.model import CLUSTER, ENVIRONMENT
from meshset.operators import sets, traverse
from meshset.operators.names import resolve, unprefix


@dataclass(frozen=True)
class RangeFunction:
    """``plan(context, bags)`` gives a bag; a call with another number of arguments gives an empty one."""

    n_args: int
    plan: Callable[[Context, list[DataFrame]], DataFrame]


def _roots(ctx: Context, bag: DataFrame) -> DataFrame:
    known = resolve(bag.distinct(), ctx.snapshot, ctx.env, strict=False)
    return known.select(F.col("value").alias("root"), "node")


def _expand(ctx: Context, bags: list[DataFrame]) -> DataFrame:
    """JSON text of the tree below each node; unknown nodes are skipped."""
    shown = unprefix(F.col("node"), ctx.env)
    tree = traverse.tree_json(_roots(ctx, bags[0]), ctx.snapshot, ctx.dependency.edges, shown)
    return bags[0].join(tree, F.col("value") == F.col("root")).select(F.col("json").alias("value"))


def _expand_hosts(ctx: Context, bags: list[DataFrame]) -> DataFrame:
    """Hosts below each node, once for each path to them."""
    found = bags[0].join(traverse.hosts_by_paths(_roots(ctx, bags[0]), ctx.snapshot), F.col("value") == F.col("root"))
    return sets.repeated(found.select(F.col("node").alias("value"), "times"))


def _clusters(ctx: Context, bags: list[DataFrame]) -> DataFrame:
    """Direct parents of each node."""
    known = resolve(bags[0], ctx.snapshot, ctx.env, strict=False)
    return known.join(ctx.snapshot.edges, F.col("node") == F.col("dst")).select(unprefix(F.col("src"), ctx.env).alias("value"))


def _all_clusters(ctx: Context, bags: list[DataFrame]) -> DataFrame:
    """``env#cluster`` for the clusters of every environment."""
    roots = ctx.snapshot.of_type(ENVIRONMENT).select(F.col("value").alias("root"), F.col("value").alias("node"))
    found = traverse.all_clusters(roots, ctx.snapshot)
    full = F.when(F.expr("startswith(node, concat(root, '#'))"), F.col("node")).otherwise(F.concat("root", F.lit("#"), "node"))
    return found.select(full.alias("value"))


def _has(ctx: Context, bags: list[DataFrame]) -> DataFrame:
    """Clusters that have one of the values in one of the keys."""
    keys = bags[0].select(F.col("value").alias("key")).distinct()
    tags = ctx.snapshot.tags.join(keys, "key", "left_semi").join(bags[1].distinct(), "value", "left_semi").select("node").distinct()
    return tags.join(ctx.snapshot.of_type(CLUSTER), F.col("node") == F.col("value"), "left_semi").select(unprefix(F.col("node"), ctx.env).alias("value"))


def _mem(ctx: Context, bags: list[DataFrame]) -> DataFrame:
    """Keys of a cluster that have one of the values."""
    nodes = _roots(ctx, bags[0]).select("node").distinct()
    return ctx.snapshot.tags.join(nodes, "node", "left_semi").join(bags[1].distinct(), "value", "left_semi").select(F.col("key").alias("value")).distinct()


def builtin() -> dict[str, RangeFunction]:
    return {
        "expand": RangeFunction(1, _expand), "expand_hosts": RangeFunction(1, _expand_hosts), "clusters": RangeFunction(1, _clusters),
        "all_clusters": RangeFunction(0, _all_clusters), "has": RangeFunction(2, _has), "mem": RangeFunction(2, _mem),
    }
