"""Reads around given nodes, as joins: for one node or for all of them.

``nodes`` has the column ``node``; unknown nodes give no rows, repeated ones give
theirs once.  Rows carry the ordinal that lists are sorted by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.model import Snapshot


def children(snap: Snapshot, nodes: DataFrame) -> DataFrame:
    """(node, child, ord): forward edges."""
    return snap.edges.join(nodes.select("node"), F.col("src") == F.col("node"), "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("child"), F.col("fwd_ord").alias("ord"))


def typed_children(snap: Snapshot, nodes: DataFrame) -> DataFrame:
    """(node, type, child, ord): forward edges with the types of their ends."""
    types = snap.nodes.select(F.col("name").alias("child"), "type")
    return children(snap, nodes).join(types, "child").select("node", "type", "child", "ord")


def parents(snap: Snapshot, nodes: DataFrame) -> DataFrame:
    """(node, parent, ord): reverse edges."""
    return snap.edges.join(nodes.select("node"), F.col("dst") == F.col("node"), "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("rev_ord").alias("ord"))


def tags(snap: Snapshot, nodes: DataFrame) -> DataFrame:
    """(node, key, ord, value): all tags; a null value stands for the key itself."""
    return snap.tags.join(nodes.select("node"), "node", "left_semi").select("node", "key", F.col("val_ord").alias("ord"), "value")


def keys(snap: Snapshot, nodes: DataFrame) -> DataFrame:
    """(node, key): names of tags, once each."""
    return tags(snap, nodes).select("node", "key").distinct()


def values(snap: Snapshot, nodes: DataFrame, key: str) -> DataFrame:
    """(node, value, ord): values of one tag."""
    return tags(snap, nodes).where((F.col("key") == key) & F.col("value").isNotNull()).select("node", "value", "ord")


def tag_lists(snap: Snapshot, nodes: DataFrame) -> DataFrame:
    """(node, key, values): each tag with its values in order; a tag without values has none."""
    listed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ord", "value"))))
    return tags(snap, nodes).groupBy("node", "key").agg(F.transform(listed, lambda x: x["value"]).alias("values"))
