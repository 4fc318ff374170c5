"""Text forms of results: DOT graphs, newline and comma lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.model import CLUSTER, Snapshot


def _quote(c: str) -> F.Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))


def dot_lines(snap: Snapshot) -> DataFrame:
    """One line per edge of the tree graph; stays distributed, to be written as text."""
    return snap.edges.select(F.concat(_quote("src"), F.lit(" -> "), _quote("dst"), F.lit(";")).alias("line")).distinct()


def dot_cluster_lines(snap: Snapshot) -> DataFrame:
    """One line per cluster with its hosts: a subgraph in the nested-cluster graph."""
    inside = snap.edges.join(snap.of_type(CLUSTER), F.col("src") == F.col("value"), "left_semi")
    body = inside.groupBy("src").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat(_quote("dst"), F.lit(";"))))).alias("body"))
    return body.select(F.concat(F.lit("subgraph "), F.expr("concat('\"cluster_', src, '\"')"), F.lit(" { "), "body", F.lit(" }")).alias("line"))


def dot(snap: Snapshot, nested: bool = False) -> str:
    """A whole graph as DOT text, for graphs that a person can look at."""
    lines = [r[0] for r in (dot_cluster_lines(snap) if nested else dot_lines(snap)).orderBy("line").toLocalIterator()]
    return "digraph topology {\n" + "\n".join(lines) + "\n}\n"


def text_list(bag: DataFrame, separator: str = "\n") -> str:
    """A result bag as one sorted text, for results that a person can read."""
    return separator.join(r[0] for r in bag.orderBy("value").toLocalIterator())
