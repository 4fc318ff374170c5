"""From syntax trees to DataFrames with one column, ``value``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.functions.context import Context
from meshset.functions.registry import RangeFunction
from meshset.operators import sets, strings, traverse
from meshset.operators.names import refuse, resolve
from meshset.plans import syntax as s

ADMIN_KEY = "ADMIN_NODE"
#: Literal lists up to this length are folded on the driver.
FOLDED = 10_000


@dataclass(frozen=True)
class Bag:
    """A bag; ``distinct``: known to be free of duplicates; ``known``: its values, where the text alone gives them.

    ``ordered``: it has the order of the text; other bags have none of their own and are listed sorted.
    ``nodes``: its values come from the graph, so they are names of nodes that exist.
    """

    df: DataFrame
    distinct: bool = False
    known: tuple[str, ...] | None = None
    ordered: bool = False
    nodes: bool = False


class Planner:
    """Plans a tree once per distinct subtree; if strict, ``check`` looks for unknown names of the whole tree in one job."""

    def __init__(self, ctx: Context, functions: dict[str, RangeFunction], strict: bool = True):
        self.ctx, self.functions, self.strict = ctx, functions, strict
        self.spark = ctx.snapshot.spark
        self.done: dict[s.Node, Bag] = {}
        self.unknown: list[DataFrame] = []

    def plan(self, node: s.Node) -> Bag:
        if node not in self.done:
            self.done[node] = getattr(self, type(node).__name__.lower())(node)
        return self.done[node]

    def check(self) -> None:
        refuse(self.unknown)
        self.unknown = []

    def listed(self, values: list[str]) -> Bag:
        df = self.spark.createDataFrame([(v,) for v in values], "value string")
        return Bag(df, len(set(values)) == len(values), tuple(values), True)

    def null(self, _: s.Null) -> Bag:
        return self.listed([])

    def word(self, n: s.Word | s.Literal | s.Regex) -> Bag:
        return self.listed([n.text])

    literal = regex = word

    def sequence(self, n: s.Sequence) -> Bag:
        return Bag(strings.sequence(self.spark, n.left, n.right), True, ordered=True)

    def group(self, n: s.Group) -> Bag:
        return self.plan(n.child)

    def union(self, n: s.Union) -> Bag:
        a, b = self.plan(n.left), self.plan(n.right)
        if a.known is not None and b.known is not None and a.distinct and b.distinct and len(a.known) + len(b.known) <= FOLDED:
            return self.listed(sorted({*a.known, *b.known}, key=str.encode))
        both = a.distinct and b.distinct
        return Bag(sets.union(a.df, b.df, both), both, nodes=a.nodes and b.nodes)

    def _filtered(self, n: s.Difference | s.Intersection, keep: bool) -> Bag:
        a = self.plan(n.left)
        return Bag(sets.matching(a.df, n.right.text, keep == n.right.positive), a.distinct, nodes=a.nodes)

    def difference(self, n: s.Difference) -> Bag:
        if isinstance(n.right, s.Regex):
            return self._filtered(n, keep=False)
        a, b = self.plan(n.left), self.plan(n.right)
        return Bag(sets.difference(a.df, b.df), a.distinct, nodes=a.nodes)

    def intersection(self, n: s.Intersection) -> Bag:
        if isinstance(n.right, s.Regex):
            return self._filtered(n, keep=True)
        a, b = self.plan(n.left), self.plan(n.right)
        return Bag(sets.intersection(a.df, b.df), a.distinct or b.distinct, nodes=a.nodes or b.nodes)

    def brace(self, n: s.Brace) -> Bag:
        bags = [self.plan(x) for x in (n.left, n.centre, n.right)]
        size = 1
        for b in bags:
            size *= max(1, len(b.known)) if b.known is not None else FOLDED + 1
        if size <= FOLDED:
            out = [""]
            for b in bags:
                out = [x + y for x in out for y in b.known or [""]]
            return self.listed(out if any(b.known for b in bags) else [])
        parts = [b.df if (b.known or b.known is None and not b.df.isEmpty()) else None for b in bags]
        got = strings.braces(*parts)
        return Bag(got) if got is not None else self.null(s.Null())

    def _nodes(self, child: s.Node) -> DataFrame:
        bag = self.plan(child)
        if bag.nodes:
            return bag.df.withColumn("node", F.col("value"))
        return resolve(bag.df, self.ctx.snapshot, self.ctx.env, self.strict, self.unknown)

    def expand(self, n: s.Expand) -> Bag:
        if isinstance(n.child, s.KeyExpand):
            return Bag(self.plan(n.child).df.distinct(), True)
        edges = self.ctx.snapshot.edges
        return Bag(self._nodes(n.child).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("value")).distinct(), True, nodes=True)

    def getcluster(self, n: s.GetCluster) -> Bag:
        edges = self.ctx.snapshot.edges
        return Bag(self._nodes(n.child).join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("value")), nodes=True)

    def keyexpand(self, n: s.KeyExpand) -> Bag:
        tags = self.ctx.snapshot.tags.withColumnRenamed("node", "of").withColumnRenamed("value", "tag")
        if n.key == "KEYS":
            keys = tags.select("of", "key").distinct()
            return Bag(self._nodes(n.child).join(keys, F.col("node") == F.col("of")).select(F.col("key").alias("value")))
        values = tags.where((F.col("key") == n.key) & F.col("tag").isNotNull())
        return Bag(self._nodes(n.child).join(values, F.col("node") == F.col("of")).select(F.col("tag").alias("value")))

    def admin(self, n: s.Admin) -> Bag:
        roots = self._nodes(n.child).select(F.col("node").alias("root"), "node")
        found = traverse.nearest_key(roots, self.ctx.snapshot, ADMIN_KEY).select("node").distinct()
        tags = self.ctx.snapshot.tags.where((F.col("key") == ADMIN_KEY) & F.col("value").isNotNull())
        return Bag(tags.join(found, "node", "left_semi").select("value").distinct(), True)

    def function(self, n: s.Function) -> Bag:
        bags = [self.plan(a) for a in n.args]
        # an empty argument doesn't count
        bags = [b.df for b in bags if (b.known if b.known is not None else not b.df.isEmpty())]
        fn = self.functions[n.name]
        if len(bags) != fn.n_args:
            return self.null(s.Null())
        return Bag(fn.plan(self.ctx, bags))
