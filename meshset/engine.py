"""The API: expressions, structured reads, versions and writes."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshset import errors
from meshset.functions import timespec
from meshset.functions.context import Context
from meshset.functions.registry import RangeFunction, builtin
from meshset.model import CLUSTER, ENVIRONMENT, HOST, STRING, Snapshot, Topology
from meshset.operators import lookups, traverse
from meshset.operators.names import prefixed, unprefix
from meshset.plans import syntax
from meshset.plans.planner import Bag, Planner
from meshset.sources import sinks
from meshset.sources.store import ARITY, Store


class Engine:
    """Queries over a topology; with a store, also versions by time and writes."""

    def __init__(self, topology: Topology | None = None, store: Store | None = None, functions: dict[str, RangeFunction] | None = None, strict: bool = True, strict_escapes: bool = True):
        self.store, self._topology = store, topology
        self.functions = builtin() | (functions or {})
        self.strict, self.strict_escapes = strict, strict_escapes

    @property
    def topology(self) -> Topology:
        return self._topology or self.store.topology()

    def snapshot(self, version: int | None = None, graph: str = "primary") -> Snapshot:
        return self.topology.as_of(version, graph)

    # expressions

    def _bag(self, expression: str, env: str, version: int | None) -> Bag:
        tree = syntax.parse(expression, frozenset(self.functions), self.strict_escapes)
        t = self.topology
        ctx = Context(t.as_of(version), t.as_of(version, "dependency"), env)
        planner = Planner(ctx, self.functions, self.strict)
        bag = planner.plan(tree)
        planner.check()
        return bag

    def plan(self, expression: str, env: str = "", version: int | None = None) -> DataFrame:
        """The bag of an expression, as column ``value``, without the environment's prefix."""
        return self._bag(expression, env, version).df.select(unprefix(F.col("value"), env).alias("value"))

    def expand_range_expression(self, env: str, expression: str, version: int | None = None) -> list[str]:
        """The values of an expression: what graph and set operators give is sorted, lists and sequences keep their order."""
        bag = self._bag(expression, env, version)
        df = bag.df.select(unprefix(F.col("value"), env).alias("value"))
        return [r[0] for r in (df if bag.ordered else df.orderBy("value")).collect()]

    # lookups

    def _node(self, env: str, node: str, version: int | None, *types: str) -> tuple[str, str]:
        """(name, type): the environment; or ``env#node``; or the bare node, where it is a host."""
        if not env and not node:
            raise errors.NodeNotFound("no name")
        names = [env] if not node or env == node else [prefixed(env, node), node] if env else [node]
        found = {r.name: r.type for r in self.snapshot(version).nodes.where(F.col("name").isin(names)).collect()}
        for k, name in enumerate(names):
            kind = found.get(name)
            if kind is None or (k and kind != HOST):
                continue
            if types and kind not in types or not env and kind not in (STRING, HOST, ENVIRONMENT) or name == env and kind != ENVIRONMENT:
                raise errors.IncorrectNodeType(f"{name} is {kind}")
            return name, kind
        raise errors.NodeNotFound(prefixed(env, node))

    def _one(self, name: str, version: int | None) -> tuple[Snapshot, DataFrame]:
        snap = self.snapshot(version)
        return snap, snap.spark.createDataFrame([(name,)], "node string")

    def simple_expand(self, env: str, node: str, version: int | None = None, *types: str) -> list[str]:
        name, kind = self._node(env, node, version, *types)
        if kind == HOST:
            return []
        rows = lookups.children(*self._one(name, version)).orderBy("ord")
        return [r[0] for r in rows.select(unprefix(F.col("child"), env)).collect()]

    def simple_expand_cluster(self, env: str, cluster: str, version: int | None = None) -> list[str]:
        return self.simple_expand(env, cluster, version, CLUSTER)

    def simple_expand_env(self, env: str, version: int | None = None) -> list[str]:
        return self.simple_expand(env, "", version, ENVIRONMENT)

    def get_clusters(self, env: str, node: str, version: int | None = None) -> list[str]:
        name, _ = self._node(env, node, version)
        rows = lookups.parents(*self._one(name, version)).orderBy("ord")
        return [r[0] for r in rows.select(unprefix(F.col("parent"), env)).collect()]

    def all_clusters(self, env: str, version: int | None = None) -> list[str]:
        name, _ = self._node(env, "", version, ENVIRONMENT)
        snap = self.snapshot(version)
        root = snap.spark.createDataFrame([(name, name)], "root string, node string")
        return [r[0] for r in traverse.all_clusters(root, snap).orderBy("node").select(unprefix(F.col("node"), env)).collect()]

    def all_environments(self, version: int | None = None) -> list[str]:
        return [r[0] for r in self.snapshot(version).of_type(ENVIRONMENT).orderBy("value").collect()]

    def all_hosts(self, version: int | None = None) -> list[str]:
        return [r[0] for r in self.snapshot(version).of_type(HOST).orderBy("value").collect()]

    # tags

    def fetch_all_keys(self, env: str, node: str, version: int | None = None) -> dict[str, list[str]]:
        name, _ = self._node(env, node, version)
        return {r.key: list(r["values"]) for r in lookups.tag_lists(*self._one(name, version)).orderBy("key").collect()}

    def get_keys(self, env: str, node: str, version: int | None = None) -> list[str]:
        return list(self.fetch_all_keys(env, node, version))

    def fetch_key(self, env: str, node: str, key: str, version: int | None = None) -> list[str]:
        found = self.fetch_all_keys(env, node, version)
        if key not in found:
            raise errors.KeyNotFound(key)
        return found[key]

    # trees and ancestors

    def expand(self, env: str, node: str, version: int | None = None, depth: int | None = None, *types: str) -> dict:
        name, _ = self._node(env, node, version, *types)
        snap = self.snapshot(version)
        root = snap.spark.createDataFrame([(name, name)], "root string, node string")
        rows = traverse.tree_json(root, snap, self.snapshot(version, "dependency").edges, unprefix(F.col("node"), env), depth)
        return json.loads(rows.first()["json"])

    def project(self, env: str, node: str, version: int | None = None) -> dict:
        """A node by itself: type, name, tags, dependencies, and its children as (type, name), in order."""
        name, kind = self._node(env, node, version)
        rows = lookups.typed_children(*self._one(name, version)).orderBy("ord", "child").select("type", unprefix(F.col("child"), env))
        return {
            "type": kind, "name": name.removeprefix(f"{env}#"), "tags": self.fetch_all_keys(env, node, version), "dependencies": self.dependencies(env, node, version),
            "children": [] if kind == HOST else [tuple(r) for r in rows.collect()],
        }

    def dot(self, version: int | None = None, graph: str = "primary", nested: bool = False) -> str:
        """A graph, of what contains what or of dependencies, as DOT text."""
        return sinks.dot(self.snapshot(version, graph), nested)

    def expand_cluster(self, env: str, cluster: str, version: int | None = None, depth: int | None = None) -> dict:
        return self.expand(env, cluster, version, depth, CLUSTER)

    def expand_env(self, env: str, version: int | None = None, depth: int | None = None) -> dict:
        return self.expand(env, "", version, depth, ENVIRONMENT)

    def _first_key(self, search: Callable, env: str, node: str, key: str, version: int | None) -> tuple[str, list[str]]:
        name, _ = self._node(env, node, version)
        snap = self.snapshot(version)
        root = snap.spark.createDataFrame([(name, name)], "root string, node string")
        found = search(root, snap, key).first()
        if found is None:
            return "", []
        rows = lookups.values(snap, snap.spark.createDataFrame([(found.node,)], "node string"), key).orderBy("ord")
        return found.node.removeprefix(f"{env}#"), [r.value for r in rows.collect()]

    def bfs_search_parents_for_first_key(self, env: str, node: str, key: str, version: int | None = None) -> tuple[str, list[str]]:
        return self._first_key(traverse.nearest_key, env, node, key, version)

    def dfs_search_parents_for_first_key(self, env: str, node: str, key: str, version: int | None = None) -> tuple[str, list[str]]:
        return self._first_key(traverse.first_key_depth_first, env, node, key, version)

    def nearest_common_ancestor(self, env: str, a: str, b: str, version: int | None = None) -> tuple[bool, str | None]:
        names = [self._node(env, x, version)[0] for x in (a, b)]
        snap = self.snapshot(version)
        found = traverse.nearest_common_ancestor(snap.spark.createDataFrame([tuple(names)], "a string, b string"), snap).first()
        return (False, None) if found.ancestor is None else (True, found.ancestor.removeprefix(f"{env}#"))

    def environment_topological_sort(self, env: str, version: int | None = None) -> list[str]:
        name, _ = self._node(env, "", version, ENVIRONMENT)
        snap, deps = self.snapshot(version), self.snapshot(version, "dependency")
        root = snap.spark.createDataFrame([(name, name)], "root string, node string")
        below = traverse.reach(root, snap.edges).select("node").join(snap.of_type(ENVIRONMENT), F.col("node") == F.col("value"), "left_anti")
        inner = deps.edges.join(snap.of_type(CLUSTER, ENVIRONMENT), F.col("src") == F.col("value"), "left_semi")
        levels = traverse.topological_levels(below, inner)
        return [r[0] for r in levels.orderBy("level", "node").select(unprefix(F.col("node"), env)).collect()]

    def dependencies(self, env: str, node: str, version: int | None = None) -> list[str]:
        """What a node depends on, in order."""
        name, _ = self._node(env, node, version)
        snap = self.snapshot(version, "dependency")
        rows = lookups.children(snap, snap.spark.createDataFrame([(name,)], "node string")).orderBy("ord")
        return [r[0] for r in rows.select(unprefix(F.col("child"), env)).collect()]

    def find_orphaned_nodes(self, version: int | None = None, types: tuple[str, ...] = (), env: str = "") -> list[tuple[str, str]]:
        """(type, name) of what no environment reaches, of some types, or named after an environment."""
        rows = traverse.orphans(self.snapshot(version))
        if types:
            rows = rows.where(F.col("type").isin(*types))
        if env:
            rows = rows.where(F.startswith(F.col("name"), F.lit(env + "#")))
        return [tuple(r) for r in rows.orderBy("type", "name").collect()]

    def counts(self, version: int | None = None, graph: str = "primary") -> dict[str, int]:
        """How many nodes of each type and how many edges a graph has."""
        return dict(self.snapshot(version, graph).counts().collect())

    # versions

    def range_version(self) -> int:
        return self.store.range_version()

    def get_range_version(self, spec: str, now: datetime | None = None) -> int | None:
        return version_before(self.store.log(), timespec.parse(spec, now)).first()[0]

    def get_changelist(self) -> DataFrame:
        """(version, ts, graphs): which graphs each write changed, and to which of their own versions."""
        return changelist(self.store.log(), self.store.events())

    # writes

    def bulk_edit(self, requests: list[tuple[str, tuple[str, ...]]]) -> dict[str, list]:
        """Many writes at once; what was refused does not hold up the rest."""
        done = self.store.apply(requests)
        return {"succeeded": [(r.method, r.args) for r in done if not r.error], "failed": [(r.method, r.args, type(r.error).__name__) for r in done if r.error]}

    def __getattr__(self, name: str):
        if name in ARITY and self.__dict__.get("store"):
            return lambda *args: self.store.write(name, *args)
        raise AttributeError(name)


def version_before(log: DataFrame, at: datetime) -> DataFrame:
    """One row, version: the last one that was written before a time; null if none was."""
    return log.where(F.col("ts") < F.lit(at)).agg(F.max("version").alias("version"))


def changelist(log: DataFrame, events: DataFrame) -> DataFrame:
    """A graph's version is that of the last write that changed it."""
    touched = events.select("version", "graph").distinct()
    graphs = touched.groupBy("version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("graph", "version")))).alias("graphs"))
    return log.select("version", "ts").join(graphs, "version", "left")


def open_store(spark: SparkSession, path: str) -> Engine:
    return Engine(store=Store(spark, path))
