"""Graph traversal as joins of a frontier with the edge table, one level at a time.

Edges are written once per walk, and frontiers at each level, which tells in the
same job whether there are any; so plans stay short, nothing is worked out twice
and a lost executor costs one level.  Visited rows leave by an anti-join, so cycles
end, and shared nodes are walked once per root.  No walk has a depth at which it
gives up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshset.errors import GraphCycle
from meshset.model import CLUSTER, ENVIRONMENT, HOST, Snapshot, counted, cut

#: After so many levels what was visited is written as one table again.
MERGED = 16


def step(edges: DataFrame, down: bool) -> DataFrame:
    """Edges as (at, to, ord) in the direction of travel."""
    a, b, o = ("src", "dst", "fwd_ord") if down else ("dst", "src", "rev_ord")
    return edges.select(F.col(a).alias("at"), F.col(b).alias("to"), F.col(o).alias("ord"))


def _rooted(names: DataFrame) -> DataFrame:
    return names.select("root", "node").distinct()


def reach(roots: DataFrame, edges: DataFrame, down: bool = True, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of everything reachable from rows (root, node), which are at depth 0; least depths."""
    level, n = counted(_rooted(roots).withColumn("depth", F.lit(0).cast("long")))
    a, b = ("src", "dst") if down else ("dst", "src")
    moves = cut(edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct())
    seen, depth = level, 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        found = level.join(moves, F.col("node") == F.col("at")).select("root", F.col("to").alias("node")).distinct()
        level, n = counted(found.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if n:
            seen = seen.unionByName(level)
            seen = cut(seen) if depth % MERGED == 0 else seen
    return seen


def nearest_key(roots: DataFrame, snap: Snapshot, key: str) -> DataFrame:
    """(root, node) of the nearest ancestor-or-self with the tag, first in breadth-first order of reverse edges."""
    keyed = cut(snap.tags.where(F.col("key") == key).select(F.col("node").alias("at")).distinct())
    moves = cut(step(snap.edges, down=False))
    level, n = counted(_rooted(roots).withColumn("path", F.expr("cast(array() as array<bigint>)")))
    seen, hits, depth = level.select("root", "node"), [], 0
    while True:
        hit = cut(level.join(keyed, F.col("node") == F.col("at"), "left_semi").groupBy("root").agg(F.min(F.struct("path", "node")).alias("best")))
        hits.append(hit.select("root", F.col("best.node").alias("node")))
        open_ = level.join(hit, "root", "left_anti")
        found = open_.join(moves, F.col("node") == F.col("at")).select("root", F.col("to").alias("node"), F.expr("array_append(path, ord)").alias("path"))
        level, n = counted(found.join(seen, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path")))
        if not n:
            return reduce(DataFrame.unionByName, hits)
        depth += 1
        seen = seen.unionByName(level.select("root", "node"))
        seen = cut(seen) if depth % MERGED == 0 else seen


def first_key_depth_first(roots: DataFrame, snap: Snapshot, key: str) -> DataFrame:
    """(root, node) of the first ancestor-or-self with the tag in depth-first preorder, last reverse edges first.

    All roots walk at once, each with the path it stands on and what it has left
    behind; ancestors that lead to no tag are not entered, so a walk turns back only
    where a cycle closes on its own path, and takes as many rounds as its path is long.
    """
    keyed = cut(snap.tags.where(F.col("key") == key).select(F.col("node").alias("k_node")).distinct())
    leading = reach(keyed.select(F.lit("").alias("root"), F.col("k_node").alias("node")), snap.edges, down=True).select(F.col("node").alias("l_node"))
    moves = cut(step(snap.edges, down=False).join(leading, F.col("to") == F.col("l_node"), "left_semi"))
    start = _rooted(roots).join(leading, F.col("node") == F.col("l_node"), "left_semi")
    state, n = counted(start.select("root", F.col("node").alias("start"), F.array("node").alias("way"), F.expr("cast(array() as array<string>)").alias("left")))
    done = []
    while n:
        at = state.withColumn("node", F.element_at("way", -1))
        hit = at.join(keyed, F.col("node") == F.col("k_node"), "left_semi").select("root", "node")
        done.append(hit)
        walking = at.join(keyed, F.col("node") == F.col("k_node"), "left_anti")
        ahead = walking.join(moves, F.col("node") == F.col("at")).where(~F.array_contains("way", F.col("to")) & ~F.array_contains("left", F.col("to")))
        best = ahead.groupBy("root", "start").agg(F.min(F.struct((-F.col("ord")).alias("ord"), "to")).alias("best")).select(F.col("root").alias("b_root"), F.col("start").alias("b_start"), "best.to")
        both = walking.join(best, (F.col("root") == F.col("b_root")) & (F.col("start") == F.col("b_start")), "left")
        back = F.col("to").isNull()
        state, n = counted(
            both.select(
                "root", "start", F.when(back, F.slice("way", 1, F.size("way") - 1)).otherwise(F.array_append("way", F.col("to"))).alias("way"),
                F.when(back, F.array_append("left", F.col("node"))).otherwise(F.col("left")).alias("left"),
            ).where(F.size("way") > 0)
        )
    if not done:
        return start.select("root", "node")
    return reduce(DataFrame.unionByName, done)


def nearest_common_ancestor(pairs: DataFrame, snap: Snapshot) -> DataFrame:
    """(a, b, ancestor, distance) for rows (a, b): the common ancestor-or-self with the least sum of distances, then by name."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    up = cut(reach(ends.select(F.col("node").alias("root"), "node"), snap.edges, down=False))
    left = up.select(F.col("root").alias("a"), F.col("node").alias("ancestor"), F.col("depth").alias("da"))
    right = up.select(F.col("root").alias("b"), F.col("node").alias("ancestor"), F.col("depth").alias("db"))
    both = pairs.distinct().join(left, "a").join(right, ["b", "ancestor"])
    best = both.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("distance"), "ancestor")).alias("best"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", "best.ancestor", "best.distance")


def peel(edges: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Take away, round by round, the edges (src, dst) from nodes that no edge leads to: what was there at each round, what can't go, and how much that is.

    What can't go are the edges of cycles and of what lies below them; without cycles nothing is left.
    """
    rest, n = counted(edges.select("src", "dst").distinct())
    rounds = []
    while n:
        rounds.append(rest)
        inner = rest.select(F.col("dst").alias("src")).distinct()
        rest, left = counted(rest.join(inner, "src", "left_semi"))
        if left == n:
            break
        n = left
    return rounds, rest, n


def topological_levels(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(node, level): dependents before what they depend on; a cycle raises.

    ``nodes`` has node; ``dependencies`` has src, dst (src depends on dst), and
    targets outside ``nodes`` come in as well.  A node's level is the length of
    the longest chain of dependents above it.
    """
    moves = cut(dependencies.select("src", "dst").distinct())
    start = nodes.select(F.lit("").alias("root"), "node")
    every = cut(reach(start, moves).select("node").distinct())
    rounds, _, left = peel(moves.join(every, F.col("src") == F.col("node"), "left_semi"))
    if left:
        raise GraphCycle("the dependencies have a cycle")
    levels = [every.withColumn("level", F.lit(0).cast("long"))]
    levels += [r.select(F.col("dst").alias("node"), F.lit(k + 1).cast("long").alias("level")).distinct() for k, r in enumerate(rounds)]
    return reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.max("level").alias("level"))


def paths(roots: DataFrame, snap: Snapshot, max_depth: int | None = None) -> DataFrame:
    """(root, path, depth, node): one row per path down from a root; a node on the path isn't entered again."""
    moves, depth = cut(step(snap.edges, down=True)), 0
    inner = cut(snap.of_type(ENVIRONMENT, CLUSTER))
    level, n = counted(_rooted(roots).select("root", F.array("node").alias("path"), F.lit(0).cast("long").alias("depth"), "node"))
    levels = [level]
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        open_ = level.join(inner, F.col("node") == F.col("value"), "left_semi")
        found = open_.join(moves, F.col("node") == F.col("at")).where(~F.array_contains("path", F.col("to")))
        level, n = counted(found.select("root", F.expr("array_append(path, to)").alias("path"), F.lit(depth).cast("long").alias("depth"), F.col("to").alias("node")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def hosts_by_paths(roots: DataFrame, snap: Snapshot) -> DataFrame:
    """(root, node, times): hosts below each root and over how many paths, as decimal(38, 0).

    Counts are added up level by level, never the paths.  Only roots from which a
    cycle can be reached are walked path by path, where no node is entered twice.
    """
    start = cut(_rooted(roots))
    edges = cut(snap.edges.select("src", "dst", "fwd_ord"))
    hosts = cut(snap.of_type(HOST))
    _, core, cyclic = peel(edges)
    every, counting = [], start
    if cyclic:  # less what merely lies below the cycles
        _, core, cyclic = peel(core.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        round_ = core.select(F.col("src").alias("node")).distinct()
        entered = cut(reach(start, edges).join(round_, "node", "left_semi").select("root").distinct())
        counting = start.join(entered, "root", "left_anti")
        walked = paths(start.join(entered, "root", "left_semi"), snap)
        every.append(walked.groupBy("root", "node").agg(F.sum(F.lit(1).cast("decimal(28,0)")).alias("times")))
    level, n = counted(counting.withColumn("times", F.lit(1).cast("decimal(38,0)")))
    while n:
        every.append(level)
        found = level.join(edges, F.col("node") == F.col("src"))
        level, n = counted(found.groupBy("root", F.col("dst").alias("node")).agg(F.sum("times").cast("decimal(38,0)").alias("times")))
    if not every:
        every = [level]
    return reduce(DataFrame.unionByName, every).join(hosts, F.col("node") == F.col("value"), "left_semi").groupBy("root", "node").agg(F.sum("times").cast("decimal(38,0)").alias("times"))


def orphans(snap: Snapshot) -> DataFrame:
    """(type, name) of the nodes that no environment reaches."""
    roots = snap.of_type(ENVIRONMENT).select(F.lit("").alias("root"), F.col("value").alias("node"))
    found = reach(roots, snap.edges).select(F.col("node").alias("name"))
    return snap.nodes.join(found, "name", "left_anti").select("type", "name")


def all_clusters(roots: DataFrame, snap: Snapshot) -> DataFrame:
    """(root, node) of all clusters reachable from each root, once."""
    clusters = snap.of_type(CLUSTER)
    return reach(roots, snap.edges).where("depth > 0").join(clusters, F.col("node") == F.col("value"), "left_semi").select("root", "node")


def tree_json(roots: DataFrame, snap: Snapshot, dependencies: DataFrame, name: Column, max_depth: int | None = None) -> DataFrame:
    """(root, json): the nested object of each root, built level by level from the deepest one up.

    ``name`` gives the shown name of column ``node``; children are keyed by full
    names; each node has its own tags and dependencies.
    """
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    values = snap.tags.groupBy("node", "key").agg(F.expr("transform(array_sort(collect_list(case when value is not null then struct(val_ord, value) end)), x -> x.value)").alias("vs"))
    tags = values.withColumn("t", F.concat(quoted("key"), F.lit(":"), F.to_json("vs"))).groupBy(F.col("node").alias("tn")).agg(F.concat_ws(",", F.array_sort(F.collect_list("t"))).alias("tags"))
    deps = dependencies.groupBy(F.col("src").alias("dn")).agg(F.to_json(F.expr("transform(array_sort(collect_list(struct(fwd_ord, dst))), x -> x.dst)")).alias("deps"))
    rows = paths(roots, snap, max_depth)
    own = rows.join(snap.nodes.withColumnRenamed("name", "nn"), F.col("node") == F.col("nn")).join(tags, F.col("node") == F.col("tn"), "left").join(deps, F.col("node") == F.col("dn"), "left")
    own = own.withColumn("__shown", name)
    head = F.concat(F.lit('{"type":"'), "type", F.lit('","name":'), quoted("__shown"), F.lit(',"tags":{'), F.coalesce("tags", F.lit("")), F.lit('},"dependencies":'), F.coalesce("deps", F.lit("[]")), F.lit(',"children":{'))
    own = cut(own.select("root", "path", "depth", "node", head.alias("head")))
    deepest = own.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = own.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, ["root", "path"], "left")
        inside = F.coalesce(F.col("inside"), F.lit("")) if below is not None else F.lit("")
        done = level.select("root", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("path"), "node", F.concat("head", inside, F.lit("}}")).alias("json"))
        if depth == 0:
            return done.select("root", "json")
        below = cut(done.groupBy("root", "path").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat(quoted("node"), F.lit(":"), "json")))).alias("inside")))
    return own.select("root", F.lit("{}").alias("json"))
