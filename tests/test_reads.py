"""Structured reads on a railway, and traversal against plain Python on generated graphs, with and without cycles."""

import random
from collections import Counter, deque

import pytest

from meshset import errors
from meshset.engine import Engine
from meshset.model import EDGES, LATEST, NODES, TAGS, Snapshot, Topology
from meshset.operators import traverse
from meshset.sources import sinks

LINES = {"coast": ["dune", "cliff", "bay"], "valley": ["mill", "ford"]}


@pytest.fixture(scope="module")
def engine(spark):
    nodes, edges = [("rail", "ENVIRONMENT")], []
    for line, stations in LINES.items():
        nodes.append((f"rail#{line}", "CLUSTER"))
        edges.append(("rail", f"rail#{line}"))
        for st in reversed(stations):
            nodes.append((f"rail#{st}", "CLUSTER"))
            edges.append((f"rail#{line}", f"rail#{st}"))
            for k in (1, 2, 3):
                nodes.append((f"{st}-signal{k}", "HOST"))
                edges.append((f"rail#{st}", f"{st}-signal{k}"))
    edges.append(("rail#ford", "bay-signal2"))
    tags = [(n, "built", 0, str(1850 + k)) for k, (n, _) in enumerate(nodes)] + [(n, "crew", o, v) for n in ("rail#coast", "rail#mill") for o, v in enumerate(("Zoe", "Abe", "Kim"))] + [("rail", "owner", 0, "state"), ("rail#bay", "empty", 0, None)]
    nodes += [(f"scrap{k}", "STRING") for k in range(2)] + [("yard#shed", "CLUSTER")]
    deps = [("rail#valley", "rail#dune"), ("rail#dune", "rail#bay")]
    row = lambda xs, schema: spark.createDataFrame(xs, schema)
    t = Topology(
        row([("primary", *n, 1, LATEST) for n in nodes], NODES),
        row([(g, a, b, k, k, 1, LATEST) for g, es in (("primary", edges), ("dependency", deps)) for k, (a, b) in enumerate(es)], EDGES),
        row([("primary", *x, 1, LATEST) for x in tags], TAGS),
    )
    dependency = row([("dependency", n, "CLUSTER", 1, LATEST) for n, _ in nodes if n.startswith("rail#")], NODES)
    return Engine(Topology(t.nodes.union(dependency).cache(), t.edges.cache(), t.tags.cache()))


def test_reads(engine):
    assert engine.all_environments() == ["rail"] and len(engine.all_hosts()) == 15 and engine.all_hosts() == sorted(engine.all_hosts())
    assert engine.all_clusters("rail") == sorted([*LINES, *LINES["coast"], *LINES["valley"]])
    assert engine.expand_range_expression("rail", "%coast") == ["bay", "cliff", "dune"]
    assert engine.simple_expand_env("rail") == ["coast", "valley"] and engine.simple_expand_cluster("rail", "coast") == ["bay", "cliff", "dune"]
    assert engine.simple_expand("rail", "mill-signal1") == []
    assert engine.get_clusters("rail", "dune") == ["coast"] and engine.get_clusters("rail", "bay-signal2") == ["bay", "ford"]
    assert engine.get_keys("rail", "mill") == ["built", "crew"] and engine.fetch_key("rail", "mill", "crew") == ["Zoe", "Abe", "Kim"]
    assert engine.fetch_key("rail", "bay", "empty") == [] and engine.fetch_all_keys("rail", "bay").keys() == {"built", "empty"}
    assert engine.dependencies("rail", "valley") == ["dune"] and engine.counts() == {"ENVIRONMENT": 1, "CLUSTER": 8, "HOST": 15, "STRING": 2, "edges": 23}
    with pytest.raises(errors.KeyNotFound):
        engine.fetch_key("rail", "mill", "colour")
    with pytest.raises(errors.NodeNotFound):
        engine.simple_expand("rail", "harbour")
    with pytest.raises(errors.IncorrectNodeType):
        engine.expand_cluster("rail", "mill-signal1")


def test_projection_and_dot(engine):
    coast = engine.project("rail", "coast")
    assert coast["type"] == "CLUSTER" and coast["name"] == "coast" and coast["tags"]["crew"] == ["Zoe", "Abe", "Kim"] and coast["dependencies"] == []
    assert coast["children"] == [("CLUSTER", "bay"), ("CLUSTER", "cliff"), ("CLUSTER", "dune")]
    assert engine.project("rail", "valley")["dependencies"] == ["dune"] and engine.project("rail", "")["children"] == [("CLUSTER", "coast"), ("CLUSTER", "valley")]
    signal = engine.project("rail", "mill-signal1")
    assert signal["type"] == "HOST" and signal["children"] == [] and set(signal["tags"]) == {"built"}
    with pytest.raises(errors.NodeNotFound):
        engine.project("rail", "harbour")
    assert engine.dot(graph="dependency") == 'digraph topology {\n"rail#dune" -> "rail#bay";\n"rail#valley" -> "rail#dune";\n}\n'
    assert engine.dot().count("->") == 23 and "subgraph" in engine.dot(nested=True)


def test_ancestors(engine):
    for search in (engine.bfs_search_parents_for_first_key, engine.dfs_search_parents_for_first_key):
        assert search("rail", "mill-signal3", "crew") == ("mill", ["Zoe", "Abe", "Kim"])
        assert search("rail", "ford", "owner") == ("rail", ["state"])
        assert search("rail", "ford", "colour") == ("", [])
    # the last way up goes first in depth, over the ford; the first way up is the nearer one, over the bay
    assert engine.dfs_search_parents_for_first_key("rail", "bay-signal2", "crew") == ("coast", ["Zoe", "Abe", "Kim"])
    assert engine.bfs_search_parents_for_first_key("rail", "bay-signal2", "empty") == ("bay", [])
    assert engine.nearest_common_ancestor("rail", "dune-signal1", "dune-signal2") == (True, "dune")
    assert engine.nearest_common_ancestor("rail", "dune-signal1", "cliff-signal2") == (True, "coast")
    assert engine.nearest_common_ancestor("rail", "ford", "ford") == (True, "ford")
    assert engine.find_orphaned_nodes() == [("CLUSTER", "yard#shed"), ("STRING", "scrap0"), ("STRING", "scrap1")]
    assert engine.find_orphaned_nodes(types=("STRING",)) == [("STRING", "scrap0"), ("STRING", "scrap1")] and engine.find_orphaned_nodes(env="yard") == [("CLUSTER", "yard#shed")]
    order = engine.environment_topological_sort("rail")
    assert len(order) == 22 and order.index("valley") < order.index("dune") < order.index("bay")


def test_trees(engine):
    tree = engine.expand_env("rail")
    assert tree["type"] == "ENVIRONMENT" and set(tree["children"]) == {"rail#coast", "rail#valley"}
    ford = tree["children"]["rail#valley"]["children"]["rail#ford"]
    assert ford["name"] == "ford" and set(ford["children"]) == {"ford-signal1", "ford-signal2", "ford-signal3", "bay-signal2"}
    dune = tree["children"]["rail#coast"]["children"]["rail#dune"]
    assert dune["dependencies"] == ["rail#bay"] and set(dune["tags"]) == {"built"} and tree["children"]["rail#coast"]["tags"]["crew"] == ["Zoe", "Abe", "Kim"]
    assert tree["children"]["rail#coast"]["children"]["rail#bay"]["tags"]["empty"] == []
    assert engine.expand_env("rail", None, 1)["children"]["rail#coast"]["children"] == {}
    assert engine.expand_range_expression("rail", "expand_hosts(rail)").count("bay-signal2") == 2
    assert engine.expand_range_expression("rail", "all_clusters()") == engine.all_clusters("rail")
    dot = sinks.dot(engine.snapshot())
    assert dot.startswith("digraph") and '"rail" -> "rail#coast";' in dot and "subgraph" in sinks.dot(engine.snapshot(), nested=True)
    assert sinks.text_list(engine.plan("b,a"), ",") == "a,b"


def snapshot(spark, names, edges, keyed=(), hosts=()):
    """``edges`` are (src, dst, fwd_ord, rev_ord)."""
    return Snapshot(
        spark.createDataFrame([(n, "HOST" if n in hosts else "CLUSTER") for n in names], "name string, type string"),
        spark.createDataFrame(edges, "src string, dst string, fwd_ord bigint, rev_ord bigint"),
        spark.createDataFrame([(n, "K", 0, "v") for n in keyed], "node string, key string, val_ord bigint, value string"),
    )


def each(spark, names):
    return spark.createDataFrame([(n, n) for n in names], "root string, node string")


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_search(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{k}" for k in range(8)]
    edges = [(a, b, k, rnd.randrange(100)) for k, (a, b) in enumerate(sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(13)})) if a != b]
    keyed, hosts = set(rnd.sample(names, 2)), set(rnd.sample(names, 3))
    up = {n: [a for a, b, _, o in sorted(edges, key=lambda e: (e[3], e[2])) if b == n] for n in names}
    edges = [(a, b, k, up[b].index(a)) for a, b, k, _ in edges]
    edges = [e for e in edges if e[0] not in hosts]
    up = {n: [a for a in ps if a not in hosts] for n, ps in up.items()}
    snap, roots = snapshot(spark, names, edges, keyed, hosts), each(spark, names)

    def bfs(n):
        seen, todo = {n}, deque([n])
        while todo:
            x = todo.popleft()
            if x in keyed:
                return x
            for p in up[x]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)

    def dfs(n):
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x in keyed:
                return x
            if x not in seen:
                seen.add(x)
                todo += [p for p in up[x] if p not in seen]

    def walks(path):
        yield path[-1]
        for a, b, *_ in edges:
            if a == path[-1] and b not in path:
                yield from walks([*path, b])

    assert dict(traverse.nearest_key(roots, snap, "K").collect()) == {n: bfs(n) for n in names if bfs(n)}
    assert dict(traverse.first_key_depth_first(roots, snap, "K").collect()) == {n: dfs(n) for n in names if dfs(n)}
    want = Counter((n, x) for n in names for x in walks([n]) if x in hosts)
    assert {(r.root, r.node): int(r.times) for r in traverse.hosts_by_paths(roots, snap).collect()} == want
    below = {(r.root, r.node): r.depth for r in traverse.reach(roots, snap.edges).collect()}
    assert set(below) == {(n, x) for n in names for x in walks([n])}


def test_depth_without_end(spark):
    """A chain of 40 nodes, searched from its end: as far as it goes, by either order."""
    names = [f"c{k:03}" for k in range(40)]
    snap = snapshot(spark, names, [(a, b, 0, 0) for a, b in zip(names, names[1:], strict=False)], keyed=["c000"])
    root = each(spark, names[-1:])
    assert traverse.first_key_depth_first(root, snap, "K").collect() == [("c039", "c000")] == traverse.nearest_key(root, snap, "K").collect()


def test_paths_in_numbers(spark):
    """A ladder of 12 diamonds has 2 ** 12 ways down; four clusters in a ring and their own links end, too."""
    steps = 12
    names = [f"{x}{k}" for k in range(steps) for x in "jlr"] + [f"j{steps}"]
    edges = [e for k in range(steps) for e in ((f"j{k}", f"l{k}", 0, 0), (f"j{k}", f"r{k}", 1, 0), (f"l{k}", f"j{k + 1}", 0, 0), (f"r{k}", f"j{k + 1}", 0, 1))]
    ring = [f"w{k}" for k in range(4)]
    edges += [(a, b, k, k) for k, (a, b) in enumerate((a, b) for a in ring for b in ring if a != b)] + [(ring[0], "tip", 9, 9)]
    snap = snapshot(spark, [*names, *ring, "tip"], edges, hosts=[f"j{steps}", "tip"])
    got = {(r.root, r.node): int(r.times) for r in traverse.hosts_by_paths(each(spark, ["j0", "l11", *ring]), snap).collect()}
    others = 1 + 2 + 2  # from another cluster of the ring to the first one: at once, over one, over two others
    assert got == {("j0", f"j{steps}"): 2**steps, ("l11", f"j{steps}"): 1, ("w0", "tip"): 1, **{(w, "tip"): others for w in ring[1:]}}


def test_levels_and_cycles(spark):
    frame = lambda xs: spark.createDataFrame(xs, "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    levels = traverse.topological_levels(nodes, frame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "a")]))
    assert dict(levels.collect()) == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}
    assert dict(traverse.topological_levels(nodes, frame([("q", "r")])).collect()) == {"a": 0, "b": 0, "z": 0}
    for cycle in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "c"), ("c", "d"), ("d", "c")]):
        with pytest.raises(errors.GraphCycle):
            traverse.topological_levels(nodes, frame(cycle))
