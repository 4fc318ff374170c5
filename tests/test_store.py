"""Writes, time travel, replay and votes: a generated library of shelves against a plain model of the rules."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meshset import errors
from meshset.engine import Engine
from meshset.functions import timespec
from meshset.sources.store import Request, Store
from meshset.streaming.operators import fold, learned, read_log


class Plain:
    """The state after each write, as sets and lists in the order of arrival; a tag's value that comes again takes its old place."""

    def __init__(self):
        self.types, self.children, self.tags, self.deps, self.first = {}, {}, {}, {}, {}

    def tag(self, name, value):
        values = self.tags.setdefault((name, "topic"), [])
        self.first.setdefault((name, value), len(self.first))
        values.append(value)
        values.sort(key=lambda v: self.first[name, v])

    def link(self, a, b):
        self.children.setdefault(a, []).append(b)

    def drop(self, name):
        self.types.pop(name)
        self.children.pop(name, None)
        self.tags = {k: v for k, v in self.tags.items() if k[0] != name}
        for ends in (self.children, self.deps):
            ends.pop(name, None)
            for v in ends.values():
                v[:] = [x for x in v if x != name]

    def picture(self):
        return dict(self.types), {k: list(v) for k, v in self.children.items() if v}, {k: list(v) for k, v in self.tags.items()}, {k: list(v) for k, v in self.deps.items() if v}


def scenario(rnd, model, n):
    """Requests that all hold, each after the model has moved on, with the picture after each."""
    out = []
    envs, shelves, books = ["attic", "cellar"], [f"shelf{k}" for k in range(5)], [f"book{k}" for k in range(6)]
    while len(out) < n:
        e, a, b, h, v = rnd.choice(envs), rnd.choice(shelves), rnd.choice(shelves), rnd.choice(books), f"v{rnd.randrange(3)}"
        top, low, kids = f"{e}#{a}", f"{e}#{b}", lambda x: model.children.get(x, [])
        t = model.types
        homes = [p for p, cs in model.children.items() if h in cs]
        moves = {
            ("create_env", e): (e not in t, lambda: t.update({e: "ENVIRONMENT"})),
            ("add_cluster_to_env", e, a): (e in t and top not in kids(e), lambda: (t.update({top: "CLUSTER"}), model.link(e, top))),
            ("remove_cluster_from_env", e, a): (e in t and top in kids(e), lambda: model.children[e].remove(top)),
            ("add_cluster_to_cluster", e, a, b): (top in t and a < b and low not in kids(top), lambda: (t.update({low: "CLUSTER"}), model.link(top, low))),
            ("remove_cluster_from_cluster", e, a, b): (low in kids(top), lambda: model.children[top].remove(low)),
            ("remove_cluster", e, a): (top in t and rnd.random() < 0.2, lambda: model.drop(top)),
            ("add_host_to_cluster", e, a, h): (top in t and h not in kids(top) and all(p.startswith(e) for p in homes), lambda: (t.update({h: "HOST"}), model.link(top, h))),
            ("remove_host_from_cluster", e, a, h): (h in kids(top), lambda: model.children[top].remove(h)),
            ("add_host", h): (h not in t, lambda: t.update({h: "HOST"})),
            ("remove_host", e, h): (h in t and not homes, lambda: model.drop(h)),
            ("add_node_key_value", e, a, "topic", v): (top in t and v not in model.tags.get((top, "topic"), []), lambda: model.tag(top, v)),
            ("remove_node_key_value", e, a, "topic", v): (v in model.tags.get((top, "topic"), []), lambda: model.tags[top, "topic"].remove(v)),
            ("remove_key_from_node", e, a, "topic"): ((top, "topic") in model.tags and rnd.random() < 0.4, lambda: model.tags.pop((top, "topic"))),
            ("update_tag", e, a, "topic", v, "new"): (v in model.tags.get((top, "topic"), []) and "new" not in model.tags[top, "topic"], lambda: (model.tags[top, "topic"].remove(v), model.tag(top, "new"))),
            ("add_node_env_dependency", e, a, b): (top in t and low in t and low not in model.deps.get(top, []), lambda: model.deps.setdefault(top, []).append(low)),
            ("remove_node_env_dependency", e, a, b): (low in model.deps.get(top, []), lambda: model.deps[top].remove(low)),
            ("remove_env", e): (e in t and rnd.random() < 0.05, lambda: model.drop(e)),
        }
        (method, *args), (holds, move) = rnd.choice(list(moves.items()))
        if holds:
            move()
            out.append(((method, tuple(args)), model.picture()))
    return out


def seen(engine, version=None):
    """The picture that the engine's tables give."""
    snap, dep = engine.snapshot(version), engine.snapshot(version, "dependency")

    def lists(rows):
        out = {}
        for a, b, _ in sorted(map(tuple, rows), key=lambda r: (r[0], r[2])):
            out.setdefault(a, []).append(b)
        return out

    tags = {}
    for n, k, v, _ in sorted(map(tuple, snap.tags.select("node", "key", "value", "val_ord").collect()), key=lambda r: r[3]):
        tags.setdefault((n, k), []).extend([] if v is None else [v])
    return dict(map(tuple, snap.nodes.collect())), lists(snap.edges.select("src", "dst", "fwd_ord").collect()), tags, lists(dep.edges.select("src", "dst", "fwd_ord").collect())


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    steps = scenario(random.Random(4), Plain(), 160)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    for k in range(0, len(steps), 60):
        assert not [r for r in store.apply([w for w, _ in steps[k : k + 60]]) if r.error]
    return Engine(store=store), [p for _, p in steps]


def test_versions(told):
    """Edges and dependencies come back last when removed and added again, values at their old place, at every version looked at."""
    engine, pictures = told
    assert engine.range_version() == len(pictures)
    for v in (1, 30, 75, 120, len(pictures)):
        assert seen(engine, v) == pictures[v - 1], v
    assert seen(engine) == pictures[-1] and seen(engine, 0) == ({}, {}, {}, {})
    assert engine.get_changelist().count() == len(pictures) and engine.store.corrupt().count() == 0


def test_replay_into_a_store_in_use(told, spark, tmp_path):
    """The target had writes of its own; times, clients and numbers stay, redelivery and refused requests do no harm."""
    engine, pictures = told
    log = engine.store.log()
    old = log.withColumn("ts", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("version"))).withColumn("client_id", F.lit("far"))
    for part in ("version <= 70", "version > 70"):
        old.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "old"))
    copy = Store(spark, str(tmp_path / "copy"))
    copy.write("add_host", "book0")
    copy.write("remove_host", "", "book0")
    copy.write("create_env", "garden")
    for again in ("one", "two"):
        fold(read_log(spark, str(tmp_path / "old"), 1), copy, str(tmp_path / again)).awaitTermination()
    both = Engine(store=copy)
    nodes, children, tags, deps = seen(both)
    assert nodes.pop("garden") == "ENVIRONMENT" and (nodes, children, tags, deps) == pictures[-1]
    rows = copy.log().where("source = 'log'").select("request_id", "client_id", "ts").collect()
    assert {r.client_id for r in rows} == {"far"} and sorted(r.request_id for r in rows) == list(range(1, len(pictures) + 1))
    assert both.get_range_version("2020-01-01 00:01:00") == 3 + 59 and both.get_range_version("2019-12-31") is None
    with pytest.raises(Exception, match="come after"):
        later = Store(spark, str(tmp_path / "later"))
        later.apply([Request("create_env", ("loft",), None, "far", 9)], source="log")
        fold(read_log(spark, str(tmp_path / "old")), later, str(tmp_path / "three")).awaitTermination()
    # what the target refuses is remembered, and not tried again when it would hold
    refusing = Store(spark, str(tmp_path / "refusing"))
    refusing.write("create_env", "attic")
    asked = [Request("create_env", ("attic",), None, "far", 1), Request("create_env", ("loft",), None, "far", 2), Request("create_env", ("loft",), None, "far", 3)]
    assert [type(r.error).__name__ for r in refusing.apply(asked, source="far")] == ["CreateNode", "NoneType", "CreateNode"]
    assert sorted(r.request_id for r in refusing.refused().collect()) == [1, 3] and refusing.range_version() == 2


def test_compact_and_prune(told, spark, tmp_path):
    engine, pictures = told
    copy = Store(spark, str(tmp_path / "copy"))
    fold(read_log(spark, engine.store.folder("log")), copy, str(tmp_path / "done")).awaitTermination()
    copy.compact()
    last = len(pictures)
    assert seen(Engine(store=copy), 75) == pictures[74] and copy.log().count() == last
    copy.prune(100)
    assert [copy.log().agg(F.min("version")).first()[0], copy.range_version()] == [100, last] and seen(Engine(store=copy)) == pictures[-1]
    reader = Store(spark, copy.path)
    assert seen(Engine(store=reader), 130) == pictures[129] and reader.write("add_host", "late") == last + 1
    copy.prune(10**6)
    assert copy.log().count() == 0 and copy.range_version() == last + 1 and copy.write("add_host", "later") == last + 2


def test_refusals(spark, tmp_path):
    e = Engine(store=Store(spark, str(tmp_path / "s")))
    setup = [("create_env", ("sea",)), ("create_env", ("sky",)), ("add_cluster_to_env", ("sea", "reef")), ("add_host_to_cluster", ("sea", "reef", "crab")), ("add_node_key_value", ("sea", "reef", "k", "v")), ("add_cluster_to_env", ("sky", "nest"))]
    e.store.transaction(setup)
    version = e.range_version()
    bad = [
        (errors.CreateNode, "create_env", "sea"), (errors.NodeNotFound, "remove_env", "moon"), (errors.NodeExists, "add_cluster_to_env", "sea", "reef"), (errors.InvalidEnvironment, "add_cluster_to_env", "moon", "reef"),
        (errors.NodeNotFound, "remove_cluster_from_env", "sky", "reef"), (errors.NodeExists, "add_host_to_cluster", "sea", "reef", "crab"),
        (errors.InvalidEnvironment, "add_host_to_cluster", "sky", "nest", "crab"), (errors.NodeExists, "add_node_key_value", "sea", "reef", "k", "v"), (errors.NodeNotFound, "remove_node_key_value", "sea", "reef", "k", "w"),
        (errors.EdgeNotFound, "remove_key_from_node", "sea", "reef", "q"), (errors.InvalidEnvironment, "remove_host", "sky", "crab"), (errors.IncorrectNumberOfArguments, "add_host"), (errors.IncorrectNumberOfArguments, "paint", "x"),
        (errors.IncorrectNodeType, "set_type", "sea", "reef", "FISH"), (errors.NodeExists, "create_graph", "primary"), (errors.EdgeNotFound, "remove_node_env_dependency", "sea", "reef", "crab"), (errors.NodeNotFound, "update_tag", "sea", "reef", "k", "w", "x"),
    ]
    for error, method, *args in bad:
        with pytest.raises(error):
            e.store.write(method, *args)
    with pytest.raises(errors.CreateNode):
        e.store.transaction([("add_host", ("eel",)), ("create_env", ("sea",))])
    assert e.range_version() == version and e.all_hosts() == ["crab"]
    assert e.bulk_edit([("add_host", ("eel",)), ("add_host", ("eel",))])["failed"] == [("add_host", ("eel",), "NodeExists")]
    e.set_type("sea", "reef", "STRING")
    assert e.counts() == {"ENVIRONMENT": 2, "CLUSTER": 1, "STRING": 1, "HOST": 2, "edges": 3} and e.fetch_key("sea", "reef", "k", version) == ["v"]
    e.create_graph("drafts")
    assert sorted(r[0] for r in e.store.graphs().collect()) == ["dependency", "drafts", "primary"]
    e.add_node_ext_dependency("sky", "nest", "sea", "crab")
    assert e.dependencies("sky", "nest") == ["crab"]
    e.remove_node_ext_dependency("sky", "nest", "sea", "crab")
    assert e.dependencies("sky", "nest") == [] and e.get_range_version("tomorrow") == e.range_version() and e.get_range_version("yesterday") is None
    assert [r.version for r in e.store.find(e.range_version()).collect()] == [e.range_version()]


def test_checksums(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("create_env", "sea")
    store.log().withColumn("args", F.array(F.lit("sky"))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="CorruptLog|versions"):
        fold(read_log(spark, str(tmp_path / "bad")), Store(spark, str(tmp_path / "t")), str(tmp_path / "c")).awaitTermination()


def test_timespec():
    now = datetime(2024, 3, 10, 12, tzinfo=UTC)  # a Sunday
    at = lambda *x: datetime(*x, tzinfo=UTC)
    cases = {
        "now - 4 days": at(2024, 3, 6, 12), "3 hours ago": at(2024, 3, 10, 9), "yesterday": at(2024, 3, 9, 12), "2023-07-08 09:10:11": at(2023, 7, 8, 9, 10, 11), "@86400": at(1970, 1, 2), "next month": at(2024, 4, 10, 12),
        "yesterday 14:30": at(2024, 3, 9, 14, 30), "next friday": at(2024, 3, 15), "last friday": at(2024, 3, 8), "sunday": at(2024, 3, 10), "next sunday": at(2024, 3, 17), "5 March": at(2024, 3, 5), "Mar 5, 2023 3pm": at(2023, 3, 5, 15),
        "noon tomorrow": at(2024, 3, 11, 12), "12/25": at(2024, 12, 25), "10:00 -0500": at(2024, 3, 10, 15), "2024-01-02 10:00 +0200": at(2024, 1, 2, 8), "monday 6:15pm": at(2024, 3, 11, 18, 15),
    }
    assert {t: timespec.parse(t, now) for t in cases} == cases
    for bad in ("", "soon", "5 parsecs", "25:00", "31 feb", "13pm"):
        with pytest.raises(errors.InvalidTimespec):
            timespec.parse(bad, now)


def test_quorum(spark):
    votes = [(p, f"x{k}") for p, n in (("a", 3), ("b", 2), ("c", 5)) for k in range(n)] + [("b", "x0")] * 4
    assert sorted(map(tuple, learned(spark.createDataFrame(votes, "proposal string, accepter string"), 5).collect())) == [("a", 3), ("c", 5)]


def test_votes_on_a_stream(spark, tmp_path):
    """Three of five across the turn of a minute, spread over batches; a repeated vote doesn't count; a late one comes to nothing."""
    schema = "proposal long, accepter string, ts timestamp"
    t = lambda m, s: datetime(2024, 5, 1, 10, m, s)
    batches = [
        [(1, "a", t(0, 58)), (1, "b", t(0, 59)), (2, "a", t(0, 10)), (2, "a", t(0, 11))], [(1, "c", t(1, 1)), (2, "a", t(1, 2)), (2, "b", t(1, 5))], [(1, "d", t(1, 20)), (3, "a", t(9, 0))],
        [(9, "z", t(20, 0))], [(9, "z", t(20, 1))], [(3, "b", t(20, 2)), (3, "c", t(20, 3)), (4, "a", t(20, 4)), (4, "b", t(20, 5)), (4, "c", t(20, 6)), (4, "c", t(20, 6))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "votes"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "votes"))
        learned(stream, 5, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 3), (4, 3)]
