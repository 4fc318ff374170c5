"""One query per operator over the sample topology, and the same rows in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshset.engine import Engine, changelist, version_before
from meshset.functions.context import Context
from meshset.functions.registry import builtin
from meshset.model import CLUSTER, ENVIRONMENT, HOST, LATEST, Snapshot, Topology, shared_dir
from meshset.operators import lookups, sets, strings, traverse
from meshset.operators.names import prefix, resolve, unprefix
from meshset.sources import cursor, sample, sinks
from meshset.sources.store import Store, build
from meshset.streaming.operators import fold, learned, read_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BASE = """
    cl AS (SELECT n_nationkey, r_name, r_name || '#' || n_name AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey),
    cu AS (SELECT customer.*, cluster, cluster || '.' || c_mktsegment AS segment FROM customer JOIN cl ON c_nationkey = n_nationkey),
    nodes AS (SELECT r_name AS name, 'ENVIRONMENT' AS type FROM region UNION ALL SELECT cluster, 'CLUSTER' FROM cl
              UNION ALL SELECT DISTINCT segment, 'CLUSTER' FROM cu UNION ALL SELECT s_name, 'HOST' FROM supplier
              UNION ALL SELECT c_name, 'HOST' FROM customer UNION ALL SELECT 'part#' || p_partkey, 'STRING' FROM part),
    edges AS (SELECT r_name AS src, cluster AS dst, CAST(n_nationkey AS BIGINT) AS fwd_ord, CAST(1 AS BIGINT) AS rev_ord FROM cl
              UNION ALL SELECT cluster, s_name, s_suppkey, 1 FROM supplier JOIN cl ON s_nationkey = n_nationkey
              UNION ALL SELECT DISTINCT cluster, segment, 1099511627776 + ascii(c_mktsegment), 1 FROM cu UNION ALL SELECT segment, c_name, c_custkey, 1 FROM cu
              UNION ALL SELECT cluster, c_name, 2199023255552 + c_custkey, 2 FROM cu WHERE c_custkey % 3 = 0
              UNION ALL SELECT DISTINCT cl.cluster, segment, 4398046511104 + ascii(c_mktsegment), 2 FROM cu JOIN cl ON cl.n_nationkey = c_nationkey + 1 WHERE cl.n_nationkey % 4 = 1),
    tags AS (SELECT c_name AS node, 'mktsegment' AS key, c_mktsegment AS value FROM customer
             UNION ALL SELECT cluster, 'nationkey', CAST(n_nationkey AS VARCHAR) FROM cl
             UNION ALL SELECT DISTINCT c_name, 'priority', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
             UNION ALL SELECT r_name, 'ADMIN_NODE', 'admin-' || lower(r_name) FROM region
             UNION ALL SELECT cluster, 'ADMIN_NODE', 'admin-' || n_nationkey FROM cl WHERE n_nationkey % 2 = 0)
"""
DOWN = """
    down AS (SELECT name AS root, name AS node, 0 AS depth FROM nodes WHERE type = 'ENVIRONMENT'
             UNION ALL SELECT root, dst, depth + 1 FROM down JOIN edges ON src = node)
"""
UP = """
    up AS (SELECT name AS root, name AS node, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM nodes WHERE type = 'HOST'
           UNION ALL SELECT root, src, depth + 1, list_append(path, rev_ord) FROM up JOIN edges ON dst = node)
"""


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL over the common tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {', '.join([BASE, *ctes])} {sql}" if ctes or "FROM" in sql else sql
        return f

    return add


def _snap(spark: SparkSession, sf_dir: str) -> Snapshot:
    return sample.load(spark, sf_dir).as_of()


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(sample.load(spark, sf_dir))


def _every(snap: Snapshot) -> DataFrame:
    return snap.nodes.select(F.col("name").alias("node"))


def _all(snap: Snapshot, *types: str) -> DataFrame:
    return snap.of_type(*types).select(F.col("value").alias("root"), F.col("value").alias("node"))


@query("SELECT DISTINCT cluster AS value FROM cl WHERE r_name = 'AFRICA' AND NOT regexp_matches(cluster, '_1') UNION SELECT dst FROM edges WHERE src IN (SELECT cluster FROM cl WHERE r_name = 'ASIA')")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("%AFRICA,-/_1/,%%ASIA")


@query("SELECT DISTINCT dst AS value FROM edges WHERE src IN (SELECT cluster FROM cl WHERE r_name = 'AFRICA')")
def expand_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("%%AFRICA")


@query("SELECT src AS value FROM edges WHERE dst IN (SELECT dst FROM edges WHERE src IN (SELECT cluster FROM cl WHERE r_name = 'AFRICA'))")
def get_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("*%%AFRICA")


@query("SELECT value FROM tags WHERE key = 'priority' AND node IN (SELECT c_name FROM cu WHERE segment = 'AFRICA#NATION_0.BUILDING')")
def key_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan('(%"AFRICA#NATION_0.BUILDING"):priority')


@query("SELECT DISTINCT node, key FROM tags")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return lookups.keys(snap, _every(snap))


@query("SELECT value FROM tags WHERE key = 'nationkey' AND node IN (SELECT cluster FROM cl WHERE r_name = 'ASIA')")
def key_expand_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("(%ASIA):nationkey")


@query("SELECT name AS value FROM nodes WHERE type = 'ENVIRONMENT'")
def all_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(spark, sf_dir).of_type(ENVIRONMENT)


@query("SELECT name AS value FROM nodes WHERE type = 'HOST'")
def all_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(spark, sf_dir).of_type(HOST)


def _bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statuses of orders with repeats, on both sides."""
    orders = sample.read(spark, sf_dir, "orders")
    side = lambda rest: orders.where(f"o_orderkey % 3 <> {rest}").select(F.concat("o_orderpriority", F.lit("/"), F.pmod("o_custkey", F.lit(100)).cast("string")).alias("value"))
    return side(0), side(1)


SIDES = """
    a AS (SELECT o_orderpriority || '/' || (o_custkey % 100) AS value FROM orders WHERE o_orderkey % 3 <> 0),
    b AS (SELECT o_orderpriority || '/' || (o_custkey % 100) AS value FROM orders WHERE o_orderkey % 3 <> 1)
"""


@query("SELECT value FROM a UNION SELECT value FROM b", SIDES)
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _bags(spark, sf_dir)
    return sets.union(a, b, distinct=True)


@query("SELECT value FROM (SELECT value, CAST(greatest(sum(l), sum(r)) AS BIGINT) AS n FROM (SELECT value, 1 AS l, 0 AS r FROM a UNION ALL SELECT value, 0, 1 FROM b) GROUP BY value), generate_series(1, n)", SIDES)
def multiset_union_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(*_bags(spark, sf_dir))


@query("SELECT value FROM a EXCEPT ALL SELECT value FROM b", SIDES)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_bags(spark, sf_dir))


@query("SELECT value FROM a INTERSECT ALL SELECT value FROM b", SIDES)
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersection(*_bags(spark, sf_dir))


@query("SELECT p_name AS value FROM part WHERE regexp_matches(p_name, '[[:lower:]]+ [bg]')")
def regex_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.matching(sample.read(spark, sf_dir, "part").select(F.col("p_name").alias("value")), "[[:lower:]]+ [bg]")


@query("SELECT p_name AS value FROM part WHERE NOT regexp_matches(p_name, '[[:lower:]]+ [bg]')")
def regex_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.matching(sample.read(spark, sf_dir, "part").select(F.col("p_name").alias("value")), "[[:lower:]]+ [bg]", keep=False)


@query("SELECT 'host' || lpad(CAST(i AS VARCHAR), 5, '0') || 'x' AS value FROM generate_series(7, 20000) AS t(i)")
def sequence_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.sequence(spark, "host7", "host20000x")


@query("SELECT 'host' || i AS value FROM generate_series(1000, 1099) AS t(i)")
def sequence_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.sequence(spark, "host1000", "99")


@query("SELECT r_name || '#NATION_' || i AS value FROM region, generate_series(0, 24) AS t(i)")
def brace_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = sample.read(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
    numbers = spark.range(25).select(F.col("id").cast("string").alias("value"))
    return strings.braces(regions, spark.createDataFrame([("#NATION_",)], "value string"), numbers)


@query("SELECT 'rack' || a || '-node' || lpad(CAST(b AS VARCHAR), 2, '0') AS value FROM (VALUES ('1'), ('2'), ('x')) v(a), generate_series(1, 12) AS t(b)")
def brace_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan('rack{1,2,x}"-node"{01..12}')


@query("SELECT r_name AS env, name AS node, r_name || '#' || name AS full_name FROM region, (SELECT DISTINCT n_name AS name FROM nation)")
def prefixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sample.read(spark, sf_dir, "nation").select(F.col("n_name").alias("node")).distinct()
    envs = F.broadcast(sample.read(spark, sf_dir, "region").select(F.col("r_name").alias("env")))
    return names.crossJoin(envs).withColumn("full_name", prefix(F.col("env"), F.col("node")))


@query("SELECT DISTINCT root AS env, node FROM down JOIN nodes ON node = name WHERE type = 'CLUSTER'", DOWN)
def all_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return traverse.all_clusters(_all(snap, ENVIRONMENT), snap).select(F.col("root").alias("env"), "node")


@query("SELECT CASE WHEN starts_with(node, root || '#') THEN node ELSE root || '#' || node END AS value FROM (SELECT DISTINCT root, node FROM down JOIN nodes ON node = name WHERE type = 'CLUSTER')", DOWN)
def all_clusters_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("all_clusters()")


@query("SELECT root AS env, node, count(*) AS times FROM down JOIN nodes ON node = name WHERE type = 'HOST' GROUP BY ALL", DOWN)
def expand_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return traverse.hosts_by_paths(_all(snap, ENVIRONMENT), snap).select(F.col("root").alias("env"), "node", F.col("times").cast("long").alias("times"))


@query("SELECT src AS value FROM edges WHERE dst IN (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)")
def clusters_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    bag = sample.read(spark, sf_dir, "supplier").select("s_name").union(sample.read(spark, sf_dir, "customer").select("c_name")).toDF("value")
    return builtin()["clusters"].plan(Context(snap, snap), [bag])


@query("SELECT type, name FROM nodes WHERE name NOT IN (SELECT node FROM down)", DOWN)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.orphans(_snap(spark, sf_dir))


@query(
    "SELECT root, array_to_string(path, '/') AS path, depth, node FROM t",
    "t AS (SELECT name AS root, [name] AS path, CAST(0 AS BIGINT) AS depth, name AS node FROM nodes WHERE type = 'ENVIRONMENT' UNION ALL SELECT root, list_append(path, dst), depth + 1, dst FROM t JOIN edges ON src = node WHERE NOT list_contains(path, dst))",
)
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return traverse.paths(_all(snap, ENVIRONMENT), snap).select("root", F.concat_ws("/", "path").alias("path"), "depth", "node")


@query("SELECT src AS node, dst AS child, fwd_ord AS ord FROM edges")
def simple_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return lookups.children(snap, _every(snap))


def _first(order: str) -> str:
    return f"SELECT root, node FROM (SELECT root, up.node, row_number() OVER (PARTITION BY root ORDER BY {order}) AS n FROM up JOIN (SELECT DISTINCT node FROM tags WHERE key = 'ADMIN_NODE') k ON k.node = up.node) WHERE n = 1"


#: Breadth first: nearest, then by the ordinals on the way; depth first: by ordinals on the way, last ones first.
NEAREST, DEEPEST = _first("depth, path"), _first("list_transform(path, lambda x: -x)")


@query(NEAREST, UP)
def bfs_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return traverse.nearest_key(_all(snap, HOST), snap, "ADMIN_NODE")


@query(DEEPEST, UP)
def dfs_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return traverse.first_key_depth_first(_all(snap, HOST), snap, "ADMIN_NODE")


@query(f"SELECT DISTINCT value FROM tags JOIN ({NEAREST}) x ON x.node = tags.node WHERE key = 'ADMIN_NODE'", UP)
def admin_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    found = traverse.nearest_key(_all(snap, HOST), snap, "ADMIN_NODE").select("node").distinct()
    return snap.tags.where("key = 'ADMIN_NODE'").join(found, "node", "left_semi").select("value").distinct()


@query(
    """SELECT a, b, coalesce(ancestor, '') AS ancestor, coalesce(distance, -1) AS distance FROM p LEFT JOIN (
         SELECT p.a, p.b, x.node AS ancestor, CAST(x.depth + y.depth AS BIGINT) AS distance,
                row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.depth + y.depth, x.node) AS n
         FROM p JOIN near x ON x.root = a JOIN near y ON y.root = b AND y.node = x.node) AS f USING (a, b) WHERE n = 1 OR n IS NULL""",
    UP,
    "near AS (SELECT root, node, min(depth) AS depth FROM up GROUP BY root, node)",
    "p AS (SELECT s_name AS a, c_name AS b FROM supplier JOIN customer ON s_suppkey % 1000 = c_custkey % 1000)",
)
def nearest_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = sample.read(spark, sf_dir, "supplier"), sample.read(spark, sf_dir, "customer")
    pairs = s.join(c, s.s_suppkey % 1000 == c.c_custkey % 1000).select(F.col("s_name").alias("a"), F.col("c_name").alias("b"))
    found = traverse.nearest_common_ancestor(pairs, _snap(spark, sf_dir))
    return found.fillna("", ["ancestor"]).fillna(-1, ["distance"])


DEPS = """
    dep AS (SELECT DISTINCT x.cluster AS src, y.cluster AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
            JOIN supplier ON l_suppkey = s_suppkey JOIN cl x ON x.n_nationkey = c_nationkey JOIN cl y ON y.n_nationkey = s_nationkey WHERE c_nationkey < s_nationkey)
"""


@query("SELECT node, max(level) AS level FROM lv GROUP BY node", DEPS, "lv AS (SELECT cluster AS node, CAST(0 AS BIGINT) AS level FROM cl UNION SELECT dst, level + 1 FROM lv JOIN dep ON src = node)")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sample.load(spark, sf_dir)
    clusters = t.as_of().edges.join(t.as_of().of_type(ENVIRONMENT), F.col("src") == F.col("value"), "left_semi").select(F.col("dst").alias("node"))
    return traverse.topological_levels(clusters, sample.dependency_edges(spark, sf_dir))


@query("SELECT src, dst FROM dep WHERE src IN (SELECT cluster FROM cl WHERE r_name = 'ASIA')", DEPS)
def dependency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = sample.load(spark, sf_dir, dependencies=True).as_of(None, "dependency")
    of = snap.nodes.where("startswith(name, 'ASIA#')").select(F.col("name").alias("node"))
    return lookups.children(snap, of).select(F.col("node").alias("src"), F.col("child").alias("dst"))


SCD = f"""
    iv AS (SELECT user_id, event_id AS valid_from, coalesce(nx, {LATEST}) AS valid_to FROM (
             SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx
             FROM events WHERE event_type IN ('signup', 'error')) WHERE event_type = 'signup')
"""


def _users(spark: SparkSession, sf_dir: str) -> Topology:
    return build(sample.event_log(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS name, valid_from, valid_to FROM iv", SCD)
def scd_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).nodes.select("name", "valid_from", "valid_to")


@query("SELECT CAST(user_id AS VARCHAR) AS name, 'HOST' AS type FROM iv WHERE valid_from <= 5000 AND 5000 < valid_to", SCD)
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).as_of(5000).nodes


@query(
    "SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b USING (name) WHERE a.name IS NULL OR b.name IS NULL",
    SCD,
    *(f"{x} AS (SELECT CAST(user_id AS VARCHAR) AS name FROM iv WHERE valid_from <= {v} AND {v} < valid_to)" for x, v in (("a", 2000), ("b", 8000))),
)
def history_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _users(spark, sf_dir)
    before, after = (t.as_of(v).nodes.select("name") for v in (2000, 8000))
    gone, new = before.join(after, "name", "left_anti"), after.join(before, "name", "left_anti")
    return new.select("name", F.lit("added").alias("change")).unionByName(gone.select("name", F.lit("removed").alias("change")))


@query("SELECT max(event_id) AS version FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
def version_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sample.read(spark, sf_dir, "events").select(F.col("event_id").alias("version"), "ts")
    return version_before(log, datetime(2024, 1, 10))


@query("SELECT node, key, string_agg(value, ',' ORDER BY value) AS vals FROM tags GROUP BY node, key")
def node_tags_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return lookups.tag_lists(snap, _every(snap)).select("node", "key", F.concat_ws(",", "values").alias("vals"))


TREES = """
    tj AS (SELECT node, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT node, '"' || key || '":["' || string_agg(value, '","' ORDER BY value) || '"]' AS t FROM tags GROUP BY node, key) GROUP BY node),
    dj AS (SELECT src, '["' || string_agg(dst, '","' ORDER BY n_nationkey) || '"]' AS deps FROM dep JOIN cl ON cluster = dst GROUP BY src),
    head AS (SELECT name, type, '{"type":"' || type || '","name":"' || name || '","tags":{' || coalesce(tags, '') || '},"dependencies":' || coalesce(deps, '[]') || ',"children":{' AS head
             FROM nodes LEFT JOIN tj ON tj.node = name LEFT JOIN dj ON dj.src = name),
    hostj AS (SELECT name, head || '}}' AS json FROM head WHERE type = 'HOST'),
    segj AS (SELECT h.name, any_value(head) || string_agg('"' || dst || '":' || json, ',' ORDER BY '"' || dst || '":' || json) || '}}' AS json
             FROM head h JOIN edges ON src = h.name JOIN hostj ON hostj.name = dst WHERE h.name IN (SELECT segment FROM cu) GROUP BY h.name),
    under AS (SELECT * FROM hostj UNION ALL SELECT * FROM segj),
    natj AS (SELECT h.name, any_value(head) || coalesce(string_agg('"' || dst || '":' || json, ',' ORDER BY '"' || dst || '":' || json), '') || '}}' AS json
             FROM head h LEFT JOIN edges ON src = h.name LEFT JOIN under ON under.name = dst WHERE h.name IN (SELECT cluster FROM cl) GROUP BY h.name)
"""


@query("SELECT name AS root, json FROM segj UNION ALL SELECT name, json FROM natj", DEPS, TREES)
def expand_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sample.load(spark, sf_dir, dependencies=True)
    snap = t.as_of()
    return traverse.tree_json(_all(snap, CLUSTER), snap, t.as_of(None, "dependency").edges, F.col("node"))


@query("SELECT l_orderkey AS proposal, count(DISTINCT l_suppkey % 7) AS votes FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey % 7) >= 4")
def learner_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order are votes of seven accepters, some of which vote again."""
    votes = sample.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal"), (F.col("l_suppkey") % 7).alias("accepter"))
    return learned(votes, accepters=6)


@query("""SELECT '"' || src || '" -> "' || dst || '";' AS line FROM edges""")
def dot_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot_lines(_snap(spark, sf_dir))


@query("""SELECT '"' || src || '" -> "' || dst || '";' AS line FROM dep""", DEPS)
def dot_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot_lines(sample.load(spark, sf_dir, dependencies=True).as_of(None, "dependency"))


@query("SELECT src AS node, type, dst AS child, fwd_ord AS ord FROM edges JOIN nodes ON dst = name")
def node_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return lookups.typed_children(snap, _every(snap))


@query("SELECT name, type FROM nodes WHERE name > 'Customer#000000007' ORDER BY name LIMIT 50")
def cursor_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.page(_snap(spark, sf_dir), 50, after="Customer#000000007")


@query("SELECT name, type FROM nodes WHERE name < 'Supplier#000000007' ORDER BY name DESC LIMIT 50")
def cursor_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.page(_snap(spark, sf_dir), 50, before="Supplier#000000007")


@query("SELECT type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', count(*) FROM edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(spark, sf_dir).counts()


@query("SELECT DISTINCT 'primary' AS graph FROM nodes UNION SELECT DISTINCT 'dependency' FROM cl")
def graph_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.load(spark, sf_dir, dependencies=True).graphs()


@query("SELECT node, value, CAST(substr(value, 1, 1) AS BIGINT) AS ord FROM tags WHERE key = 'priority'")
def fetch_key_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return lookups.values(snap, _every(snap), "priority")


@query("SELECT dst AS node, src AS parent, rev_ord AS ord FROM edges")
def direct_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return lookups.parents(snap, _every(snap))


@query("SELECT CASE WHEN starts_with(dst, 'AFRICA#') THEN substr(dst, 8) ELSE dst END AS value FROM edges WHERE src = 'AFRICA#NATION_0'")
def environment_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("%NATION_0", "AFRICA")


@query("SELECT CASE WHEN starts_with(cluster, 'AFRICA#') THEN substr(cluster, 8) ELSE cluster END AS value FROM cl")
def unprefixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(spark, sf_dir).of_type(ENVIRONMENT, CLUSTER).where("value like '%#%' and value not like '%.%'").select(unprefix(F.col("value"), "AFRICA").alias("value"))


@query("SELECT n_name AS value, CASE WHEN r_name = 'AFRICA' THEN 'AFRICA#' || n_name END AS node FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sample.read(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    return resolve(names, _snap(spark, sf_dir), "AFRICA", strict=False)


@query("SELECT cluster AS value FROM cl WHERE r_name = 'AFRICA' AND NOT regexp_matches(cluster, '_[12]')")
def regex_keep_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("%AFRICA,&!/_[12]/")


@query("SELECT cluster AS value FROM cl WHERE r_name = 'AFRICA' AND regexp_matches(cluster, '_[12]')")
def regex_drop_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("%AFRICA,-!/_[12]/")


@query("SELECT key AS value FROM (SELECT DISTINCT node, key FROM tags WHERE node IN (SELECT cluster FROM cl WHERE r_name = 'ASIA'))")
def key_names_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("(%ASIA):KEYS")


@query("SELECT DISTINCT value FROM tags WHERE key = 'ADMIN_NODE' AND node IN (SELECT CASE WHEN n_nationkey % 2 = 0 THEN cluster ELSE r_name END FROM cl WHERE r_name = 'AFRICA')")
def admin_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("^%AFRICA")


@query("SELECT cluster AS value FROM cl WHERE n_nationkey IN (3, 4)")
def has_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("has(nationkey; {3,4})")


@query("SELECT DISTINCT key AS value FROM tags WHERE node = 'AFRICA#NATION_0' AND value = '0'")
def mem_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan('mem("AFRICA#NATION_0"; 0)')


@query("SELECT node AS value FROM down JOIN nodes ON node = name WHERE type = 'HOST' AND root IN ('ASIA', 'AFRICA')", DOWN)
def expand_hosts_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).plan("expand_hosts(ASIA,AFRICA)")


@query("SELECT root, node, CAST(depth AS BIGINT) AS depth FROM down WHERE depth <= 1", DOWN)
def tree_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    return traverse.paths(_all(snap, ENVIRONMENT), snap, max_depth=1).select("root", "node", "depth")


@query("SELECT DISTINCT root AS host, node AS env FROM up JOIN nodes ON node = name WHERE type = 'ENVIRONMENT'", UP)
def host_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _snap(spark, sf_dir)
    above = traverse.reach(_all(snap, HOST), snap.edges, down=False)
    return above.join(snap.of_type(ENVIRONMENT), F.col("node") == F.col("value"), "left_semi").select(F.col("root").alias("host"), F.col("node").alias("env"))


@query("""SELECT 'subgraph "cluster_' || src || '" { ' || string_agg('"' || dst || '";', ' ' ORDER BY dst) || ' }' AS line FROM edges JOIN nodes ON src = name WHERE type = 'CLUSTER' GROUP BY src""")
def dot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot_cluster_lines(_snap(spark, sf_dir))


@query("SELECT event_id AS version, event_type AS graph, event_id AS graph_version FROM events")
def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sample.read(spark, sf_dir, "events").select(F.col("event_id").alias("version"), "ts", F.col("event_type").alias("graph"))
    return changelist(log.select("version", "ts"), log.select("version", "graph")).select("version", F.explode("graphs").alias("graph", "graph_version"))


_stores: dict[tuple[str, str], tuple[Store, int, list]] = {}


def _store(spark: SparkSession, sf_dir: str) -> tuple[Store, int, list]:
    """A store that got the sample's requests, the version after those that build, and what became of each; once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
        first, then = sample.requests(sample.nations_of(spark, sf_dir))
        done = store.apply(first)
        built = store.range_version()
        _stores[key] = store, built, done + store.apply(then)
    return _stores[key]


def _graphs(t: Topology, version: int | None = None) -> dict[str, Snapshot]:
    return {g: t.as_of(version, g) for g in ("primary", "dependency")}


def _named(rows: dict[str, DataFrame]) -> DataFrame:
    """Rows of several graphs with the graph's name."""
    a, b = (df.withColumn("graph", F.lit(g)) for g, df in rows.items())
    return a.unionByName(b)


BUILT = """
    k AS (SELECT n_nationkey AS k, n_name AS n, r_name AS r, r_name || '#' || n_name AS c, lead(r_name || '#' || n_name) OVER (ORDER BY n_nationkey) AS nx FROM nation JOIN region ON n_regionkey = r_regionkey),
    gs AS (SELECT 'primary' AS graph UNION ALL SELECT 'dependency')
"""
ALL_NODES = """
    an AS (SELECT DISTINCT r AS name, 'ENVIRONMENT' AS type FROM k UNION ALL SELECT c, 'CLUSTER' FROM k UNION ALL SELECT c || '-a', 'CLUSTER' FROM k UNION ALL SELECT c || '-b', 'CLUSTER' FROM k
           UNION ALL SELECT 'host' || k, 'HOST' FROM k UNION ALL SELECT 'spare' || k, 'HOST' FROM k)
"""
LEFT = """
    ln AS (SELECT DISTINCT r AS name, 'ENVIRONMENT' AS type FROM k WHERE r <> (SELECT max(r) FROM k) UNION ALL SELECT c, 'CLUSTER' FROM k UNION ALL SELECT c || '-a', 'CLUSTER' FROM k
           UNION ALL SELECT c || '-b', 'CLUSTER' FROM k WHERE k % 7 <> 0 UNION ALL SELECT 'host' || k, 'HOST' FROM k UNION ALL SELECT 'spare' || k, CASE WHEN k % 12 = 1 THEN 'STRING' ELSE 'HOST' END FROM k WHERE k % 4 <> 0),
    le AS (SELECT 'primary' AS graph, r AS src, c AS dst FROM k WHERE r <> (SELECT max(r) FROM k) AND k % 8 <> 0 UNION ALL SELECT 'primary', c, c || '-a' FROM k WHERE k % 5 <> 0
           UNION ALL SELECT 'primary', c, c || '-b' FROM k WHERE k % 7 <> 0 UNION ALL SELECT 'primary', c || '-a', 'host' || k FROM k UNION ALL SELECT 'primary', c || '-b', 'host' || k FROM k WHERE k % 3 <> 0 AND k % 7 <> 0
           UNION ALL SELECT 'dependency', c, c || '-a' FROM k WHERE k % 2 = 0 UNION ALL SELECT 'dependency', c, nx FROM k WHERE nx IS NOT NULL AND k % 10 <> 3),
    lt AS (SELECT c AS node, 'rack' AS key, CASE WHEN k % 9 = 0 THEN 'new' || k ELSE 'r' || k END AS value FROM k WHERE k % 6 <> 0 UNION ALL SELECT c, 'rack', 'common' FROM k WHERE k % 6 <> 0 AND k % 2 <> 0)
"""


@query("SELECT graph, name, type FROM an, gs", BUILT, ALL_NODES)
def store_nodes_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, built, _ = _store(spark, sf_dir)
    return _named({g: s.nodes for g, s in _graphs(store.topology(), built).items()})


@query("SELECT graph, name, type FROM ln, gs", BUILT, LEFT)
def store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named({g: s.nodes for g, s in _graphs(_store(spark, sf_dir)[0].topology()).items()})


@query("SELECT graph, src, dst FROM le", BUILT, LEFT)
def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named({g: s.edges.select("src", "dst") for g, s in _graphs(_store(spark, sf_dir)[0].topology()).items()})


@query("SELECT node, key, value FROM lt", BUILT, LEFT)
def store_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = _store(spark, sf_dir)[0].topology().as_of()
    return lookups.tags(snap, _every(snap)).where("value is not null").select("node", "key", "value")


@query("SELECT c AS node, CASE WHEN k % 6 = 0 THEN 'none' WHEN k % 9 = 0 AND k % 2 <> 0 THEN 'common,new' || k WHEN k % 9 = 0 THEN 'new' || k WHEN k % 2 <> 0 THEN 'r' || k || ',common' ELSE 'r' || k END AS vals FROM k", BUILT)
def store_tag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stand in the order in which they came; an updated one comes last."""
    snap = _store(spark, sf_dir)[0].topology().as_of()
    of = snap.of_type(CLUSTER).where("value not like '%-_'").select(F.col("value").alias("node"))
    return of.join(lookups.tag_lists(snap, of), "node", "left").select("node", F.when(F.col("key").isNull(), "none").otherwise(F.concat_ws(",", "values")).alias("vals"))


COUNTS = """
    n AS (SELECT 'create_env' AS method, count(DISTINCT r) AS n FROM k UNION ALL SELECT 'create_graph', 1 UNION ALL SELECT 'remove_env', 1
          UNION ALL SELECT m, count(*) * f FROM k, (VALUES ('add_cluster_to_env', 1), ('add_cluster_to_cluster', 2), ('add_host_to_cluster', 2), ('add_host', 1), ('add_node_key_value', 2), ('add_node_env_dependency', 1)) v(m, f) GROUP BY m, f
          UNION ALL SELECT 'add_node_ext_dependency', count(nx) FROM k
          UNION ALL SELECT m, count(*) FROM k, (VALUES ('remove_node_key_value', 2), ('remove_host_from_cluster', 3), ('remove_host', 4), ('remove_cluster_from_cluster', 5), ('remove_key_from_node', 6), ('remove_cluster', 7), ('remove_cluster_from_env', 8)) v(m, f) WHERE k % f = 0 GROUP BY m
          UNION ALL SELECT 'update_tag', count(*) FROM k WHERE k % 9 = 0 AND k % 6 <> 0 UNION ALL SELECT 'remove_node_env_dependency', count(*) FROM k WHERE k % 2 = 1
          UNION ALL SELECT 'remove_node_ext_dependency', count(*) FROM k WHERE k % 10 = 3 UNION ALL SELECT 'set_type', count(*) FROM k WHERE k % 12 = 1)
"""


@query("SELECT method, CAST(n AS BIGINT) AS n FROM n WHERE n > 0", BUILT, COUNTS)
def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[0].log().groupBy("method").agg(F.count("*").alias("n"))


@query("SELECT 'create_env' AS method, 'CreateNode' AS error, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'update_tag', 'NodeNotFound', count(*) FROM k WHERE k % 9 = 0 AND k % 6 = 0", BUILT)
def store_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.method, type(r.error).__name__) for r in _store(spark, sf_dir)[2] if r.error]
    return spark.createDataFrame(rows, "method string, error string").groupBy("method", "error").agg(F.count("*").alias("n"))


@query("SELECT graph FROM gs UNION ALL SELECT 'archive'", BUILT)
def store_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[0].graphs()


@query("SELECT type, name FROM ln WHERE name NOT IN (SELECT node FROM dn)", BUILT, LEFT, "dn AS (SELECT name AS node FROM ln WHERE type = 'ENVIRONMENT' UNION SELECT dst FROM dn JOIN le ON src = node WHERE graph = 'primary')")
def store_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.orphans(_store(spark, sf_dir)[0].topology().as_of())


@query("SELECT CAST(sum(n) AS BIGINT) AS version FROM n", BUILT, COUNTS)
def store_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_before(_store(spark, sf_dir)[0].log(), datetime(9999, 1, 1))


@query("SELECT graph, name, type FROM ln, gs", BUILT, LEFT)
def store_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed into a store that held something else before, which is left out here."""
    store = _store(spark, sf_dir)[0]
    copy = Store(spark, f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}")
    copy.write("add_host", "elsewhere")
    fold(read_log(spark, store.folder("log")), copy, f"{copy.path}-progress", "first store").awaitTermination()
    return _named({g: s.nodes.where("name <> 'elsewhere'") for g, s in _graphs(copy.topology()).items()})


@query("SELECT graph, src, dst FROM le", BUILT, LEFT)
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the store, compacted and pruned of the first half of its log: its effects stay."""
    store, built, _ = _store(spark, sf_dir)
    copy = Store(spark, f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}")
    fold(read_log(spark, store.folder("log")), copy, f"{copy.path}-progress").awaitTermination()
    copy.compact()
    copy.prune(built)
    return _named({g: s.edges.select("src", "dst") for g, s in _graphs(copy.topology()).items()})
