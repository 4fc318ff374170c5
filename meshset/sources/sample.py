"""The star-schema tables as a topology: regions, nations, segments, suppliers and customers; parts are orphans.

It is no tree: every third customer is also in the cluster of its nation, and every
fourth nation also holds the segments of the nation before it, which may lie in
another region.  Reverse ordinals put a node's own segment or nation first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshset.model import CLUSTER, ENVIRONMENT, HOST, LATEST, STRING, Topology

SEGMENT_ORD, SECOND_ORD, SHARED_ORD = 1 << 40, 1 << 41, 1 << 42


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, dependencies: bool = False) -> Topology:
    """One version of everything.  Ordinals are keys, so nothing needs numbering."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    supplier, customer = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    cluster = F.concat("r_name", F.lit("#"), "n_name")
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", cluster.alias("cluster"))
    few = F.broadcast(nations)  # 25 rows at any scale
    sup = supplier.join(few, F.col("s_nationkey") == F.col("n_nationkey"))
    cus = customer.join(few, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("segment", F.concat("cluster", F.lit("."), "c_mktsegment"))
    segments = cus.select("cluster", "segment").distinct()
    node = lambda df, c, kind: df.select(F.col(c).alias("name"), F.lit(kind).alias("type"))
    primary = [
        node(region, "r_name", ENVIRONMENT), node(nations, "cluster", CLUSTER), node(segments, "segment", CLUSTER),
        node(supplier, "s_name", HOST), node(customer, "c_name", HOST), node(read(spark, sf_dir, "part").withColumn("n", F.concat(F.lit("part#"), F.col("p_partkey").cast("string"))), "n", STRING),
    ]
    edge = lambda df, a, b, o, back=1: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), o.cast("long").alias("fwd_ord"), F.lit(back).cast("long").alias("rev_ord"))
    initial = F.ascii(F.element_at(F.split("segment", "\\."), -1))
    holders = F.broadcast(nations.where("n_nationkey % 4 = 1").select((F.col("n_nationkey") - 1).alias("before"), F.col("cluster").alias("holder")))
    shared = cus.select("c_nationkey", "segment").distinct().join(holders, F.col("c_nationkey") == F.col("before"))
    edges = [
        edge(nations, "r_name", "cluster", F.col("n_nationkey")), edge(sup, "cluster", "s_name", F.col("s_suppkey")),
        edge(segments, "cluster", "segment", F.lit(SEGMENT_ORD) + initial), edge(cus, "segment", "c_name", F.col("c_custkey")),
        edge(cus.where("c_custkey % 3 = 0"), "cluster", "c_name", F.lit(SECOND_ORD) + F.col("c_custkey"), 2), edge(shared, "holder", "segment", F.lit(SHARED_ORD) + initial, 2),
    ]
    tag = lambda df, n, k, o, v: df.select(F.col(n).alias("node"), F.lit(k).alias("key"), o.cast("long").alias("val_ord"), v.cast("string").alias("value"))
    priorities = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    tags = [
        tag(cus, "c_name", "mktsegment", F.lit(0), F.col("c_mktsegment")), tag(nations, "cluster", "nationkey", F.lit(0), F.col("n_nationkey")),
        tag(priorities.join(customer, F.col("o_custkey") == F.col("c_custkey")), "c_name", "priority", F.substring("o_orderpriority", 1, 1), F.col("o_orderpriority")),
        tag(region, "r_name", "ADMIN_NODE", F.lit(0), F.concat(F.lit("admin-"), F.lower("r_name"))),
        tag(nations.where("n_nationkey % 2 = 0"), "cluster", "ADMIN_NODE", F.lit(0), F.concat(F.lit("admin-"), "n_nationkey")),
    ]
    every = lambda rows, graph: reduce(DataFrame.unionByName, rows).select(F.lit(graph).alias("graph"), "*", F.lit(1).cast("long").alias("valid_from"), F.lit(LATEST).alias("valid_to"))
    nodes, links = every(primary, "primary"), every(edges, "primary")
    if dependencies:
        links = links.unionByName(every([dependency_edges(spark, sf_dir)], "dependency"))
        nodes = nodes.unionByName(every([node(nations, "cluster", CLUSTER)], "dependency"))
    return Topology(nodes, links, every(tags, "primary"))


def dependency_edges(spark: SparkSession, sf_dir: str, acyclic: bool = True) -> DataFrame:
    """Nation of a customer depends on the nations of its suppliers (those with a larger key, if acyclic)."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    names = F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("#"), "n_name").alias("cluster")))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplied = lines.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    bought = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    pairs = supplied.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("c_nationkey", "s_nationkey").distinct()
    if acyclic:
        pairs = pairs.where("c_nationkey < s_nationkey")
    a, b = names.select(F.col("n_nationkey").alias("ak"), F.col("cluster").alias("src")), names.select(F.col("n_nationkey").alias("bk"), F.col("cluster").alias("dst"))
    return pairs.join(a, F.col("c_nationkey") == F.col("ak")).join(b, F.col("s_nationkey") == F.col("bk")).select("src", "dst", F.col("s_nationkey").cast("long").alias("fwd_ord"), F.col("c_nationkey").cast("long").alias("rev_ord"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as interval events of a store: a user's sign-up opens a node, an error closes it; versions are event ids."""
    log = read(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    op = F.when(F.col("event_type") == "signup", "open").otherwise("close")
    return log.select(
        F.col("event_id").cast("long").alias("version"), F.lit(0).alias("seq"), op.alias("op"), F.lit("node").alias("kind"), F.lit("primary").alias("graph"),
        F.col("user_id").cast("string").alias("a"), F.lit(HOST).alias("b"), F.lit(None).cast("string").alias("c"),
    )


def nations_of(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    """(key, nation, region) of the 25 nations."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return [tuple(r) for r in rows.select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()]


def requests(nations: list[tuple[int, str, str]]) -> tuple[list[tuple], list[tuple]]:
    """Writes of every kind over the nations: those that build, and those that change what was built; a few of them are refused."""
    envs = sorted({r for _, _, r in nations})
    build: list[tuple] = [("create_env", (r,)) for r in envs] + [("create_graph", ("archive",)), ("create_env", (envs[0],))]
    for k, n, r in nations:
        build += [("add_cluster_to_env", (r, n)), ("add_cluster_to_cluster", (r, n, f"{n}-a")), ("add_cluster_to_cluster", (r, n, f"{n}-b"))]
        build += [("add_host_to_cluster", (r, f"{n}-{x}", f"host{k}")) for x in "ab"] + [("add_host", (f"spare{k}",))]
        build += [("add_node_key_value", (r, n, "rack", v)) for v in (f"r{k}", "common")] + [("add_node_env_dependency", (r, n, f"{n}-a"))]
    build += [("add_node_ext_dependency", (r, n, q, m)) for (_, n, r), (_, m, q) in zip(nations, nations[1:], strict=False)]
    change: list[tuple] = []
    for k, n, r in nations:
        some = {
            2: ("remove_node_key_value", (r, n, "rack", "common")), 3: ("remove_host_from_cluster", (r, f"{n}-b", f"host{k}")), 4: ("remove_host", (r, f"spare{k}")),
            5: ("remove_cluster_from_cluster", (r, n, f"{n}-a")), 6: ("remove_key_from_node", (r, n, "rack")), 7: ("remove_cluster", (r, f"{n}-b")), 8: ("remove_cluster_from_env", (r, n)),
            9: ("update_tag", (r, n, "rack", f"r{k}", f"new{k}")),
        }
        change += [w for by, w in some.items() if k % by == 0]
        if k % 2:
            change.append(("remove_node_env_dependency", (r, n, f"{n}-a")))
        if k % 10 == 3:
            _, m, q = nations[k + 1]
            change.append(("remove_node_ext_dependency", (r, n, q, m)))
        if k % 12 == 1:
            change.append(("set_type", ("", f"spare{k}", STRING)))
    return build, [*change, ("remove_env", (envs[-1],))]
