"""The data model: versioned nodes, edges and tags of named graphs, and snapshots of them.

A row is visible at version v if valid_from <= v < valid_to.  Version v is the
state after v writes, so version 0 is empty.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENVIRONMENT, CLUSTER, HOST, STRING = "ENVIRONMENT", "CLUSTER", "HOST", "STRING"
LATEST = (1 << 63) - 1
NODES = "graph string, name string, type string, valid_from bigint, valid_to bigint"
EDGES = "graph string, src string, dst string, fwd_ord bigint, rev_ord bigint, valid_from bigint, valid_to bigint"
TAGS = "graph string, node string, key string, val_ord bigint, value string, valid_from bigint, valid_to bigint"
CHANGELOG = "version bigint, ts timestamp, method string, args array<string>, client_id string, request_id bigint, proposer_id bigint, crc bigint, source string"


@dataclass(frozen=True)
class Topology:
    """All versions: the three tables of the model."""

    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame

    def as_of(self, version: int | None = None, graph: str = "primary", legacy_index: bool = False) -> Snapshot:
        """The state after ``version`` writes (None: the latest); ``legacy_index`` counts changes from 0."""
        if version is not None and legacy_index:
            version += 1

        def at(t: DataFrame) -> DataFrame:
            t = t.where(F.col("graph") == graph)
            if version is None:
                return t.where(F.col("valid_to") == LATEST)
            return t.where((F.col("valid_from") <= version) & (F.lit(version) < F.col("valid_to")))

        return Snapshot(at(self.nodes).select("name", "type"), at(self.edges).select("src", "dst", "fwd_ord", "rev_ord"), at(self.tags).select("node", "key", "val_ord", "value"))

    def graphs(self) -> DataFrame:
        """Names of the graph instances."""
        return self.nodes.select("graph").distinct()

    def cache(self) -> Topology:
        return Topology(self.nodes.cache(), self.edges.cache(), self.tags.cache())


@dataclass(frozen=True)
class Snapshot:
    """One graph at one version."""

    nodes: DataFrame  # name, type
    edges: DataFrame  # src, dst, fwd_ord, rev_ord
    tags: DataFrame  # node, key, val_ord, value (null: the key exists without this row's value)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def counts(self) -> DataFrame:
        """(type, n): how many nodes there are of each type, and how many edges."""
        edges = self.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("type"), "n")
        return self.nodes.groupBy("type").agg(F.count("*").alias("n")).unionByName(edges)

    def of_type(self, *types: str) -> DataFrame:
        """Names of the nodes of some types."""
        return self.nodes.where(F.col("type").isin(*types)).select(F.col("name").alias("value"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by spark.checkpoint.dir; in local mode alone one of our own may stand in."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='meshset-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, which survives the loss of executors."""
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and how many rows were written, in one job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get.get("n", 0)
