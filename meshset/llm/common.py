"""What the operators of this subpackage share: scratch tables, Arrow helpers, connected components.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share; only in local mode, where the driver is the one
executor, a folder of our own stands in for a missing setting.  A table that was
written there cuts lineage and survives the loss of executors, and its size is
known to the optimizer.  The shuffles behind a written table go at once.
"""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='meshset-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str, arrow_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a plan without lineage.

    ``arrow_rows`` bounds the rows of an Arrow batch while it is written, for wide rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if arrow_rows:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(arrow_rows)
    before = {key: conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table that ``df`` reads, once nothing needs it any more."""
    for name in df.inputFiles()[:1]:
        for k, (spark, path) in enumerate(_written):
            if path.rsplit("/", 1)[1] in name:
                _delete(spark, path)
                del _written[k]
                return


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have gone already; the folder is scratch
            continue


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``fn`` turns one Arrow batch into a dict of columns named as in ``schema``."""
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    target = pa.schema([(n, ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            if (out := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system, at the end of a task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(b: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch in small parts, so that few of its texts are Python objects at a time."""
    for k in range(0, b.num_rows, rows):
        yield b.slice(k, rows)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<binary>": pa.list_(pa.binary()),
}


def record(columns: dict, schema: str) -> pa.RecordBatch:
    """One Arrow batch out of a dict of columns, typed as in ``schema``."""
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    target = pa.schema([(n, ARROW[t]) for n, t in fields])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``keys`` (the input is sorted by them), one table per run."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if last is not None and rows[start] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = rows[start]
                held.append(b.slice(start, i - start))
                start = i
    if held:
        yield last, pa.Table.from_batches(held)


def spanning(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links between places i and j that connect what ``label`` has apart; ``label`` then has it together."""
    a_out, b_out = [i[:0]], [j[:0]]
    while len(i):
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
        roots, first = np.unique(high, return_index=True)
        a_out.append(i[first])
        b_out.append(j[first])
        label[roots] = low[first]
        while (label != label[label]).any():
            label[:] = label[label]
    return np.concatenate(a_out), np.concatenate(b_out)


def components(edges: DataFrame, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids.

    ``edges`` has columns ``a`` and ``b``; the result has ``node`` and ``root``
    (the smallest id of the component), for nodes with at least one edge to
    another node.  Large-star and small-star steps alternate until nothing
    changes; both inputs of every join are written tables, so Spark may
    broadcast a small one and split the skewed partitions of a hub.  Null ids
    and self loops are ignored; an empty table gives an empty result.
    """
    e = materialise(_canonical(edges), tag)
    for _ in range(rounds):
        big = _star(e, tag, small=False)
        new = _star(big, tag, small=True)
        drop_scratch(big)
        # equal row counts and equal content: the canonical edges are distinct rows
        n_new, s_new = _mark(new)
        n_old, s_old = _mark(e)
        drop_scratch(e)
        e = new
        if (n_new, s_new) == (n_old, s_old):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    return edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _mark(e: DataFrame) -> tuple[int, str]:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], str(row[1])


def _star(e: DataFrame, tag: str, small: bool) -> DataFrame:
    """Rows a < b. Large star: larger neighbours move to the smallest one; small star: smaller ones do."""
    down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    near = down if small else down.unionByName(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = materialise(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    done = materialise(_canonical(out), tag)
    drop_scratch(least)
    return done
