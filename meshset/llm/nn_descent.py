"""Embedding near-deduplication by NN-descent (operator 4).

The neighbour graph starts from sorted random-hyperplane codes: in each of some
tables the vectors of a label are ordered by a 62-bit code of their own, and each
one is compared with those next to it in that order.  The graph is then refined:
the neighbours of each vector meet in a local join, and what they find enters
their lists, until nothing new comes up.  Edges below ``floor`` are not kept:
two links at the threshold that share a vector are never further apart than
that, so an edge below it cannot lead from link to link.  A list that is full of
links is saturated and doubles, up to ``widest``.  That bounds only what takes
part in local joins: links that full lists have no room for still connect their
ends, by spanning forests of them.  For exact counts the components of all links
found are compared in full, in blocks.  The recall is audited against brute force
for a bounded sample of vectors, which grows until it holds enough linked ones; it is
the mean of what linked vectors have found of their links.  With too little of it the
search runs on with more tables, and where those are used up all vectors of a label
are compared in blocks, so no links are missed; what happened is logged and reported.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshset.llm.common import components, drop_scratch, materialise, record, runs, spanning

TABLES, MOST_TABLES, WINDOW, LIST, WIDEST, ROUNDS, RECALL = 8, 32, 24, 16, 64, 6, 0.97
#: Vectors in a block of a full comparison, at least and at most; up to 16 blocks are small.
SMALL, BLOCK = 256, 4096
#: Vectors that are audited, at first and at most, and linked ones that suffice.
AUDIT, MOST_AUDITED, LINKED = 1024, 16384, 100
log = logging.getLogger(__name__)


def _kind(df: DataFrame, vector_col: str) -> str:
    """Floats travel as floats; all arithmetic is in double precision."""
    return "array<float>" if df.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows with vectors that can link: id, label, vec.

    Rows whose vector is null, empty, zero, or holds a null or a non-finite
    component, or whose label is null, link with nothing and are left out.
    """
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(_kind(df, vector_col)).alias("vec"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("label").isNotNull() & v.isNotNull() & good)


def _unit(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of one width, scaled to length 1 in double precision (scaled down first, so that squares stay finite)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(n, len(flat) // n) if n else flat.reshape(0, 0)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def codes(vectors: DataFrame, tables: range, bits: int = 62) -> DataFrame:
    """One row per vector and table: tab, label, dim, code, vid, vec; the code's bits are sides of random hyperplanes."""
    schema = f"tab int, label string, dim int, code long, vid long, vec {vectors.schema['vec'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        power = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            sizes = np.diff(c["vec"].offsets.to_numpy())
            for d in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == d))
                vec, label, vid = c["vec"].take(at), c["label"].take(at), c["vid"].take(at)
                m = _unit(vec)
                for t in tables:
                    if (t, d) not in planes:
                        planes[t, d] = np.random.default_rng([t, int(d)]).standard_normal((int(d), bits))
                    code = (m @ planes[t, d] > 0) @ power
                    yield record({"tab": [t] * len(at), "label": label, "dim": [d] * len(at), "code": code, "vid": vid, "vec": vec}, schema)

    return vectors.mapInArrow(run, schema)


def seeds(coded: DataFrame, floor: float, window: int = WINDOW, parts: int = 8) -> DataFrame:
    """First edges (a, b, sim >= floor), one way: each vector against the ``window`` next ones in its table's order.

    Rows are dealt by ranges of (table, label, code), so no label, however
    common, meets in one task.
    """
    schema = "a long, b long, sim double"
    keys = ["tab", "label", "dim", "code", "vid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for key, t in runs(iter([b]), ["tab", "label", "dim"]):
                ids, m = t.column("vid").to_numpy(), _unit(t.column("vec"))
                held = 0
                if key in carry:
                    old_ids, old = carry[key]
                    held = len(old_ids)
                    ids, m = np.concatenate([old_ids, ids]), np.concatenate([old, m])
                a, o, s = [], [], []
                for k in range(1, window + 1):
                    first = max(0, held - k)  # pairs inside what was carried over are done
                    if len(ids) - k <= first:
                        continue
                    sim = np.einsum("ij,ij->i", m[first : len(ids) - k], m[first + k :])
                    hit = np.flatnonzero(sim >= floor)
                    a.append(ids[first + hit])
                    o.append(ids[first + hit + k])
                    s.append(sim[hit])
                carry = {key: (ids[-window:], m[-window:])}
                if sum(map(len, a)):
                    a, o, s = map(np.concatenate, (a, o, s))
                    yield record({"a": a, "b": o, "sim": s}, schema)

    return coded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def shorten(edges: DataFrame, threshold: float, size: int = LIST, widest: int = WIDEST) -> DataFrame:
    """Each vector's nearest neighbours: ``size`` of them, doubled while the list is saturated with links.

    (a, b, sim) with equal pairs once; at most ``widest`` rows of a vector.
    """
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    nearest = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = once.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= widest)
    sizes = [size]
    while sizes[-1] < widest:
        sizes.append(min(widest, 2 * sizes[-1]))
    room = F.lit(size)
    linked = F.sum((F.col("sim") >= threshold).cast("int")).over(Window.partitionBy("a"))
    for small, large in zip(sizes, sizes[1:], strict=False):
        room = F.when(F.col("linked") >= small, F.lit(large)).otherwise(room)
    return ranked.withColumn("linked", linked).where(F.col("nth") <= room).select("a", "b", "sim")


def pivots_of(graph: DataFrame, widest: int = WIDEST) -> DataFrame:
    """Who meets in local joins: pivot, vid; the nearest neighbours of each vector, forward and reverse, at most 2 * ``widest``."""
    nearest = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    lists = both_ways(graph).groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= 2 * widest)
    return materialise(lists.select(F.col("a").alias("pivot"), F.col("b").alias("vid")), "pivots")


def _joined(pivots: DataFrame, vectors: DataFrame) -> DataFrame:
    return pivots.join(vectors.select("vid", "vec"), "vid").repartition("pivot").sortWithinPartitions("pivot")


def refine(pivots: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """Local joins: neighbours of one vector are compared with each other."""
    schema = "a long, b long, sim double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["pivot"]):
            if t.num_rows < 2:
                continue
            ids, m = t.column("vid").to_numpy(), _unit(t.column("vec"))
            sim = m @ m.T
            i, j = np.nonzero((sim >= floor) & (ids[:, None] != ids[None, :]))
            if len(i):
                yield record({"a": ids[i], "b": ids[j], "sim": sim[i, j]}, schema)

    return _joined(pivots, vectors).mapInArrow(run, schema)


def saturated(graph: DataFrame, threshold: float, widest: int = WIDEST) -> DataFrame:
    """vid of the vectors whose lists hold ``widest`` links: only a link between two of them can be missing from both lists."""
    return graph.where(F.col("sim") >= threshold).groupBy("a").count().where(F.col("count") >= widest).select(F.col("a").alias("vid"))


def dropped(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that left their lists."""
    return materialise(old.where(F.col("sim") >= threshold).join(new, ["a", "b"], "left_anti").select("a", "b"), "dropped")


def forest(pivots: DataFrame, vectors: DataFrame, threshold: float, most: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that connect whatever the links of the local joins connect.

    A task passes on a link only if its ends are not connected yet by those
    before, so it has fewer rows than vectors; it starts anew with ``most`` of them.
    """
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for _, t in runs(batches, ["pivot"]):
            ids, m = t.column("vid").to_numpy(), _unit(t.column("vec"))
            if len(up) > most:
                up.clear()
            left, out = np.arange(len(ids)), []
            near = m @ m.T >= threshold
            while len(left):  # one connected part of the local links at a time
                fresh, left = left[:1], left[1:]
                while len(fresh) and len(left):
                    touch = near[np.ix_(fresh, left)]
                    hit = touch.any(axis=0)
                    out += zip(ids[fresh[touch.argmax(axis=0)[hit]]].tolist(), ids[left[hit]].tolist(), strict=True)
                    fresh, left = left[hit], left[~hit]
            kept = []
            for a, b in out:
                if (x := top(a)) != (y := top(b)):
                    up[x] = y
                    kept.append((a, b))
            if kept:
                yield record({"a": [a for a, _ in kept], "b": [b for _, b in kept]}, schema)

    return _joined(pivots, vectors).mapInArrow(run, schema)


def compare(members: DataFrame, vectors: DataFrame, threshold: float, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Each group compared in full, block by block: rows (vid, linked, other).

    ``members`` has node and root.  With ``other`` null, ``linked`` is a number of
    rows of other vectors linked with vid; with ``linked`` null, vid and other are
    linked, and such rows connect whatever is linked within two blocks.  Pairs of
    blocks of a large group are separate tasks; each passes on one number per vector
    and a spanning forest, never its pairs.
    """
    n = F.count("*")
    blocks = F.greatest(F.least(F.ceil(n / small), F.lit(16)), F.ceil(n / block)).cast("int")
    sizes = materialise(members.groupBy("root").agg(blocks.alias("blocks")), "sizes")
    rows = members.join(sizes, "root").join(vectors, members["node"] == vectors["vid"])
    rows = rows.select("root", "vid", "vec", "copies", "blocks", F.expr("cast(pmod(xxhash64(vid), blocks) as int)").alias("own"))
    # the pair (i, j) of blocks gets the rows of i as its left and those of j as its right side
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vid", "vec", "copies")
    schema = "vid long, linked long, other long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in runs(batches, ["root", "i", "j"]):
            ids, copies, own = (t.column(c).to_numpy() for c in ("vid", "copies", "own"))
            m = _unit(t.column("vec"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for k in range(0, len(left), 1024):
                part = left[k : k + 1024]
                near = m[part] @ m[right].T >= threshold
                if i == j:
                    near[np.arange(len(part)), np.arange(k, k + len(part))] = False
                else:
                    linked[right] += copies[part] @ near
                linked[part] += near @ copies[right]
                a, b = np.nonzero(near)
                a, b = spanning(part[a], right[b], label)
                yield record({"vid": ids[a], "linked": [None] * len(a), "other": ids[b]}, schema)
            yield record({"vid": ids, "linked": linked, "other": [None] * len(ids)}, schema)

    return spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, schema)


def _link_counts(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("linked").isNotNull()).groupBy("vid").agg(F.sum("linked").alias("linked"))


def audit(vectors: DataFrame, found: DataFrame, threshold: float) -> float | None:
    """Recall: the mean share of its links that a linked vector has found, for a bounded sample compared with all of their label.

    Samples of the vectors with the smallest hashes grow until ``LINKED`` of them
    have links, or to ``MOST_AUDITED`` vectors; None if not even one of those has.
    """
    sample = AUDIT
    while True:
        there = _true_counts(vectors, threshold, sample)
        got = there.join(found, "vid", "left").where("there > 0").agg(F.count("*"), F.avg(F.coalesce("linked", F.lit(0)) / F.col("there"))).first()
        if got[0] >= LINKED or sample >= MOST_AUDITED:
            return got[1]
        sample *= 4


def _true_counts(vectors: DataFrame, threshold: float, sample: int) -> DataFrame:
    """vid and there (rows of other vectors linked with it) of a sample, by brute force; at most ``sample`` vectors are taken to the tasks."""
    picked = vectors.orderBy(F.xxhash64("vid"), "vid").limit(sample).select("vid", "label", "vec").collect()
    groups: dict[tuple[str, int], list] = {}
    for vid, label, vec in picked:
        groups.setdefault((label, len(vec)), []).append((vid, vec))
    asked = {k: (np.array([x[0] for x in g]), _unit(pa.array([x[1] for x in g], pa.list_(pa.float64())))) for k, g in groups.items()}
    schema = "vid long, linked long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            sizes, labels = np.diff(c["vec"].offsets.to_numpy()), np.array(c["label"].to_pylist(), object)
            for (label, d), (ids, q) in asked.items():
                at = np.flatnonzero((sizes == d) & (labels == label))
                if not len(at):
                    continue
                there, copies = c["vid"].to_numpy()[at], c["copies"].to_numpy()[at]
                near = (q @ _unit(c["vec"].take(pa.array(at))).T >= threshold) & (ids[:, None] != there[None, :])
                yield record({"vid": ids, "linked": near @ copies}, schema)

    return vectors.mapInArrow(run, schema).groupBy("vid").agg(F.sum("linked").alias("there"))


def complete(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, linked) by comparing all vectors of a label: the exact way where the descent finds too little."""
    every = vectors.select(F.col("vid").alias("node"), F.xxhash64("label", F.size("vec")).alias("root"))
    compared = materialise(compare(every, vectors, threshold), "compared")
    edges = compared.where(F.col("other").isNotNull()).select(F.col("vid").alias("a"), F.col("other").alias("b"))
    return materialise(components(edges), "members"), materialise(_link_counts(compared), "linked")


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", report: dict | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked), component_id, kept (vec_id = component_id).

    Only rows with equal labels are compared; a null label and a vector that is
    null, empty, zero or holds a null or non-finite component link with nothing,
    and so do vectors of different lengths.  Equal vectors of a label are one
    class whose members link with each other; they are compared once.  A null
    id is its own component unless linked; component ids are smallest non-null
    ids.  Other columns, whatever their names, are not read.  Empty in, empty out.
    ``report`` gets the audited recall (None where no audited vector has a link),
    the number of tables, and whether the links were completed by full comparison.
    """
    spark = df.sparkSession
    floor = 2 * threshold * threshold - 1
    rows = materialise(unit_vectors(df, id_col, vector_col, label_col), "rows")
    distinct = rows.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    vectors = materialise(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    graph, tables = None, range(TABLES)
    joined = spark.createDataFrame([], "a long, b long")  # links beside those in the lists
    while True:
        seeded = materialise(seeds(codes(vectors, tables), floor, parts=parts), "seeds")
        joined = joined.unionByName(seeded.where(F.col("sim") >= threshold).select("a", "b"))
        first = shorten(both_ways(seeded), threshold)
        old, graph = graph, materialise(first if graph is None else shorten(graph.unionByName(first), threshold), "graph")
        if old is not None:
            joined = joined.unionByName(dropped(old, graph, threshold))
            drop_scratch(old)
        size = graph.agg(F.count("*"), F.sum("sim")).first()
        for _ in range(ROUNDS if size[0] else 0):
            pivots = pivots_of(graph)
            old, graph = graph, materialise(shorten(graph.unionByName(refine(pivots, vectors, floor)), threshold), "graph")
            full = materialise(saturated(graph, threshold), "saturated")
            if not full.isEmpty():
                joined = joined.unionByName(materialise(forest(pivots.join(full, "vid"), vectors, threshold), "forest")).unionByName(dropped(old, graph, threshold))
            drop_scratch(old)
            drop_scratch(pivots)
            new = graph.agg(F.count("*"), F.sum("sim")).first()
            if new[0] == size[0] and abs(new[1] - size[1]) <= 1e-9 * max(1, abs(size[1])):
                break
            size = new
        members = materialise(components(graph.where(F.col("sim") >= threshold).select("a", "b").unionByName(joined)), "members")
        linked = materialise(_link_counts(compare(members, vectors, threshold)), "linked")
        recall = audit(vectors, linked, threshold)
        if recall is None or recall >= RECALL or tables.stop >= MOST_TABLES:
            break
        tables = range(tables.stop, 2 * tables.stop)
    completed = recall is not None and recall < RECALL
    if completed:
        members, linked = complete(vectors, threshold)
    log.info("recall %s with %s tables, completed: %s", recall, tables.stop, completed)
    if report is not None:
        report.update(recall=recall, tables=tables.stop, completed=completed)
    named = materialise(members.join(vectors, members["node"] == vectors["vid"]).select("root", "vid", "low"), "named")
    least = materialise(named.groupBy("root").agg(F.min("low").alias("low_id")), "least")
    found = named.join(least, "root").select("vid", "low_id").join(linked, "vid")
    full = materialise(vectors.join(found, "vid", "left").select("label", "vec", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low_id", "low").alias("component_id")), "full")
    linkable = rows.join(full, ["label", "vec"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    all_rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(_kind(df, vector_col)).alias("vec"))
    v = F.col("vec")
    bad = F.col("label").isNull() | v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x.isNotNull() & (x != 0))
    alone = all_rows.where(F.coalesce(bad, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linkable.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
