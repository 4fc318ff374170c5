"""SimHash near-deduplication by tiled exact comparison (operator 1).

Distinct fingerprints are sorted into tiles by the population counts of their
four 16-bit parts.  Two fingerprints that differ in at most r bits have counts
that differ by at most r in sum, so only tile pairs within that distance are
joined; the others are skipped unseen.  Tiles hold a bounded number of
fingerprints, larger ones come in several blocks.  A joined pair of blocks is
compared in full with numpy exclusive-or and bit counts, and passes on a
spanning forest of its links rather than all of them.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from meshset.llm.common import arrow_map, components, materialise, spanning

SEED, PARTS, BLOCK = 42, 4, 8192


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half of the hashes of the word shingles, repeats included."""
    tokens = (text or "").encode("utf-8").lower().split()
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - words] + 1]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Columns doc_id and fp, the fingerprint as a signed long."""

    def run(b):
        fps = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64)
        return {"doc_id": b.column(0), "fp": fps.view(np.int64)}

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks (within one, if right is None).

    The comparison is exact and complete; pairs that are connected already are
    left out of what is passed on, so a large group adds few rows.
    """
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    other = both[shift:]
    label = np.arange(len(both))
    a_out, b_out = [], []
    rows = max(1, cells // max(1, len(other)))
    for k in range(0, len(left), rows):
        near = np.bitwise_count(left[k : k + rows, None] ^ other[None, :]) <= radius
        near &= label[k : min(k + rows, len(left)), None] != label[None, shift:]
        i, j = np.nonzero(near)
        for out, x in zip((a_out, b_out), spanning(i + k, j + shift, label), strict=True):
            out.append(x)
    if not a_out:
        return both[:0], both[:0]
    return both[np.concatenate(a_out)], both[np.concatenate(b_out)]


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges a, b that connect all of the distinct values ``fp`` that differ in at most ``radius`` bits."""
    base = 64 // PARTS + 1
    tile = " + ".join(f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535) * {base**k}" for k in range(PARTS))
    keyed = fps.select("fp", F.expr(f"cast({tile} as int)").alias("tile"))
    # at most 17 ** 4 tiles, whatever the input
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = keyed.join(F.broadcast(sizes), "tile").withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    blocks = materialise(spread.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "tiles")  # a block has about `block` values
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    # a step within one tile's range of counts; others would wrap into another tile
    parts = [f"cast(tile div {base**k} as int) % {base}" for k in range(PARTS)]
    table = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)], F.lit(sum(x * base**k for k, x in enumerate(d))).alias("by")) for d in steps])
    # which blocks meet is found on their numbers alone; the blocks themselves come to each meeting by two sorted joins
    keys = blocks.select("tile", "block")
    left = keys.withColumn("to", F.explode(table)).where(" and ".join(f"{p} + to.d{k} between 0 and {base - 1}" for k, p in enumerate(parts)))
    left = left.select("tile", "block", (F.col("tile") + F.col("to.by")).alias("tile_b"))
    met = materialise(left.join(keys.select(F.col("tile").alias("tile_b"), F.col("block").alias("block_b")), "tile_b").where("tile <> tile_b or block <= block_b"), "meetings")
    other = blocks.select(F.col("tile").alias("tile_b"), F.col("block").alias("block_b"), F.col("fps").alias("b"))
    pairs = met.join(blocks.withColumnRenamed("fps", "a").hint("merge"), ["tile", "block"]).join(other.hint("merge"), ["tile_b", "block_b"])
    pairs = pairs.select("a", "b", F.expr("tile = tile_b and block = block_b").alias("self"))

    def run(b):
        a, o = b.column(0), b.column(1)
        a_at, b_at = a.offsets.to_numpy(), o.offsets.to_numpy()
        a_all, b_all = a.values.to_numpy(zero_copy_only=False).view(np.uint64), o.values.to_numpy(zero_copy_only=False).view(np.uint64)
        got = []
        for k, own in enumerate(b.column(2).to_pylist()):
            x = a_all[a_at[k] : a_at[k + 1]]
            got.append(_forest(x, None if own else b_all[b_at[k] : b_at[k + 1]], radius))
        return {"a": np.concatenate([g[0] for g in got]).view(np.int64), "b": np.concatenate([g[1] for g in got]).view(np.int64)}

    return arrow_map(pairs, run, "a long, b long")


def near_groups(df: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Texts without words, null ones included, have fingerprint zero and are linked
    like any other; fewer words than a shingle has make one shingle.  Equal
    fingerprints are one class, whose members link with distance 0.  Repeated
    rows stay; null ids never are a component's id unless it has no other.
    Other columns, whatever their names, are not read.  Empty in, empty out.
    """
    docs = materialise(fingerprints(df, id_col, text_col, words), "fingerprints", arrow_rows=1024)
    return docs.join(classes(docs, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(docs: DataFrame, radius: int) -> DataFrame:
    """fp, root (a fingerprint that names the component) and component_id of each distinct fingerprint of ``docs`` (doc_id, fp)."""
    fps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = materialise(components(materialise(links(fps, radius), "links", arrow_rows=128)), "roots")  # a row is a pair of blocks
    named = materialise(roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "low"), "named")
    least = materialise(named.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    linked = named.join(least, "root").select("node", "root", "component_id")
    return materialise(fps.join(linked, fps["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id")), "components")


def near_dedup(df: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each group of near copies, the one with the smallest id, null last.

    Rows are known by id and text, so unlike texts under one id, or under a null
    one, belong to groups of their own; of wholly equal rows that would stay one
    does.  Null and empty texts have fingerprint zero and form one group.  All
    columns are kept, under their own names, whatever those are.  Empty in, empty
    out.  No group is gathered: groups are added up, and rows leave by anti-joins.
    """
    key = [F.col(id_col).cast("long").alias("k_id"), F.xxhash64(F.col(text_col).cast("string")).alias("k_text")]
    seen = materialise(_keyed_fingerprints(df, id_col, text_col, words), "fingerprints", arrow_rows=1024)
    owner = classes(seen.select(F.col("k_id").alias("doc_id"), "fp"), radius)
    texts = seen.groupBy("k_id", "k_text", "fp").agg(F.count("*").alias("times"))
    grouped = materialise(texts.join(owner.select("fp", "root"), "fp"), "grouped")
    order = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text")
    best = materialise(grouped.groupBy("root").agg(F.min(order).alias("best")), "best")
    chosen = grouped.join(best, "root").withColumn("stays", order == F.col("best"))
    # most rows stay, so those that don't, or that have equals, are the small side
    odd = materialise(chosen.where("not stays or times > 1").select("k_id", "k_text", "stays"), "odd")
    rows = df.select(F.struct("*").alias("row"), *key)
    same = lambda side: F.col("k_id").eqNullSafe(side["o_id"]) & (F.col("k_text") == side["o_text"])
    left_out = odd.select(F.col("k_id").alias("o_id"), F.col("k_text").alias("o_text"))
    repeated = odd.where("stays").select(F.col("k_id").alias("o_id"), F.col("k_text").alias("o_text"))
    once = rows.join(left_out, same(left_out), "left_anti").select("row.*")
    one = rows.join(repeated, same(repeated), "left_semi").groupBy("k_id", "k_text").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(one)


def _keyed_fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """k_id, k_text (hash of the text) and fp of every row."""

    def run(b):
        fps = np.array([fingerprint(x, words) for x in b.column(2).to_pylist()], np.uint64)
        return {"k_id": b.column(0), "k_text": b.column(1), "fp": fps.view(np.int64)}

    text = F.col(text_col).cast("string")
    return arrow_map(df.select(F.col(id_col).cast("long").alias("k_id"), F.xxhash64(text).alias("k_text"), text.alias("text")), run, "k_id long, k_text long, fp long")
