"""A byte-level convolutional quality classifier in numpy (operator 6).

Bytes are embedded, learned filters slide over overlapping chunks that cover the
whole document, and each filter's largest response in a chunk is kept.  The
mean, maximum and minimum of those over the document's chunks go through one
logistic unit.  Learning uses a bounded sample of labelled rows, of which only
bounded parts travel to the driver; scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.llm.common import arrow_map, record, slices, tidy

WIDTH, EMBED, FILTERS = 7, 6, 32
STEP, SPAN = 32, 16  # a chunk has SPAN steps of STEP windows; neighbouring chunks share one step
CHUNK = STEP * SPAN
ROWS_PER_CLASS, CHUNKS_PER_ROW, EPOCHS, BATCH, RATE = 2500, 8, 12, 48, 0.006
SEGMENT = 1 << 14


class Model(NamedTuple):
    embed: np.ndarray  # 256, EMBED
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS
    base: np.ndarray  # 1


def responses(m: Model, data: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each chunk of one document: (chunks, FILTERS)."""
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    steps = []
    for k in range(0, len(data) - WIDTH + 1, SEGMENT):
        part = m.embed[data[k : k + SEGMENT + WIDTH - 1]]
        rows = sliding_window_view(part, WIDTH, axis=0).transpose(0, 2, 1).reshape(-1, WIDTH * EMBED)
        steps.append(np.maximum.reduceat(rows @ m.filters, np.arange(0, len(rows), STEP), axis=0))
    s = np.concatenate(steps)
    top = np.array([s[k : k + SPAN].max(axis=0) for k in range(0, max(1, len(s) - 1), SPAN - 1)])
    return np.maximum(top + m.bias, 0)


def combine(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)])


def score(m: Model, text: str | None) -> float:
    """Probability of label 1; an empty text is scored as a short chunk of zero bytes."""
    z = float(combine(responses(m, np.frombuffer((text or "").encode("utf-8"), np.uint8))) @ m.out + m.base[0])
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def cut(text: str | None, seed: int, most: int = CHUNKS_PER_ROW) -> list[bytes]:
    """Up to ``most`` chunks of a text, drawn at random, with the lengths that scoring sees."""
    data = (text or "").encode("utf-8")
    size = CHUNK + WIDTH - 1
    starts = list(range(0, max(1, len(data) - WIDTH + 1 - STEP), CHUNK - STEP))
    if len(starts) > most:
        starts = sorted(np.random.default_rng(seed & (1 << 62) - 1).choice(starts, most, replace=False).tolist())
    return [data[s : s + size] for s in starts]


def learn(rows: list[tuple[list[bytes], int]], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Adam on the cross entropy of whole rows; gradients pass through the positions of the maxima."""
    rng = np.random.default_rng(seed)
    m = Model(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.4, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.05, 3 * FILTERS).astype(np.float32), np.zeros(1, np.float32),
    )
    if len({y for _, y in rows}) < 2:
        known = [y for _, y in rows]
        return m._replace(out=np.zeros_like(m.out), base=np.array([3.0 * (2 * known[0] - 1)] if known else [0.0], np.float32))
    size = CHUNK + WIDTH - 1
    first = [np.zeros_like(p) for p in m]
    second = [np.zeros_like(p) for p in m]
    t, total = 0, epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            picked = [rows[i] for i in order[k : k + BATCH]]
            chunks = [c for cs, _ in picked for c in cs]
            owner = np.repeat(np.arange(len(picked)), [len(cs) for cs, _ in picked])
            x = np.zeros((len(chunks), size), np.uint8)
            for i, c in enumerate(chunks):
                x[i, : len(c)] = np.frombuffer(c, np.uint8)
            live = np.maximum(1, np.array([len(c) for c in chunks]) - WIDTH + 1)
            grads = _gradients(m, x, live, owner, np.array([y for _, y in picked], np.float32))
            t += 1
            rate = RATE * (1 - 0.9 * t / total)
            new = []
            for p, g, a, b in zip(m, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                new.append((p - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)).astype(np.float32))
            m = Model(*new)
    return m


def _gradients(m: Model, x: np.ndarray, live: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, docs = len(x), len(y)
    rows = sliding_window_view(m.embed[x], WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, CHUNK, WIDTH * EMBED)
    z = rows @ m.filters
    z[np.arange(CHUNK)[None, :] >= live[:, None]] = -np.inf
    pos = z.argmax(axis=1)  # chunks, FILTERS
    top = np.take_along_axis(z, pos[:, None, :], axis=1)[:, 0] + m.bias
    h = np.maximum(top, 0)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    sizes = np.diff(np.append(starts, n))
    mean = np.add.reduceat(h, starts) / sizes[:, None]
    high, low = np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)
    doc = np.concatenate([mean, high, low], axis=1)
    p = 1 / (1 + np.exp(-np.clip(doc @ m.out + m.base[0], -60, 60)))
    err = (p - y) / docs
    g = err[:, None] * m.out[None, :]
    g_mean, g_high, g_low = g[:, :FILTERS], g[:, FILTERS : 2 * FILTERS], g[:, 2 * FILTERS :]
    dh = (g_mean / sizes[:, None])[owner] + np.where(h == high[owner], g_high[owner], 0) + np.where(h == low[owner], g_low[owner], 0)
    dh = np.where(top > 0, dh, 0).astype(np.float32)
    at = pos[:, :, None] + np.arange(WIDTH)  # chunks, FILTERS, WIDTH
    seen = x[np.arange(n)[:, None, None], at]
    d_filters = np.einsum("nf,nfwe->wef", dh, m.embed[seen]).reshape(WIDTH * EMBED, FILTERS)
    d_embed = np.zeros_like(m.embed)
    np.add.at(d_embed, seen.ravel(), (dh[:, :, None, None] * m.filters.reshape(WIDTH, EMBED, FILTERS).transpose(2, 0, 1)[None]).reshape(-1, EMBED))
    return [d_embed, d_filters + 1e-4 * m.filters, dh.sum(axis=0), doc.T @ err + 1e-4 * m.out, np.array([err.sum()], np.float32)]


def part(id_col: F.Column | str) -> F.Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int = ROWS_PER_CLASS) -> list[tuple[list[bytes], int]]:
    """Chunks and labels of at most ``rows_per_class`` ids of each label, none of them held out, those with the smallest hashes.

    An id that several rows have teaches once, however often it is repeated; with
    conflicting labels it has label 1.  Null ids and labels other than 0 and 1
    teach nothing; a null text is empty.
    """
    known = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where((part("l_id") != 1) & F.col("y").isin(0, 1)).groupBy("l_id").agg(F.max("y").alias("y"))
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(rows_per_class).collect()]
    if not ids:
        return []
    listed = F.broadcast(docs.sparkSession.createDataFrame(ids, "l_id long, y int"))
    texts = docs.select(F.col(id_col).cast("long").alias("l_id"), F.col(text_col).cast("string").alias("text")).join(listed, "l_id").select("l_id", "y", "text")
    schema = "l_id long, y int, sizes array<int>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [cut(x, i) for i, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield record({"l_id": b.column(0), "y": b.column(1), "sizes": [[len(c) for c in cs] for cs in cuts], "data": [b"".join(cs) for cs in cuts]}, schema)

    once = texts.mapInArrow(run, schema).groupBy("l_id").agg(F.min(F.struct("y", "sizes", "data")).alias("row")).select("l_id", "row.*")
    out = []
    for r in sorted(once.collect(), key=lambda r: (r.l_id, bytes(r.data))):
        at = np.cumsum([0, *r.sizes]).tolist()
        out.append(([bytes(r.data[a:b]) for a, b in zip(at, at[1:], strict=False)], r.y))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    return learn(sample(docs, labels, id_col, text_col, label_col))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null text is empty and is scored like one; a null id was not learned from
    and is not held out; repeated rows get equal scores; without labels of both
    kinds all scores follow the only one, or are 0.5.  Only the text is an input
    of the score.  Other columns, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # some thousand numbers

    def run(b):
        m = Model(*shared.value)
        p = [score(m, x) for x in b.column(2).to_pylist()]
        return {"doc_id": b.column(0), "held_out": b.column(1), "score": p, "predicted": [int(x >= 0.5) for x in p]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(part(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with all their columns; texts stay where they are scored.

    Null texts are scored as empty ones, so all of them stay or none; null ids
    make no difference; repeated rows stay or go together; columns keep their
    names, whatever those are.  Empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in (part for whole in batches for part in slices(whole)):
            yield b.filter(pa.array([score(m, x) >= least for x in b.column(at).to_pylist()], pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)
