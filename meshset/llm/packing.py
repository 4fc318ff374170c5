"""Best-fit packing of documents into sequences by exact-complement hashing (operator 3).

Only lengths matter for where a piece goes, and there are at most ``capacity``
of them.  So the plan is made on the histogram of lengths, whose size does not
depend on the data: patterns of lengths, each with the number of sequences that
it fills.  Longest pieces come first; the gap that one leaves is looked up among
single lengths, sums of pairs and sums of triples that are still available, and
combinations that fill it exactly are consumed as often as the counts allow.
What remains is packed best-fit decreasing.  Each step uses up a length, so the
patterns are few.  Pieces then find their places by their rank among the pieces
of their length; ranks are local counters plus the counts of earlier partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshset.llm.bpe import word_ids
from meshset.llm.common import materialise, record, slices, tidy

Pattern = tuple[int, list[tuple[int, int]]]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local_rank long"


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (sequences, [(length, how many of it in each)]) that use every count exactly once."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out: list[Pattern] = []
    if free[capacity]:
        out.append((int(free[capacity]), [(capacity, 1)]))
        free[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        sums = None
        while free[length]:
            if sums is None:
                sums = _sums(free)
            found = _complement(free, length, capacity - length, *sums)
            if found is None:
                break
            n = min(int(free[x]) // k for x, k in found)
            for x, k in found:
                free[x] -= n * k
            out.append((n, found))
    return out + _best_fit(free, capacity)


def _sums(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sums two and three available lengths have; counts only fall, so a later look may need checking but misses nothing.

    A set of lengths is a number's bits, so all sums with one more length are a shift.
    """
    size = len(free)
    lengths = np.flatnonzero(free[1:] > 0) + 1
    one = sum(1 << int(x) for x in lengths)
    two = three = 0
    for x in lengths.tolist():
        two |= one << x
    for x in lengths.tolist():
        three |= two << x
    spread = lambda bits: np.unpackbits(np.frombuffer((bits & (1 << size) - 1).to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size] > 0
    return spread(two), spread(three)


def _complement(free: np.ndarray, length: int, gap: int, pairs: np.ndarray, triples: np.ndarray) -> list[tuple[int, int]] | None:
    """Length and one to three others that fill a sequence, as (length, multiplicity), largest count of uses first."""
    left = free.copy()
    left[length] -= 1
    if left[gap] > 0:
        return _multiset(length, gap)
    if pairs[gap] and (p := _pair(left, gap)):
        return _multiset(length, *p)
    if not triples[gap]:
        return None
    thirds = np.flatnonzero((left[1 : gap - 1] > 0) & pairs[gap - 1 : 1 : -1]) + 1
    for c in thirds[np.argsort(-left[thirds], kind="stable")]:
        left[c] -= 1
        p = _pair(left, gap - int(c))
        left[c] += 1
        if p:
            return _multiset(length, int(c), *p)
    return None


def _pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    a = np.arange(1, total // 2 + 1)
    both = np.minimum(left[a], left[total - a])
    if total % 2 == 0 and len(a):
        both[-1] = left[total // 2] // 2
    if not len(both) or both.max() <= 0:
        return None
    k = int(a[both.argmax()])
    return total - k, k


def _multiset(*lengths: int) -> list[tuple[int, int]]:
    return [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]


def _best_fit(free: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equal sequences."""
    bins: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(free[length])
        while n:
            fits = np.flatnonzero(has[length:])
            if len(fits):
                gap = length + int(fits[0])
                count, items = bins[gap].pop()
            else:
                gap, items = capacity, []
                count = max(1, n // (gap // length))
            each = gap // length
            use = min(count, n // each)
            if not use:
                use, each = 1, n
            if use < count and gap < capacity:
                bins[gap].append((count - use, items))
            if gap < capacity:
                has[gap] = bool(bins[gap])
            rest = gap - each * length
            bins[rest].append((use, [*items, (length, each)]))
            has[rest] = rest > 0
            n -= use * each
    return [p for group in bins for p in group]


def places(patterns: list[Pattern], counts: dict[int, int]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset), sorted by length and first rank."""
    taken = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for n, items in patterns:
        offset = 0
        for length, k in items:
            rows.append((length, taken[length], k, sequence, offset))
            taken[length] += n * k
            offset += k * length
        sequence += n
    if taken != counts:
        raise AssertionError("the plan does not use every piece once")
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(df: DataFrame, path: str, capacity: int, id_col: str, text_col: str, kept: int, forget: bool) -> DataFrame:
    """Tokenize; cut only what is longer than a sequence; number pieces of each length within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, pid = word_ids(path, kept), [0] * (capacity + 1), TaskContext.get().partitionId()
        for b in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {x.split()[0]: [] for x in PIECES.split(", ")}
            for doc, ids in zip(b.column(0).to_pylist(), map(bpe.ids_bytes, b.column(1).to_pylist()), strict=True):
                ids = memoryview(ids + b"\0\0\0\0")
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    row = (doc, k, start, n, zlib.crc32(part), pid, seen[n])
                    seen[n] += 1
                    for c, x in zip(out.values(), row, strict=True):
                        c.append(x)
            yield record(out, PIECES)
        if forget:
            bpe.forget()
            tidy()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", kept: int = 700_000, forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text's ids are followed by id 0; a null text is empty and packs as that
    one id.  Repeated rows are packed once each; null ids stay null; an empty
    table gives an empty result; other columns, whatever their names, are not
    read.  The texts are tokenized once, into a narrow scratch table; ``kept`` is
    how many words' ids a worker holds, which changes speed and memory only;
    with ``forget`` it drops them at the end of each task.
    """
    spark = df.sparkSession
    rows = materialise(pieces(df, path, capacity, id_col, text_col, kept, forget), "pieces", arrow_rows=2048)
    by_part = rows.groupBy("length", "pid").agg(F.count("*").alias("n"))
    counts = {int(r[0]): int(r[1]) for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(places(plan(counts, capacity), counts))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            c = dict(zip(b.schema.names, b.columns, strict=True))
            length, rank = c["length"].to_numpy(), c["rank"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            nth = rank - t[at, 1]
            yield record(c | {"sequence_id": t[at, 3] + nth // t[at, 2], "offset": t[at, 4] + nth % t[at, 2] * length}, schema)

    joined = rows.join(first, ["length", "pid"])
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local_rank")).alias("rank")).mapInArrow(place, schema)
