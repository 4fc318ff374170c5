"""Language-model scores by a Katz backoff model over words, of any order (operator 8).

Documents become batches of token numbers with a vocabulary of their own.  Level
by level, each batch sends every distinct n-gram once, with its training count,
to the shard that owns the n-gram's history; shards add the counts up, keep them
as partitioned tables, and answer each batch.  So what moves are distinct n-grams
of a batch, a frequent one as one row per batch, and shards never meet a hot key:
histories with at least a share of all tokens are dealt by history and word, and
their few sums are added up at the end.  The number of shards follows from the
number of tokens, so what a shard holds does not grow with the input.

Counts r up to K are discounted by Good-Turing, with (r - 1/2) / r instead where
the counts of counts give no discount between 0 and 1.  The mass that discounting
frees after a history goes to the words not seen there, in proportion to what the
next lower order gives them: the weight is the freed mass over one minus the
lower order's mass of the words seen.  Unigrams free their mass for one class of
unknown words.  Where nothing was freed, one count is added to the history and
freed.  So at every order all probabilities of known words and the unknown class
sum to 1.  A token's probability is found from the longest history down: the
n-gram's own if it was seen, else the history's weight times that of the n-gram
less its first word; a history never seen passes on to the shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from meshset.llm.common import drop_scratch, materialise, record, runs, tidy

K = 5
ORDER = 3
HOT = 1e-3
BATCH_TOKENS = 700_000
SHARD_TOKENS = 1_500_000
#: The end token's hash; words have others.  The id of the begin is 0, words have ids from 1.
END = 1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    """An array as bytes: integers, none below 0, as narrow as they fit, then one plane per byte of the items, compressed."""
    x = np.ascontiguousarray(x)
    if x.dtype.kind in "iu" and x.itemsize > 1:
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else x[:0].view(np.uint8)
    return bytes([x.itemsize]) + zstandard.compress(planes.tobytes(), 1)


def expand(data: bytes, dtype: str) -> np.ndarray:
    size, raw = data[0], np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    kind = dtype if np.dtype(dtype).kind not in "iu" else f"<u{size}"
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel().astype(dtype, copy=False)


def rising(x: np.ndarray) -> bytes:
    """An array that never falls, as its steps."""
    return squeeze(np.diff(x, prepend=0))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<u8")).astype(np.int64)


class Discounts(NamedTuple):
    """d[r] for r <= K, then 1 for larger counts."""

    d: np.ndarray

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(counts, K + 1)]

    @property
    def freed(self) -> np.ndarray:
        """What each item with count r = 1..K frees, in counts."""
        r = np.arange(1, K + 1)
        return r * (1 - self.d[1 : K + 1])


def good_turing(n: list[int]) -> Discounts:
    """Katz's discounts from the numbers n[r - 1] of items with count r = 1..K + 1."""
    d = np.ones(K + 2)
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        got = -1.0
        if n[r - 1] and common < 1:
            got = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return Discounts(d)


class Unigrams(NamedTuple):
    """total: training tokens; kinds: known words; discounts; scale and unknown share out the mass."""

    total: int
    kinds: int
    discounts: Discounts
    scale: float
    unknown: float

    def p(self, counts: np.ndarray) -> np.ndarray:
        seen = self.discounts.of(counts) * counts * (self.scale / max(1, self.total))
        return np.where(counts > 0, seen, self.unknown)


def unigrams(total: int, kinds: int, n: list[int]) -> Unigrams:
    discounts = good_turing(n)
    if not total:
        return Unigrams(0, 0, discounts, 1.0, 1.0)
    freed = float(np.dot(n[:K], discounts.freed)) / total
    if freed <= 0:
        return Unigrams(total, kinds, discounts, total / (total + 1), 1 / (total + 1))
    return Unigrams(total, kinds, discounts, 1.0, freed)


class Level(NamedTuple):
    """What is known of an order k > 1: its discounts, and of hot histories how many words have count 1..K and the lower mass of all."""

    discounts: Discounts
    hot: dict[tuple[int, ...], tuple[np.ndarray, float]]


class Model(NamedTuple):
    """What all tasks share: the unigrams, the levels from order 2 on, and from which count on a history is hot."""

    words: Unigrams
    levels: dict[int, Level]
    hot: float


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


BATCHES = "batch long, doc_ids array<long>, held array<int>, sizes array<int>, tokens binary, ends int, words binary, counts binary"


def tokenise(df: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Batches of whole documents with at most ``most`` tokens, or one document.

    Words are numbered in the order of their hashes; ``ends`` is the end token's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 24
        ids, held, sizes, parts, numbers, total = [], [], [], [], _Numbers({b"": 0}), 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            train = np.repeat(1 - np.array(held), sizes)
            hashes = np.array([END, *(max(xxh64_intdigest(w), 2) for w in list(numbers)[1:])], "<u8")
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            tokens = place[tokens]
            counts = np.bincount(tokens, weights=train, minlength=len(numbers)).astype("<u4")
            row = {"batch": made, "doc_ids": ids, "held": held, "sizes": sizes, "tokens": squeeze(tokens), "ends": place[0], "words": squeeze(hashes[order]), "counts": squeeze(counts)}
            return record({k: [v] for k, v in row.items()}, BATCHES)

        for b in batches:
            for i, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or "").encode("utf-8").lower().split()
                if ids and total + len(words) + 1 > most:
                    yield flush()
                    made += 1
                    ids, held, sizes, parts, numbers, total = [], [], [], [], _Numbers({b"": 0}), 0
                part = np.fromiter(map(numbers.__getitem__, words), "<u4", len(words))
                parts.append(np.append(part, np.uint32(0)))
                ids.append(i)
                held.append(h)
                sizes.append(len(words) + 1)
                total += len(words) + 1
        if ids:
            yield flush()
        tidy()

    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False)).cast("int")
    return df.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BATCHES)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, none below 0, in order, and each item's rank among them: one sort of keys with their places where 63 bits hold both."""
    bits = max(1, len(keys) - 1).bit_length()
    if len(keys) < 2 or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << bits | np.arange(len(keys)))
    sorted_keys = both >> bits
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    rank = np.empty(len(keys), np.int64)
    rank[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return sorted_keys[new], rank


def _dealt(shard: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, positions) in the order given, which is sorted by shard."""
    s = shard[order]
    cuts = np.flatnonzero(np.diff(s)) + 1
    return [(int(shard[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _owner(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; it rises with the hash, for any number of shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


WORD_ANSWERS = "kind int, batch long, shard int, ids binary, totals binary, stats array<long>"


def count_words(batches: DataFrame, shards: int) -> DataFrame:
    """kind 0: for a batch, ids and totals of the words it sent to a shard; kind 1: [kinds, tokens, n_1 .. n_K+1, largest id] of a shard.

    A shard's frequent words get its small ids, so that columns of ids compress well.
    """
    sent = "shard int, batch long, words binary, counts binary"

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, w, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                words, counts = expand(w, "<u8"), expand(c, "<u4")
                got = _dealt(_owner(words, shards), np.arange(len(words)))
                yield record({"shard": [s for s, _ in got], "batch": [batch] * len(got), "words": [squeeze(words[p]) for _, p in got], "counts": [squeeze(counts[p]) for _, p in got]}, sent)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), t in runs(rows, ["shard"]):
            words = [expand(x, "<u8") for x in t.column("words").to_pylist()]
            counts = np.concatenate([expand(x, "<u4") for x in t.column("counts").to_pylist()])
            kinds, at = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(at, weights=counts).astype(np.int64)
            ids = np.empty(len(kinds), np.int64)
            ids[np.argsort(-total, kind="stable")] = np.arange(len(kinds), dtype=np.int64) * shards + shard + 1
            ends = np.cumsum([len(w) for w in words])[:-1]
            batch = t.column("batch").to_pylist()
            n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
            stats = [int((total > 0).sum()), int(total.sum()), *n, int(ids.max())]
            yield record({
                "kind": [0] * len(batch) + [1], "batch": [*batch, None], "shard": [shard] * (len(batch) + 1), "stats": [*[None] * len(batch), stats],
                "ids": [*(squeeze(ids[p].astype("<u8")) for p in np.split(at, ends)), None], "totals": [*(squeeze(total[p]) for p in np.split(at, ends)), None],
            }, WORD_ANSWERS)
        tidy()

    out = batches.select("batch", "words", "counts").mapInArrow(send, sent)
    return out.repartition(shards, "shard").sortWithinPartitions("shard", "batch").mapInArrow(add, WORD_ANSWERS)


KNOWN = "batch long, doc_ids array<long>, held array<int>, sizes array<int>, tokens binary, ends int, ids binary, totals binary"


def name_words(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Batches whose words are numbered from 1 in the order of their ids, with ids and totals."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            told = sorted(r["answers"], key=lambda a: a["shard"])  # as the hashes rise, so do their shards
            ids = np.concatenate([expand(a["ids"], "<u8") for a in told]).astype(np.int64)
            totals = np.concatenate([expand(a["totals"], "<i8") for a in told])
            order = np.argsort(ids)
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(1, len(order) + 1)
            row = {x: r[x] for x in ("batch", "doc_ids", "held", "sizes")}
            row |= {"tokens": squeeze(place[expand(r["tokens"], "<u4")]), "ends": int(place[r["ends"]]), "ids": rising(ids[order]), "totals": squeeze(totals[order])}
            yield record({k: [v] for k, v in row.items()}, KNOWN)
        tidy()

    by_batch = answers.where("kind = 0").groupBy("batch").agg(F.collect_list(F.struct("shard", "ids", "totals")).alias("answers"))  # a batch's own words
    return batches.drop("words", "counts").join(by_batch, "batch").mapInArrow(run, KNOWN)


class Local:
    """A batch's distinct n-grams up to some order, with what the shards have told of them.

    Of order k, gram g is the gram ``hist[k][g]`` of order k - 1 and then the word
    ``word[k][g]``; less its first word it is the gram ``suffix[k][g]`` of order
    k - 1.  ``at[k]`` has the gram that ends at each token, or -1 where the text
    has begun too late for one.  Grams of order 1 are the words, 0 is the begin.
    """

    def __init__(self, r: dict, order: int, model: Model, shards: int):
        self.r, self.model, self.shards = r, model, shards
        tokens = expand(r["tokens"], "<u4").astype(np.int32)
        self.sizes, self.held = np.array(r["sizes"], np.int64), np.array(r["held"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.offset = np.arange(len(tokens)) - np.repeat(self.starts, self.sizes)
        self.ids = np.concatenate([[0], risen(r["ids"])])
        totals = np.concatenate([[0], expand(r["totals"], "<i8")])
        totals[0] = totals[r["ends"]]  # as many begins as ends
        self.counts, self.at = {1: totals}, {1: tokens}
        self.hist: dict[int, np.ndarray] = {}
        self.word: dict[int, np.ndarray] = {}
        self.suffix: dict[int, np.ndarray] = {}
        self.hashes = {1: _mix(self.ids)}
        #: Of order k, by gram of order k - 1: whether it frees nothing, what it frees, the lower mass of its words.
        self.none: dict[int, np.ndarray] = {}
        self.freed: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}
        for k in range(2, order + 1):
            self._grams(k)

    def _grams(self, k: int) -> None:
        there = np.flatnonzero(self.offset >= k - 2)
        before = self.at[k - 1][there - 1].astype(np.int64)
        if k == 2:
            before = np.where(self.offset > 0, before, 0)
        kinds, inverse = ranked(before * len(self.ids) + self.at[1][there])
        self.at[k] = np.full(len(self.offset), -1, np.int32)
        self.at[k][there] = inverse
        self.hist[k], self.word[k] = (kinds // len(self.ids)).astype(np.int32), (kinds % len(self.ids)).astype(np.int32)
        self.suffix[k] = np.empty(len(kinds), np.int32)
        self.suffix[k][inverse] = self.at[k - 1][there]
        with np.errstate(over="ignore"):
            self.hashes[k] = _mix(self.hashes[k - 1][self.hist[k]] * np.uint64(3) + self.hashes[1][self.word[k]])

    def hot(self, k: int) -> np.ndarray:
        """By gram of order k - 1: whether it is a hot history."""
        return self.counts[k - 1] >= self.model.hot

    def parts(self, k: int) -> list[tuple[int, np.ndarray]]:
        """(shard, grams of order k that it owns, in order)."""
        h = self.hashes[k - 1][self.hist[k]]
        shard = _owner(np.where(self.hot(k)[self.hist[k]], self.hashes[k], h), self.shards)
        return _dealt(shard, np.argsort(shard.astype("<u2") if self.shards < 1 << 16 else shard, kind="stable"))  # short integers take a radix sort

    def histories(self, k: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in p, which is sorted by them, each history's grams start, and those histories."""
        start = np.flatnonzero(np.diff(self.hist[k][p], prepend=-1))
        return start, self.hist[k][p[start]]

    def names(self, k: int, g: np.ndarray) -> list[np.ndarray]:
        """The word ids of grams of order k, one array per place."""
        if k == 1:
            return [self.ids[g]]
        return [*self.names(k - 1, self.hist[k][g]), self.ids[self.word[k][g]]]

    def learn(self, k: int, answers: list[dict]) -> None:
        """Take in what the shards answered for order k."""
        size = len(self.counts[k - 1])
        self.counts[k], self.none[k] = np.zeros(len(self.hist[k]), np.int64), np.zeros(size, bool)
        self.freed[k], self.seen[k] = np.zeros(size), np.zeros(size)
        told, hot, level = {a["shard"]: a for a in answers}, self.hot(k), self.model.levels[k]
        for s, p in self.parts(k):
            a = told[s]
            self.counts[k][p] = expand(a["counts"], "<i8")
            start, h = self.histories(k, p)
            self.none[k][h] = expand(a["none"], "?")
            asked = h[(np.minimum.reduceat(self.counts[k][p], start) == 0) & (self.counts[k - 1][h] > 0) & ~hot[h]]
            self.freed[k][asked] = expand(a["heads"], "<u4").reshape(-1, K) @ level.discounts.freed
            self.seen[k][asked] = expand(a["seen"], "<f8")
        g = np.flatnonzero(hot)
        for x, name in zip(g.tolist(), zip(*(c.tolist() for c in self.names(k - 1, g)), strict=True), strict=True):
            if name in level.hot:
                heads, self.seen[k][x] = level.hot[name]
                self.freed[k][x], self.none[k][x] = heads @ level.discounts.freed, not heads.any()

    def probabilities(self, order: int, lower: np.ndarray) -> np.ndarray:
        """The probability of each gram of an order, from its history's counts or else from those of the order below."""
        if order == 1:
            return self.model.words.p(self.counts[1])
        lower, d = lower[self.suffix[order]], self.model.levels[order].discounts
        h, r = self.hist[order], self.counts[order]
        sizes, none = self.counts[order - 1], self.none[order]
        freed = np.where(none, 1.0, self.freed[order]) / np.maximum(1, sizes + none)
        weight = np.where(sizes > 0, freed / np.maximum(1 - self.seen[order], 1e-300), 1.0)
        return np.where(r > 0, d.of(r) * r / np.maximum(1, sizes + none)[h], weight[h] * lower)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dense(*columns: np.ndarray) -> tuple[int, np.ndarray]:
    """How many distinct rows the columns have, and each row's rank among them."""
    n, rank = 1, np.zeros(len(columns[0]), np.int64)
    for c in columns:
        size = int(c.max(initial=0)) + 1
        if (n * size).bit_length() + len(c).bit_length() > 63:
            kinds, c = ranked(c)
            size = len(kinds)
        got, rank = ranked(rank * size + c)
        n = len(got)
    return n, rank


SENT = "shard int, batch long, names array<binary>, hot binary, sizes binary, words binary, lower binary, base binary, counts binary"
ANSWERS = "kind int, batch long, shard int, counts binary, none binary, heads binary, seen binary, names array<long>, stats array<long>, mass double"


def count_grams(state: DataFrame, k: int, shards: int, model: Model, wide: str) -> DataFrame:
    """kind 0: for a batch and shard, its grams' totals, of each history whether it frees nothing, and of those that
    must back off how many words have count 1..K and the lower order's mass of all; kind 1: n_1 .. n_K+1; kind 2: the
    same sums of a hot history, of which this shard has a part."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            b = _local(r, k, model, shards, k - 1)
            there = b.at[k] >= 0
            counts = np.bincount(b.at[k][there], weights=np.repeat(1 - b.held, b.sizes)[there], minlength=len(b.hist[k])).astype("<u4")
            hot, parts = b.hot(k), b.parts(k)
            for at in range(0, len(parts), 64):
                out: dict[str, list] = {x.split()[0]: [] for x in SENT.split(", ")}
                for s, p in parts[at : at + 64]:
                    start, h = b.histories(k, p)
                    first, *rest = b.names(k - 1, h)
                    base = np.zeros(len(h), np.int64)
                    if k > 2:  # the size of the shorter history, and whether it frees nothing
                        short = b.suffix[k - 1][h]
                        base = 2 * b.counts[k - 2][short] + b.none[k - 1][short]
                    row = (
                        s, r["batch"], [rising(first), *(squeeze(c.astype(wide)) for c in rest)], squeeze(hot[h]), squeeze(np.diff(np.append(start, len(p))).astype("<u4")),
                        squeeze(b.ids[b.word[k][p]].astype(wide)), squeeze(b.counts[k - 1][b.suffix[k][p]]), squeeze(base), squeeze(counts[p]),
                    )
                    for c, x in zip(out.values(), row, strict=True):
                        c.append(x)
                yield record(out, SENT)
        tidy()

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), t in runs(rows, ["shard"]):
            yield from _shard(t, shard, k, model, wide)
        tidy()

    out = state.mapInArrow(send, SENT)
    return out.repartition(shards, "shard").sortWithinPartitions("shard", "batch").mapInArrow(add, ANSWERS)


def _shard(t: pa.Table, shard: int, k: int, model: Model, wide: str) -> Iterator[pa.RecordBatch]:
    """Add up what the batches sent to one shard, and answer each of them."""
    read = lambda c, kind: [expand(x, kind) for x in t.column(c).to_pylist()]
    names = t.column("names").to_pylist()
    columns = [np.concatenate([risen(x[0]) for x in names]), *(np.concatenate([expand(x[c], wide) for x in names]).astype(np.int64) for c in range(1, k - 1))]
    sizes = read("sizes", "<u4")
    owners, owner = _dense(*columns)  # of each history that a batch sent
    grams, at = _dense(np.repeat(owner, np.concatenate(sizes)), np.concatenate(read("words", wide)).astype(np.int64))
    total = np.bincount(at, weights=np.concatenate(read("counts", "<u4")), minlength=grams).astype(np.int64)
    of, lower = np.empty(grams, np.int64), np.empty(grams, np.int64)
    of[at] = np.repeat(owner, np.concatenate(sizes))
    lower[at] = np.concatenate(read("lower", "<i8"))
    base = np.zeros(owners, np.int64)
    base[owner] = np.concatenate(read("base", "<i8"))
    got = np.flatnonzero(total)
    r, of = total[got], of[got]
    low = r <= K
    heads = np.bincount(of[low] * K + r[low] - 1, minlength=K * owners).reshape(-1, K)
    if k == 2:
        p = model.words.p(lower[got])
    else:
        p = model.levels[k - 1].discounts.of(lower[got]) * lower[got] / ((base >> 1) + (base & 1))[of]
    mass = np.bincount(of, weights=p, minlength=owners).astype(float)  # of no items it would count in integers
    known = np.bincount(of, minlength=owners) > 0
    none, hot = ~heads.any(axis=1), np.concatenate(read("hot", "?"))
    blank: dict[str, list] = {x.split()[0]: [None] for x in ANSWERS.split(", ")}
    done = first = 0
    for batch, size in zip(t.column("batch").to_pylist(), sizes, strict=True):
        h, g = owner[first : first + len(size)], at[done : done + int(size.sum())]
        start = np.cumsum(size.astype(np.int64)) - size
        asked = h[(np.minimum.reduceat(total[g], start) == 0) & known[h] & ~hot[first : first + len(size)]]
        yield record(blank | {"kind": [0], "batch": [batch], "shard": [shard], "counts": [squeeze(total[g])], "none": [squeeze(none[h])], "heads": [squeeze(heads[asked].astype("<u4").ravel())], "seen": [squeeze(mass[asked])]}, ANSWERS)
        done, first = done + len(g), first + len(size)
    n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
    yield record(blank | {"kind": [1], "shard": [shard], "stats": [n]}, ANSWERS)
    hots = np.flatnonzero(hot)
    _, one = np.unique(owner[hots], return_index=True)
    hots = hots[one]
    if len(hots):
        rows = {"kind": [2] * len(hots), "shard": [shard] * len(hots), "names": np.stack([c[hots] for c in columns], axis=1).tolist(), "stats": heads[owner[hots]].tolist(), "mass": mass[owner[hots]]}
        yield record({c: rows.get(c, [None] * len(hots)) for c in blank}, ANSWERS)


def _rows(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in rows:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def _local(r: dict, order: int, model: Model, shards: int, told: int) -> Local:
    """A batch's grams up to an order, with the answers of the orders up to ``told``."""
    b = Local(r, order, model, shards)
    for k in range(2, told + 1):
        b.learn(k, r.pop(f"told{k}"))
    return b


def scores(state: DataFrame, order: int, shards: int, model: Model) -> DataFrame:
    """Sum of log10 probabilities per document: each token's with the longest history that its place allows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            b, words = _local(r, order, model, shards, order), model.words
            logs, p = np.zeros(len(b.offset)), np.zeros(0)
            for k in range(1, order + 1):  # token i has the order i + 2 at most, for it follows i words and the begin
                p = b.probabilities(k, p)
                here = np.flatnonzero(b.offset == k - 2 if k < order else b.offset >= k - 2)
                logs[here] = np.log10(p)[b.at[k][here]]
            base = np.log10((b.counts[1] + 0.1) / (words.total + 0.1 * (words.kinds + 1)))
            add = lambda x: np.add.reduceat(x, b.starts)  # noqa: B023, E731
            tokens = b.at[1]
            yield record({
                "doc_id": r["doc_ids"], "held_out": [bool(h) for h in r["held"]], "n_tokens": b.sizes, "n_known": add((b.counts[1][tokens] > 0).astype(np.int64)),
                "train_tokens": [words.total] * len(b.sizes), "base_score": add(base[tokens]), "score": add(logs),
            }, RESULT)
        tidy()

    return state.mapInArrow(run, RESULT)


def _sums(df: DataFrame, width: int) -> list[int]:
    row = df.where("kind = 1").agg(*[F.sum(F.col("stats")[k]) for k in range(width)]).first()
    return [int(x or 0) for x in row]


def _hot_sums(answers: DataFrame) -> dict[tuple[int, ...], tuple[np.ndarray, float]]:
    """At most one history per share of a token's count: a bounded number, see ``score``."""
    sums = answers.where("kind = 2").groupBy("names").agg(F.sum("mass"), *[F.sum(F.col("stats")[k]) for k in range(K)])
    return {tuple(r[0]): (np.array(r[2:], float), r[1]) for r in sums.collect()}


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, most: int = BATCH_TOKENS, per_shard: int = SHARD_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text is divisible by 10 are held out; a null
    id is learned from.  A null text is empty and has only the end token.
    Repeated rows count and are scored each.  With nothing to learn from, every
    token is unknown, with probability 1 for the only class.  Other columns,
    whatever their names, are not read; an empty table gives an empty result.
    ``order`` is the longest n-gram's length; a shard has about ``per_shard``
    tokens, and a history with half as many tokens as a shard is hot.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = materialise(tokenise(df, id_col, text_col, most), "batches", arrow_rows=512)
    tokens = batches.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(parts, -(-tokens // per_shard))
    answers = materialise(count_words(batches, shards), "words", arrow_rows=8)
    kinds, total, *n = _sums(answers, K + 3)
    largest = answers.where("kind = 1").agg(F.max(F.col("stats")[K + 3])).first()[0] or 0
    known = materialise(name_words(batches, answers), "known", arrow_rows=8)
    drop_scratch(batches)
    drop_scratch(answers)
    model = Model(unigrams(total, kinds, n), {}, max(1.0, min(HOT, 0.5 / shards) * total))
    wide = "<u4" if largest < 1 << 32 else "<u8"
    state = known
    for k in range(2, order + 1):
        told = materialise(count_grams(state, k, shards, model, wide), f"grams{k}", arrow_rows=8)
        model.levels[k] = Level(good_turing(_sums(told, K + 1)), _hot_sums(told))
        by_batch = told.where("kind = 0").groupBy("batch").agg(F.collect_list(F.struct("shard", "counts", "none", "heads", "seen")).alias(f"told{k}"))
        state = state.join(by_batch, "batch")
    return materialise(scores(state, order, shards, model), "scores", arrow_rows=1)
