"""Operators 1, 2, 6, 8, 9 and 10 and the pipeline's stages against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from meshset.llm import exact_dedup, katz, licenses, quality, queries, sharding, simhash
from meshset.llm.common import components


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(rows, near):
    """The components, as lists of row numbers."""
    groups = []
    for i in range(len(rows)):
        hit = [g for g in groups if any(near(i, j) for j in g)]
        groups = [g for g in groups if g not in hit] + [[i, *(j for g in hit for j in g)]]
    return groups


def brute_groups(rows, near):
    """Smallest id of each row's component."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = defaultdict(list)
    for k, x in enumerate(label):
        low[x].append(rows[k][0])
    return [min((i for i in low[x] if i is not None), default=None) for x in label]


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_groups(rows, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = Counter(map(tuple, simhash.near_groups(docs).collect()))
    assert got == Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps, strict=True))
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    roots = brute_roots(rows, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert Counter(ids) == Counter(min((rows[k][0] for k in g), key=lambda i: (i is None, i)) for g in roots)
    assert simhash.near_dedup(empty).count() == 0 and simhash.near_dedup(empty).columns == docs.columns


def test_near_dedup_keeps_each_group(spark):
    """Groups of null ids only, and unlike texts under one id, keep a row each."""
    fox, sea, law = "the quick brown fox jumps over the lazy dog", "seven old ships sail far out on a cold green sea", "no court may hold what no law has ever said"
    rows = [(None, fox), (None, fox), (None, sea), (None, law), (None, "wholly other words"), (3, "one text of this id"), (3, "and quite another one here"), (3, law), (2, law), (3, "one text of this id"), (4, "plain")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, fox), (None, sea), (None, "wholly other words"), (3, "one text of this id"), (3, "and quite another one here"), (2, law), (4, "plain")]
    assert Counter(map(tuple, got)) == Counter(want)


def test_links_are_complete(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base} | {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (8192, 16):
        root = {r.node: r.root for r in components(simhash.links(df, 3, block)).collect()}
        label = {x: x for x in signed}
        for x in signed:
            for y in signed:
                if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3 and label[x] != label[y]:
                    a, b = sorted((label[x], label[y]))
                    label = {k: a if v == b else v for k, v in label.items()}
        assert all(root.get(x, x) == label[x] for x in signed)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("phi", [1 / 1024, 0.2])
def test_exact_dedup(docs, rows, empty, phi):
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter((i, min(g)[3], len(g), hashlib.sha256(s.encode()).hexdigest()) for s, g in groups.items() for *_, i in g)
    got = exact_dedup.exact_groups(docs, phi=phi).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(s.encode()).hexdigest(): 1 for s in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.exact_dedup(docs, phi=phi)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, squeezed(r.text)) for r in kept.collect()) == Counter((min(g)[3], s) for s, g in groups.items())
    assert exact_dedup.exact_groups(empty).count() == 0 == exact_dedup.exact_dedup(empty).count()


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, sharding.topology(8), sharding.topology(9)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({i for i, _ in rows})
    assert sharding.shard(empty, sharding.topology(8), sharding.topology(9)).count() == 0


def test_tree_law(spark, monkeypatch):
    keys = spark.range(6000).selectExpr("cast(id as string) as k")
    moved = lambda a, b: sharding.shard_of(sharding.shard_of(keys, "k", a, "a"), "k", b, "b").where("a <> b")
    for n in (1, 3, 5, 12):
        assert {r.b for r in moved(sharding.topology(n), sharding.topology(n + 1)).collect()} == {n}
    tree = lambda *w: sharding.topology(3, racks=1, per_rack=2, weights=dict(enumerate(w)), heaviest=4.0)
    share = Counter(r.a for r in sharding.shard_of(keys, "k", tree(1.0, 2.0, 3.0), "a").collect())
    assert all(abs(share[k] / 6000 - w / 6) < 0.03 for k, w in ((0, 1), (1, 2), (2, 3)))
    # a heavier leaf only takes rows, a lighter one only gives them
    assert {r.b for r in moved(tree(1.0, 2.0, 3.0), tree(1.0, 3.5, 3.0)).collect()} == {1} == {r.a for r in moved(tree(1.0, 3.5, 3.0), tree(1.0, 2.0, 3.0)).collect()}
    with pytest.raises(ValueError, match="room"):
        sharding.topology(17)
    # where no draw meets a shard, the leaves' own draws keep the same law
    monkeypatch.setattr(sharding, "DRAWS", 1)
    for n in (1, 5):
        assert {r.b for r in moved(sharding.topology(n), sharding.topology(n + 1)).collect()} == {n}
    share = Counter(r.a for r in sharding.shard_of(keys, "k", sharding.topology(5), "a").collect())
    assert all(abs(share[k] / 6000 - 1 / 5) < 0.03 for k in range(5))


def test_licenses(docs, rows, empty):
    got = {r.license: r for r in licenses.scan(docs).collect()}
    assert set(got) == {"MIT"} and got["MIT"].doc_id == 12 and got["MIT"].n_matches == 2 and got["MIT"].coverage == 1.0 and (got["MIT"].first_word, got["MIT"].last_word) == (0, 4)
    assert licenses.scan(empty).count() == 0
    text = licenses.words("so it is licensed today under the apache license which is version 2 of it")
    pairs = licenses.align(text, licenses.words(licenses.TEXTS["Apache-2.0"][0]))
    assert [text[i] for i, _ in pairs] == ["licensed", "under", "the", "apache", "license", "version", "2"]
    assert all(b > a for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False))


def told(text, least=0.8):
    sought = [(name, licenses.notice(x, least)) for name, texts in licenses.notices().items() for x in texts]
    return licenses.licenses_of(licenses.words(text), sought, least)


def test_licenses_are_told_apart():
    """Texts of sibling licenses, and texts that only look like a notice."""
    cases = {
        "Released under the BSD License.": {"BSD"}, "Released under the Apache License.": set(), "It was released under the new license.": set(), "Licensed under CC BY 4.0.": {"CC-BY-4.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"}, "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"CC-BY-NC-4.0"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": {"CC-BY-3.0"}, "Released under the BSD 3-Clause License, see below.": {"BSD-3-Clause"},
        "Released under the MIT No Attribution License": {"MIT-0"}, "Released under the terms of the MIT License": {"MIT"}, "Licensed under the Apache License, Version 1.1": set(),
        "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0"}, "released the mit students under license": set(),
    }
    assert {t: set(told(t)) for t in cases} == cases
    for name, texts in licenses.notices().items():
        for x in texts:
            found = told("so it says here " + x + " and more of that")
            assert set(found) == {name}, (name, x, found)
            assert len(found[name]) == 1 and found[name][0].coverage == 1.0 and found[name][0].first == 4


def brute_finds(text, n, least):
    """Every stretch that starts with its find, judged; then the best of those that overlap, one by one."""
    need = licenses.needed(len(n.words), least)
    every = [f for s in range(len(text)) if (f := licenses.judge(text, s, n, need))]
    kept = []
    for f in sorted(every, key=lambda f: (-f.score, f.first)):
        if all(f.last < g.first or g.last < f.first for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f.first)


def test_licenses_brute_force():
    """Random texts of a notice's words, others and pieces of notices: what is skipped unseen holds no find."""
    rnd = np.random.default_rng(8)
    every = [licenses.notice(x, 0.8) for texts in licenses.notices().values() for x in texts]
    hits = 0
    for k in range(400):
        n = every[k % len(every)]
        text = []
        for _ in range(rnd.integers(1, 5)):
            part = [w for w in n.words if rnd.random() > (0.0, 0.05, 0.3)[rnd.integers(3)]]
            for _ in range(rnd.integers(0, 3)):
                part.insert(int(rnd.integers(len(part) + 1)), str(rnd.choice(["the", "x", *n.words])))
            text += [*part, *rnd.choice(["a", "of", *n.words], rnd.integers(0, 4)).tolist()]
        got = licenses.find(text, n, 0.8)
        assert got == brute_finds(text, n, 0.8), (n.words, text)
        hits += len(got)
    assert hits > 200


def test_alignment_by_hand():
    """Pairs are equal words in order; words unique to both that lie in order are all aligned; without any it is a longest common subsequence."""
    rnd = np.random.default_rng(9)
    for _ in range(300):
        a, b = (rnd.choice(list("abcdefghij"), rnd.integers(0, 12)).tolist() for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:], strict=False))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in np.ndindex(len(a), len(b)):
            longest[i + 1][j + 1] = longest[i][j] + 1 if a[i] == b[j] else max(longest[i][j + 1], longest[i + 1][j])
        unique = [w for w in a if a.count(w) == b.count(w) == 1]
        assert len(pairs) <= longest[-1][-1]
        if not unique:
            assert len(pairs) == longest[-1][-1]
        if [w for w in b if w in unique] == unique:
            assert {w for w in unique} <= {a[i] for i, _ in pairs}


def test_license_windows():
    """A notice after very many of its own words is found whole; a text of those words alone has none."""
    n = licenses.notice(licenses.GRANT, 0.8)
    noise = ["software"] * 100_000
    assert [f[1:] for f in licenses.find(noise + n.words + noise, n, 0.8)] == [(100_000, 100_000 + len(n.words) - 1, 1.0)]
    assert licenses.find(noise, n, 0.8) == []


def test_license_at_least_coverage(spark):
    """A find at exactly the least coverage, without the notice's longest word."""
    texts = ["Distributed under the MIT License.", "it is available under the MIT License", "under the License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(df).collect() if r.license == "MIT"]
    assert sorted(got) == [(0, "MIT", 0.8, 1, 1, 4), (1, "MIT", 0.8, 1, 3, 6)]
    for n in range(1, 101):
        words = [f"w{k:03}" for k in range(n)]
        for percent in (55, 70, 80, 100):
            spare = n * (100 - percent) // 100
            known = licenses.notice(" ".join(words), percent / 100)
            assert len(known.probes) == spare + 1, (n, percent)
            assert [x.coverage for x in licenses.find(words[spare:], known, percent / 100)] == [(n - spare) / n], (n, percent)


def test_license_with_words_put_in():
    """Words of a notice in order over less than twice its width, with the probes at either end."""
    n = licenses.notice("Released under the MIT License.", 0.8)
    for text in ("Released under the terms of the MIT License", "x y Released now under just the very MIT License z"):
        w = licenses.words(text)
        for must, probes in ((n.must, n.probes), (frozenset(), frozenset(["released"])), (frozenset(), frozenset(["license"]))):
            assert [f[1:] for f in licenses.find(w, n._replace(must=must, probes=probes), 0.8)] == [(w.index("released"), w.index("license"), 1.0)]


def brute_katz(rows, order):
    """Scores by plain dictionaries and recursion; histories are tuples, 0 stands for the begin and None for the end."""
    tok = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    history = lambda x, j, k: tuple([0, *x][max(0, j + 2 - k) : j + 1])  # noqa: E731  of the token j, for the order k
    grams = {k: Counter() for k in range(1, order + 1)}
    for x, use in zip(tok, train, strict=True):
        for j, w in enumerate(x if use else []):
            for k in range(1, min(order, j + 2) + 1):
                grams[k][(*(history(x, j, k) if k > 1 else ()), w)] += 1
    total, kinds = sum(grams[1].values()), len(grams[1])
    d = {k: katz.good_turing([Counter(c.values())[r] for r in range(1, katz.K + 2)]).d for k, c in grams.items()}
    kept = lambda k, r: d[k][min(r, katz.K + 1)] * r
    unknown = 1 - sum(kept(1, r) for r in grams[1].values()) / total
    after = defaultdict(dict)
    for k in range(2, order + 1):
        for g, r in grams[k].items():
            after[g[:-1]][g[-1]] = r

    def p(h, w):
        if not h:
            r = grams[1][(w,)]
            return kept(1, r) / total if r else unknown
        f = after.get(h)
        if not f:
            return p(h[1:], w)
        size, k = sum(f.values()), len(h) + 1
        if all(r > katz.K for r in f.values()):
            return f[w] / (size + 1) if w in f else 1 / (size + 1) / (1 - sum(p(h[1:], x) for x in f)) * p(h[1:], w)
        if w in f:
            return kept(k, f[w]) / size
        return (1 - sum(kept(k, r) for r in f.values()) / size) / (1 - sum(p(h[1:], x) for x in f)) * p(h[1:], w)

    words = [g[0] for g in grams[1]]
    for k in range(2, order + 1):
        for h in [h for h in after if len(h) == k - 1][:7]:
            assert abs(sum(p(h, w) for w in words) + p(h, "unknown") - 1) < 1e-9
    base = lambda w: math.log10((grams[1][(w,)] + 0.1) / (total + 0.1 * (kinds + 1)))
    known = {}

    def score(x):
        key = tuple(x)
        if key not in known:
            known[key] = sum(math.log10(p(history(x, j, order) if order > 1 else (), w)) for j, w in enumerate(x))
        return known[key]

    return [(i, score(x), sum(map(base, x)), len(x), sum((w,) in grams[1] for w in x), total) for (i, _), x in zip(rows, tok, strict=True)]


@pytest.mark.parametrize(("order", "most", "per_shard"), [(3, 10**6, 10**6), (3, 50, 900), (2, 50, 10**6), (4, 200, 3000), (1, 100, 10**6)])
def test_katz(docs, rows, order, most, per_shard):
    rows = [(i, t if not t or len(t) < 9000 else t[:3000]) for i, t in rows]
    df = docs.withColumn("text", F.when(F.length("text") < 9000, F.col("text")).otherwise(F.substring("text", 1, 3000)))
    key = lambda r: (str(r[0]), round(r[1], 6))
    want = sorted(brute_katz(rows, order), key=key)
    got = sorted(((r.doc_id, r.score, r.base_score, r.n_tokens, r.n_known, r.train_tokens) for r in katz.score(df, order=order, most=most, per_shard=per_shard).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[3:] == w[3:] and math.isclose(g[1], w[1], rel_tol=1e-8) and math.isclose(g[2], w[2], rel_tol=1e-9)


def test_katz_odd_tables(docs, rows, empty):
    assert katz.score(empty).count() == 0
    assert Counter(r.doc_id for r in katz.score(docs).collect()) == Counter(i for i, _ in rows)
    held = docs.where("doc_id is not null").withColumn("doc_id", F.lit(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 10 == 0)).cast("long"))
    assert all(r.score == 0 and r.train_tokens == 0 and r.held_out for r in katz.score(held).collect())


def test_quality(spark, docs, rows, empty):
    rng = np.random.default_rng(1)
    good = [" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(60)) for _ in range(150)]
    bad = ["!!".join("".join(rng.choice(list("ABCDEFGHIJ"), rng.integers(2, 8))) for _ in range(60)) for _ in range(150)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, labels)
    scored = quality.classify(table, model).collect()
    held = [r for r in scored if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum((r.doc_id < 150) == bool(r.predicted) for r in held) >= 0.95 * len(held)
    assert quality.keep_good(table, model).count() == sum(r.predicted for r in scored)
    odd = quality.classify(docs, model).collect()
    assert Counter(r.doc_id for r in odd) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in odd)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.classify(empty, model).count() == 0
    assert all(r.score == 0.5 for r in quality.classify(table, quality.fit(table, labels.where("false"))).take(3))
    long = good[0] * 300
    whole = quality.responses(model, np.frombuffer(long.encode(), np.uint8))
    assert len(whole) >= len(long) // quality.CHUNK


def small_model(rng):
    return quality.Model(
        rng.normal(0, 0.5, (256, quality.EMBED)), rng.normal(0, 0.4, (quality.WIDTH * quality.EMBED, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS),
        rng.normal(0, 0.05, 3 * quality.FILTERS), rng.normal(0, 0.1, 1),
    )


def naive_chunk(m, data):
    """Each filter at each place of one chunk, by plain loops, then its largest response."""
    data = data + bytes(max(0, quality.WIDTH - len(data)))
    windows = [np.concatenate([m.embed[b] for b in data[k : k + quality.WIDTH]]) for k in range(len(data) - quality.WIDTH + 1)]
    return [max(0.0, max(float(sum(w * f)) for w in windows) + float(b)) for f, b in zip(m.filters.T, m.bias, strict=True)]


def test_quality_forward_pass():
    """Scores equal those of plain loops over chunks that overlap by one step and cover every byte."""
    rng = np.random.default_rng(3)
    m = small_model(rng)
    step, span = quality.STEP, quality.SPAN
    for n in (0, 1, 6, 7, 8, 100, 517, 518, 519, 1100):
        text = "".join(rng.choice(list("ab cé!Z"), n))
        data = text.encode()
        steps = -(-max(1, len(data) - quality.WIDTH + 1) // step)
        chunks = [data[k * step : min((k + span) * step, steps * step) + quality.WIDTH - 1] for k in range(0, max(1, steps - 1), span - 1)]
        h = np.array([naive_chunk(m, c) for c in chunks])
        z = float(np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)]) @ m.out + m.base[0])
        assert math.isclose(quality.score(m, text), 1 / (1 + math.exp(-z)), rel_tol=1e-6), n
        assert set(range(len(data))) <= {i for k in range(0, max(1, steps - 1), span - 1) for i in range(k * step, (k + span) * step + quality.WIDTH - 1)}


def test_quality_gradients():
    """The gradient equals the slope of the loss, at places of every kind of parameter."""
    rng = np.random.default_rng(6)
    m = small_model(rng)
    size = quality.CHUNK + quality.WIDTH - 1
    lengths = [size, 300, size, 40, 7]
    x = np.zeros((5, size), np.uint8)
    for row, n in zip(x, lengths, strict=True):
        row[:n] = rng.integers(97, 105, n)
    live, owner, y = np.array(lengths) - quality.WIDTH + 1, np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        total = 0.5e-4 * ((m.filters**2).sum() + (m.out**2).sum())
        for d, label in enumerate(y):
            h = np.array([quality.responses(m, x[k, : lengths[k]])[0] if lengths[k] < size else quality.responses(m, x[k])[0] for k in np.flatnonzero(owner == d)])
            p = 1 / (1 + math.exp(-float(quality.combine(h) @ m.out + m.base[0])))
            total -= math.log(p if label else 1 - p) / len(y)
        return total

    grads = quality._gradients(m, x, live, owner, y)
    for which, g in enumerate(grads):
        flat = np.abs(g).ravel()
        for at in np.argsort(-flat)[:4]:
            place = np.unravel_index(at, g.shape)
            moved = []
            for e in (1e-5, -1e-5):
                p = m[which].copy()
                p[place] += e
                moved.append(loss(m._replace(**{m._fields[which]: p})))
            assert math.isclose((moved[0] - moved[1]) / 2e-5, g[place], rel_tol=2e-3, abs_tol=1e-6), (m._fields[which], place)


def test_pipeline(spark, docs, rows, empty, tmp_path):
    """The raw rows, null and repeated ids included, against the stages by brute force; and an empty table."""
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 4 and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, empty, "").count() == 0, name
    sf = tmp_path.as_uri()
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")  # one kind: all are kept
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i, t))
    left = [min(g)[3:] for g in groups.values()]
    fps = [brute_fingerprint(t) for _, t in left]
    near = brute_roots(left, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    want = Counter(min((left[k][0] for k in g), key=lambda i: (i is None, i)) for g in near)
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == want
    (tmp_path / "none").mkdir()
    empty.write.parquet(f"{sf}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0


@pytest.mark.parametrize("name", ["op9_exact_dedup", "op10_sharding", "op4_nn_descent"])
def test_query_equals_sql(spark, name):
    data = Path("/root/testdata/sf0.001")
    if not data.is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, str(data)), con.sql(queries.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.select(*cols).fetchall())
