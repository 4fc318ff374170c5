"""License scans by patience alignment (operator 2).

Every stretch of a text that starts with a word of a notice and is less than twice
as long is aligned with the notice.  Words that occur once in both are anchors; the
longest increasing subsequence of their positions keeps those in order, and the
gaps between are aligned in the same way.  A gap without anchors is aligned by a
longest common subsequence.  Coverage is the share of the notice's words that found
a partner.

Coverage alone can't tell licenses apart, so all words of a notice that name a
license, a version or a condition must find theirs, and no such word may stand
unaligned within a find.  Where finds overlap, the one with the best score stays:
aligned words less the notice's words that are missing and the text's put in.  A
third of the notice's words is the least score.
Stretches without a needed word, or with too few words of the notice to reach the
coverage, are skipped unseen; no find can be lost by that.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.llm.common import record

#: How well-known licenses are named, and their public notices and texts.
NAMED = {
    "MIT": ["MIT"], "MIT-0": ["MIT No Attribution"], "ISC": ["ISC"], "BSD": ["BSD"], "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD"], "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD"],
    "Zlib": ["zlib"], "BSL-1.0": ["Boost Software"], "CC0-1.0": ["CC0 1.0 Universal"], "Unlicense": ["Unlicense"],
}
GNU = {
    "GPL-2.0": ("General Public", "2"), "GPL-3.0": ("General Public", "3"), "LGPL-2.1": ("Lesser General Public", "2.1"), "LGPL-3.0": ("Lesser General Public", "3"), "AGPL-3.0": ("Affero General Public", "3"),
}
COMMONS = {
    "CC-BY": ("CC BY", "Attribution"), "CC-BY-SA": ("CC BY-SA", "Attribution-ShareAlike"), "CC-BY-NC": ("CC BY-NC", "Attribution-NonCommercial"), "CC-BY-ND": ("CC BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA": ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-ND": ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "MIT": [GRANT, f"{GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY}"],
    "BSD-2-Clause": [f"{SOURCE} {DISCLAIMER}"],
    "BSD-3-Clause": [f"{SOURCE} {NEITHER} {DISCLAIMER}"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Words that name a license anywhere, those that tell licenses of one name apart, and those that number versions.
NAMES = frozenset("mit bsd isc zlib boost unlicense apache mozilla eclipse gnu commons cc cc0".split())
KINDS = {
    "gnu": frozenset("general lesser library affero".split()), "cc": frozenset("by sa nc nd".split()), "bsd": frozenset("clause simplified new modified".split()),
    "commons": frozenset("attribution sharealike noncommercial noderivatives noderivs".split()),
}
VERSIONS = frozenset("0 1 2 3 4 5".split())


def notices() -> dict[str, list[str]]:
    """All notices by license: the texts above, and the names above in the usual phrases."""
    out = {k: list(v) for k, v in TEXTS.items()}
    for license_, names in NAMED.items():
        out.setdefault(license_, []).extend(f"{verb} under the {name} License." for name in names for verb in ("Released", "Licensed"))
    for license_, (name, version) in GNU.items():
        header = f"free software: you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        out[license_] = [f"This work is licensed under the GNU {name} License, version {version}.", header]
    for license_, (short, long) in COMMONS.items():
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            out[f"{license_}-{version}"] = [f"Licensed under {short} {version}.", f"This work is licensed under a Creative Commons {long} {version} {place} License."]
    return out


WORD = re.compile(r"[^\W_]+")
#: What a find scores at least, as a share of its notice's words.
LEAST_SCORE = 1 / 3
Pairs = list[tuple[int, int]]


class Notice(NamedTuple):
    """A notice's words; those that must be aligned; words that may not stand unaligned in a find; words one of which any find has."""

    words: list[str]
    must: frozenset[str]
    foreign: frozenset[str]
    probes: frozenset[str]


class Find(NamedTuple):
    """A stretch of a text: its score, first and last word, and coverage."""

    score: int
    first: int
    last: int
    coverage: float


def notice(text: str, least: float) -> Notice:
    w = words(text)
    foreign = NAMES.union(*(KINDS[k] for k in KINDS.keys() & set(w)), VERSIONS if VERSIONS & set(w) else ())
    return Notice(w, foreign & set(w), foreign, frozenset(rarer(w, least)))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def needed(n: int, least: float) -> int:
    """How many of n words make a coverage of ``least``; products such as 0.55 * 100 may lie just above a whole number."""
    return ceil(least * n - 1e-9)


def rarer(notice: list[str], least: float) -> list[str]:
    """The longest words of a notice, until no alignment with coverage ``least`` can do without all of them."""
    got, mass, counts = [], 0, Counter(notice)
    for w in sorted(counts, key=lambda w: (-len(w), w)):
        if mass > len(notice) - needed(len(notice), least):
            break
        got.append(w)
        mass += counts[w]
    return got


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> Pairs:
    """A longest common subsequence, by the usual table over the words that both have."""
    known = set(b)
    ia = [i for i, w in enumerate(a) if w in known]
    if not ia:
        return []
    table = [[0] * (len(b) + 1)]
    for i in ia:
        up, row = table[-1], [0]
        for j, w in enumerate(b):
            row.append(up[j] + 1 if a[i] == w else max(up[j + 1], row[j]))
        table.append(row)
    out, i, j = [], len(ia), len(b)
    while i and j:
        if a[ia[i - 1]] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((ia[i], j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str]) -> Pairs:
    """Pairs (position in a, position in b) of equal words, increasing in both."""
    once_a, once_b = Counter(a), Counter(b)
    where_b = {w: j for j, w in enumerate(b) if once_b[w] == 1 and once_a[w] == 1}
    anchors = [(i, where_b[w]) for i, w in enumerate(a) if w in where_b]
    if not anchors:
        return common(a, b)
    out: Pairs = []
    low_a = low_b = 0
    for i, j in [*(anchors[k] for k in increasing([j for _, j in anchors])), (len(a), len(b))]:
        out += [(low_a + x, low_b + y) for x, y in align(a[low_a:i], b[low_b:j])]
        if i < len(a):
            out.append((i, j))
        low_a, low_b = i + 1, j + 1
    return out


def judge(text: list[str], start: int, n: Notice, need: int) -> Find | None:
    """The find that begins at a place of the text, if there is one."""
    pairs = align(text[start : start + 2 * len(n.words) - 1], n.words)
    if len(pairs) < need or pairs[0][0]:
        return None
    partners = {j for _, j in pairs}
    if any(w in n.must and j not in partners for j, w in enumerate(n.words)):
        return None
    end, aligned = pairs[-1][0], {i for i, _ in pairs}
    if any(text[start + i] in n.foreign and i not in aligned for i in range(end)):
        return None
    inserted, missing = end + 1 - len(pairs), len(n.words) - len(pairs)
    score = len(pairs) - missing - inserted
    enough = min(LEAST_SCORE * len(n.words), 2 * need - len(n.words))  # a bare find of the least coverage always passes
    return Find(score, start, start + end, len(pairs) / len(n.words)) if score >= enough else None


def apart(finds: list) -> list:
    """The best-scored finds of those that overlap, the first ones of equals, in the order of the text."""
    kept: list = []
    for f in sorted(finds, key=lambda f: (-f.score, f.first, f.last)):
        k = bisect_left(kept, f.first, key=lambda x: x.first)
        if (k == 0 or kept[k - 1].last < f.first) and (k == len(kept) or f.last < kept[k].first):
            kept.insert(k, f)
    return kept


def find(text: list[str], n: Notice, least: float) -> list[Find]:
    """Non-overlapping finds of a notice, in the order of the text."""
    need, width, want = needed(len(n.words), least), 2 * len(n.words) - 1, Counter(n.words)
    there = set(text)
    if not n.must <= there:
        return []
    # a find has the rarest of the words that it must have, or else one of the probes
    sought = {min(n.must, key=text.count)} if n.must else n.probes
    held, shared, start, end, low, out = Counter(), 0, 0, 0, 0, []
    for p in (p for p, w in enumerate(text) if w in sought):
        for s in range(max(low, p - width + 1), p + 1):
            # words that stretch and notice share bound every alignment; the counts slide along
            if s >= end:
                held, shared, start, end = Counter(), 0, s, s
            for w in text[end : s + width]:
                held[w] += 1
                shared += held[w] <= want[w]
            for w in text[start:s]:
                shared -= held[w] <= want[w]
                held[w] -= 1
            start, end = s, max(end, min(len(text), s + width))
            if s < low or shared < need or text[s] not in want:
                continue
            if f := judge(text, s, n, need):
                out.append(f)
                if f.score == len(n.words):  # none can be better, and those that overlap it and start later lose
                    low = f.last + 1
        low = max(low, p + 1)
    return apart(out)


SCHEMA = "doc_id long, license string, coverage double, n_matches long, first_word long, last_word long"


class Named(NamedTuple):
    score: int
    first: int
    last: int
    coverage: float
    license: str


def licenses_of(text: list[str], sought: list[tuple[str, Notice]], least: float) -> dict[str, list[Named]]:
    """The finds of a text's words by license; of notices whose finds overlap, the best-scored stays."""
    every = [Named(*f, name) for name, n in sought for f in find(text, n, least)]
    out: dict[str, list[Named]] = {}
    for f in apart(every):
        out.setdefault(f.license, []).append(f)
    return out


def scan(df: DataFrame, least: float = 0.8, known: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license of which a notice was found with at least ``least`` of its words aligned.

    ``coverage`` is that of the best find, the first one of equals, ``first_word``
    and ``last_word`` are its place among the text's words, ``n_matches`` counts
    all finds.  Null and empty texts have none; a null id stays null; repeated
    rows give repeated results; other columns, whatever their names, are not
    read.  Empty in, empty out.  No shuffle: one scan of two columns.
    """
    sought = [(name, notice(x, least)) for name, texts in (known or notices()).items() for x in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = (text or "").lower()
                near = [(name, n) for name, n in sought if (all(w in low for w in n.must) if n.must else any(w in low for w in n.probes))]
                for name, found in licenses_of(words(text), near, least).items() if near else ():
                    best = max(found, key=lambda f: (f.coverage, -f.first))
                    for c, x in zip(out.values(), (i, name, best.coverage, len(found), best.first, best.last), strict=True):
                        c.append(x)
            if out["doc_id"]:
                yield record(out, SCHEMA)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
