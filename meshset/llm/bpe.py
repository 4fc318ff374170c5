"""Byte-pair encoding as a finite-state machine, compiled lazily from a merge list.

Two facts carry everything here.  An encoding stays right when cut after any
token, so the encoding of a text's first i symbols is the encoding of a shorter
head plus one last token.  And a token sequence is the encoding of its text if
and only if each two neighbours in it stay apart when encoded by themselves.
The machine therefore reads symbol by symbol and keeps, for the few last
positions that a later token may still reach back to, the last token of the
encoding that ends there.  That window is its state: finitely many exist, and
each transition is worked out once and kept.

Which characters are letters, numbers or white space, and how text is normalised,
is asked of the tokenizer file's own normalizer and splitter, as the answers
depend on their version of Unicode; ASCII and common letters need no asking.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: White space as the tokenizer libraries' patterns take it, to stand in a class of a pattern (fixed values).
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
END_OF_WORD, EMIT = 256, 512
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(f"[{WS}]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and the seams at which two tokens would merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # its normalizer and its splitter; merges are ours
        model = self.spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.ids[a], self.ids[b]] = r
            self.made.setdefault(self.ids[a + b], (self.ids[a], self.ids[b], r))
        self.longest = max(len(s.removesuffix(self.suffix)) for s in self.ids)
        table = byte_alphabet()
        self.bytes_of = {c: b for b, c in table.items()}
        self.width = [0] * (1 + max(self.strings))
        for i, t in self.strings.items():
            self.width[i] = len(t) - (len(self.suffix) if self.suffix and t.endswith(self.suffix) else 0)
        self._edge: tuple[dict, dict] = ({}, {})
        self._apart: dict[int, bool] = {}
        self._compile_trie()

    def _compile_trie(self) -> None:
        """All tokens as paths of symbols: a byte, or 256 more for the byte that ends a word with the suffix."""
        goto: dict[int, int] = {}
        token, depth, parent = [-1], [0], [(0, 0)]
        for text, i in self.ids.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            symbols = [self.bytes_of[c] for c in (text.removesuffix(self.suffix) if ends else text)]
            if ends:
                symbols[-1] += END_OF_WORD
            node = 0
            for c in symbols:
                child = goto.get(node << 9 | c)
                if child is None:
                    child = goto[node << 9 | c] = len(token)
                    token.append(-1)
                    depth.append(depth[node] + 1)
                    parent.append((node, c))
                node = child
            token[node] = i
        n = len(token)
        self.goto, self.token, self.depth = goto, token, depth
        self.fail, self.shorter = [0] * n, [0] * n  # the longest shorter suffix on the trie; the longest one that is a token
        leaf = [True] * n
        for node in sorted(range(1, n), key=depth.__getitem__):
            up, c = parent[node]
            leaf[up] = False
            if up:
                self.fail[node] = f = self.advance(self.fail[up], c)
                self.shorter[node] = f if token[f] >= 0 else self.shorter[f]
        self.reach = list(range(n))  # the longest suffix that a longer token may still begin with
        for node in sorted(range(1, n), key=depth.__getitem__):
            if leaf[node]:
                self.reach[node] = self.reach[self.fail[node]]

    def advance(self, node: int, symbol: int) -> int:
        goto, fail = self.goto, self.fail
        while True:
            to = goto.get(node << 9 | symbol)
            if to is not None:
                return to
            if not node:
                return 0
            node = fail[node]

    @property
    def lookahead(self) -> int:
        """Symbols after a position that can still move a token boundary at it: one less than the longest token has."""
        return self.longest - 1

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The outermost parts on one side of a token, each with the rank of the merge that absorbs it."""
        got = self._edge[side].get(token)
        if got is None:
            got, absorbed, t = [], 1 << 60, token
            while True:
                got.append((t, absorbed))
                if t not in self.made:
                    break
                absorbed = self.made[t][2]
                t = self.made[t][side]
            self._edge[side][token] = got
        return got

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two tokens when their texts are encoded as one.

        They don't if some part at the end of a and some part at the start of b
        exist at the time of the merge of both: before either is absorbed, where
        of two merges of one rank the left one goes first.
        """
        key = a << 20 | b
        got = self._apart.get(key)
        if got is None:
            rank = self.rank
            got = not any((q := rank.get((x, y))) is not None and q < px and q <= py for x, px in self._spine(a, 1) for y, py in self._spine(b, 0))
            if len(self._apart) > 300_000:
                self._apart.clear()
            self._apart[key] = got
        return got


class Machine:
    """The deterministic transducer of a merge list, one state per distinct window.

    A state is a node of the trie of all tokens (the longest suffix that a later
    token may begin with) and, for each position that this suffix covers, the last
    token of the encoding that ends there and its token count, relative to the
    present one.  A transition holds the next state, the last token and
    ``emitted``: by how much the number of tokens of what was read changes, so
    that it sums to the token count.  All are numbers, kept in two tables of up to
    ``max_states`` states and then built anew; results don't depend on that.
    """

    def __init__(self, vocab: Vocabulary, max_states: int = 300_000):
        self.v, self.max_states = vocab, max_states
        self.reset()

    def reset(self) -> None:
        first = array("i", [0, -1, 0]).tobytes()
        self.states, self.ids = [first], {first: 0}
        self.next: dict[int, int] = {}

    def build(self, state: int, symbol: int) -> int:
        """Work out one transition and keep it: next state << 27 | last token << 10 | emitted + EMIT."""
        v = self.v
        node, *window = array("i", self.states[state])
        n = len(window) // 2
        tokens, counts = window[:n], window[n:]
        full = v.advance(node, symbol)
        k = full if v.token[full] >= 0 else v.shorter[full]
        while True:  # the longest candidate first; exactly one fits
            t, size = v.token[k], v.depth[k]
            if tokens[-size] < 0 or v.apart(tokens[-size], t):
                break
            k = v.shorter[k]
        emitted = counts[-size] + 1
        to = 0
        if symbol < END_OF_WORD:
            node = v.reach[full]
            keep = v.depth[node] + 1
            key = array("i", [node, *[*tokens, t][-keep:], *[c - emitted for c in [*counts, emitted][-keep:]]]).tobytes()
            to = self.ids.get(key)
            if to is None:
                to = self.ids[key] = len(self.states)
                self.states.append(key)
        got = self.next[state << 9 | symbol] = to << 27 | t << 10 | emitted + EMIT
        return got

    def encode(self, symbols: list[int] | bytes) -> list[int]:
        """Ids of one piece; a short one needs no look at what is settled on the way."""
        if len(symbols) >= 8 * self.v.longest:
            return [i for ids in self.stream(symbols) for i in ids]
        if len(self.states) > self.max_states:
            self.reset()
        get, build, s, hits = self.next.get, self.build, 0, []
        for c in symbols:
            hit = get(s << 9 | c) or build(s, c)
            s = hit >> 27
            hits.append(hit)
        out, width, end = [], self.v.width, len(hits)
        while end > 0:
            t = hits[end - 1] >> 10 & 131071
            out.append(t)
            end -= width[t]
        out.reverse()
        return out

    def stream(self, symbols: Iterable[int]) -> Iterator[list[int]]:
        """Ids of one piece, emitted as soon as no later symbol can change them.

        Positions further back than the lookahead are settled once the chains of
        all positions inside it meet in one boundary; what lies before that
        boundary is emitted and forgotten, so memory stays constant on any length.
        """
        if len(self.states) > self.max_states:
            self.reset()
        get, build, s, limit = self.next.get, self.build, 0, 8 * self.v.longest
        last: list[int] = []  # last[i]: the last token after i + 1 symbols that aren't emitted yet
        for c in symbols:
            hit = get(s << 9 | c) or build(s, c)
            s = hit >> 27
            last.append(hit >> 10 & 131071)
            if len(last) >= limit:
                live = set(range(max(0, len(last) - self.v.lookahead), len(last) + 1))
                while len(live) > 1:
                    p = max(live)
                    live.discard(p)
                    live.add(p - self.v.width[last[p - 1]])
                stable = live.pop()
                yield self._back(last, stable)
                last = last[stable:]
                limit = len(last) + 8 * self.v.longest
                if len(self.states) > self.max_states:  # the state goes on in a fresh table
                    here = self.states[s]
                    self.reset()
                    s = self.ids.setdefault(here, 1)
                    self.states.append(here)
        yield self._back(last, len(last))

    def _back(self, last: list[int], end: int) -> list[int]:
        got, width = [], self.v.width
        while end > 0:
            t = last[end - 1]
            got.append(t)
            end -= width[t]
        got.reverse()
        return got


class _Words:
    """Texts of a lower-casing file with word ends (NFC, white space dropped) to ids; the merges are a subclass's.

    Pieces never reach over white space, so the ids of each run of other characters
    are kept in a table of bounded size.
    """

    #: Letters of common scripts that all versions of Unicode treat alike, and what may stand between them; no marks.
    LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef"
    ODD = regex.compile(f"[^\x00-\x7f{LETTERS}\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027]")
    #: The file's pattern for text of such characters.
    PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")

    def __init__(self, spec: dict, library: Tokenizer, kept: int):
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("this file is not a lower-casing BPE with word ends")
        self.library = library
        self.bytes_of = {c: b for b, c in byte_alphabet().items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.table = _Table(self._run, kept)
        self.pieces = _Table(self._piece, kept // 2)

    def _piece(self, piece: bytes) -> bytes:
        raise NotImplementedError

    def _split(self, run: str) -> list[bytes]:
        """The pieces of a run of other characters than white space, as the file's normalizer and splitter make them."""
        if run.isascii() or not self.ODD.search(run):
            run = run.lower()
            return [run.encode()] if run.isalpha() else [x.encode() for x in self.PIECE.findall(run)]
        norm, raw = self.library.normalizer.normalize_str(run), self.bytes_of
        return [bytes(map(raw.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self._split(run)))

    def forget(self) -> None:
        """Start all tables anew, where other work follows in the same process."""
        self.table.clear()
        self.pieces.clear()

    def runs(self, text: str) -> list[str]:
        """The text's runs of characters other than white space; composing and lower-casing never reach over it."""
        if text.isascii() or not self.ODD.search(text):
            text = text.lower()
        return [w for w in regex.split(f"[{WS}]+", text) if w] if _ODD_SPACE.search(text) else text.split()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, self.runs(text)))

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """What lies between special strings, and the id of the one that follows."""
        at = 0
        if any(s in text for s in self.specials):
            for m in self.special.finditer(text):
                yield text[at : m.start()], self.specials[m[0]]
                at = m.end()
        yield text[at:] if at else text, None

    def ids_bytes(self, text: str | None) -> bytes:
        out = [self._plain(x) + (b"" if i is None else i.to_bytes(4, "little")) for x, i in self._parts(text or "")]
        return out[0] if len(out) == 1 else b"".join(out)


class WordBpe(_Words):
    """Lower-casing BPE with word ends (NFC, white space dropped): texts to ids and back.

    ``ids_bytes`` gives a text's ids as little-endian 32-bit integers, ``stream``
    the same in blocks.  Pieces never reach over white space, so the ids of each
    run of other characters are kept in a table of bounded size.
    """

    LONG, BLOCK = 1 << 12, 1 << 16

    def __init__(self, path: str, kept: int = 700_000):
        self.v = Vocabulary(path)
        super().__init__(self.v.spec, self.v.library, kept)
        self.machine = Machine(self.v)

    def _symbols(self, piece: bytes) -> list[int]:
        symbols = [*piece]
        symbols[-1] += END_OF_WORD
        return symbols

    def _piece(self, piece: bytes) -> bytes:
        return array("I", self.machine.encode(self._symbols(piece))).tobytes()

    def forget(self) -> None:
        super().forget()
        self.machine.reset()
        self.v._apart.clear()

    def stream(self, text: str | None) -> Iterator[list[int]]:
        """A text's ids in blocks; no block grows with the text, not even where it has no white space."""
        for part, special in self._parts(text or ""):
            for block in self._blocks(part):
                if len(block) <= 2 * self.BLOCK:
                    yield array("I", self._plain(block)).tolist()
                    continue
                for run in self.runs(block):
                    for piece in self._split(run):
                        yield from self.machine.stream(self._symbols(piece))
            if special is not None:
                yield [special]

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that end before white space, of about ``BLOCK`` characters where there is any."""
        at = 0
        while len(text) - at > self.BLOCK:
            m = _SPACE.search(text, at + self.BLOCK)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text


class WordIds(_Words):
    """Texts to ids of the same file with the merges of the tokenizers library, for work that needs ids of whole texts only.

    A process holds no tables of the merges in Python: it starts sooner, is smaller, and a new piece costs less.
    """

    def __init__(self, path: str, kept: int = 700_000):
        with open(path, encoding="utf-8") as f:
            super().__init__(json.load(f), Tokenizer.from_file(path), kept)
        self.merge = self.library.model.tokenize
        self.printable = {b: c for b, c in byte_alphabet().items() if chr(b) != c}

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = text.translate(self.printable)
        return array("I", [t.id for t in self.merge(text)]).tobytes()


class ByteBpe:
    """Byte-level BPE whose pieces start at white space, as one transducer over the characters of whole texts.

    A state is what kind of piece is open, the state of ``Machine`` inside it, and
    for white space its last character and what that added.  A transition on a
    character carries by how much the token count of what was read changes, taken
    as a text of its own, so the sum over any text is its token count.  States are
    numbers; the transitions, and those of whole units (a run of white space and
    what follows it), are worked out when first met and kept in tables of bounded
    size, and ``reset`` starts them anew.
    """

    CLOSED, LETTER, NUMBER, OTHER, SPACE, QUOTE = 0, 1, 2, 3, 4, 5  # and the character after a quote that awaits its second
    SECOND = {ord("r"): "e", ord("v"): "e", ord("l"): "l"}
    BIAS = 1 << 15
    UNIT = regex.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")

    def __init__(self, path: str, kept: int = 300_000):
        self.v = Vocabulary(path)
        if self.v.spec["normalizer"] or self.v.suffix or not self.v.spec["pre_tokenizer"].get("use_regex"):
            raise ValueError("this file is not a plain byte-level BPE")
        self.machine = Machine(self.v)
        self.special = regex.compile("|".join(map(regex.escape, self.v.special))) if self.v.special else None
        self.kinds = {c: self.LETTER if c.isalpha() else self.NUMBER if c.isdigit() else self.SPACE if c in "\t\n\x0b\x0c\r " else self.OTHER for c in map(chr, range(128))}
        self.counts = _Table(lambda unit: self.read(0, unit)[1], kept)
        self.steps = _Table(lambda key: self.read(*key), kept // 4, lambda key: len(key[1]))
        self.reset()

    def reset(self) -> None:
        self.machine.reset()
        self.states, self.ids, self.next = [(self.CLOSED, 0, "", 0)], {(self.CLOSED, 0, "", 0): 0}, {}
        self.counts.clear()
        self.steps.clear()

    @property
    def full(self) -> bool:
        return max(len(self.states), len(self.machine.states)) > self.machine.max_states

    def kind(self, c: str) -> int:
        """What the file's splitter takes a character for, by whether it stays in one piece with one of that kind."""
        got = self.kinds.get(c)
        if got is None:
            parts = self.v.library.pre_tokenizer.pre_tokenize_str
            got = self.kinds[c] = next((k for k, x in ((self.LETTER, "a"), (self.NUMBER, "1"), (self.OTHER, "!")) if len(parts(x + c)) == 1), self.SPACE)
        return got

    def _feed(self, inner: int, text: str) -> tuple[int, int]:
        """The machine's state after more of a piece, and the change of its token count."""
        m, total = self.machine, 0
        for b in text.encode("utf-8"):
            hit = m.next.get(inner << 9 | b) or m.build(inner, b)
            inner, total = hit >> 27, total + (hit & 1023) - EMIT
        return inner, total

    def _open(self, kind: int, c: str) -> tuple[tuple, int]:
        inner, n = self._feed(0, c)
        return (self.QUOTE if c == "'" else kind, inner, "", 0), n

    def _move(self, state: tuple, c: str) -> tuple[tuple, int]:
        """The transition on one character: the next state and the change of the count."""
        mode, inner, last, gone = state
        kind = self.kind(c)
        if kind == self.SPACE:  # one more of a run, or the first one after another piece
            inner, n = self._feed(inner if mode == self.SPACE else 0, c)
            return (self.SPACE, inner, c, n), n
        if mode == self.SPACE:  # the run's last character leaves it, and a blank joins what follows
            inner, n = self._feed(0, last)
            if last != " ":
                to, more = self._open(kind, c)
                return to, n + more - gone
            inner, more = self._feed(inner, c)
            return (kind, inner, "", 0), n + more - gone
        if mode == self.QUOTE:
            if c in ("s", "t", "m", "d"):
                return (self.CLOSED, 0, "", 0), self._feed(inner, c)[1]
            if c in ("r", "v", "l"):
                inner, n = self._feed(0, c)
                return (ord(c), inner, "", 0), n
            mode = self.OTHER
        if self.SECOND.get(mode) == c:
            apart = self._feed(0, "'")[1] + self._feed(0, chr(mode))[1]
            return (self.CLOSED, 0, "", 0), self._feed(0, "'" + chr(mode) + c)[1] - apart
        if mode in self.SECOND:
            mode = self.LETTER
        if mode == kind:
            inner, n = self._feed(inner, c)
            return (kind, inner, "", 0), n
        return self._open(kind, c)

    def number(self, state: tuple) -> int:
        got = self.ids.get(state)
        if got is None:
            got = self.ids[state] = len(self.states)
            self.states.append(state)
        return got

    def build(self, s: int, c: str) -> int:
        """Work out one transition and keep it: next state << 16 | change of the count + BIAS."""
        to, n = self._move(self.states[s], c)
        got = self.next[s << 21 | ord(c)] = self.number(to) << 16 | n + self.BIAS
        return got

    def read(self, s: int, text: str) -> tuple[int, int]:
        """The state after a text that is read from state s, and the change of the count."""
        get, total = self.next.get, 0
        for c in text:
            hit = get(s << 21 | ord(c)) or self.build(s, c)
            s = hit >> 16
            total += hit & 0xFFFF
        return s, total - self.BIAS * len(text)

    def carry(self, s: int) -> int:
        """The same state in fresh tables, where the old ones are full."""
        if self.full:
            mode, inner, last, gone = self.states[s]
            window = self.machine.states[inner]
            self.reset()
            if window not in self.machine.ids:
                self.machine.ids[window] = len(self.machine.states)
                self.machine.states.append(window)
            s = self.number((mode, self.machine.ids[window], last, gone))
        return s


class _Table(dict):
    """A function's values, kept up to a number of entries and then started anew; long keys aren't kept."""

    def __init__(self, fn, most: int, size=len):
        self.fn, self.most, self.size = fn, most, size

    def __missing__(self, key):
        got = self.fn(key)
        if self.size(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = got
        return got


@lru_cache(maxsize=4)
def word_bpe(path: str, kept: int = 700_000) -> WordBpe:
    """One per worker process and size of its word table; the size changes speed and memory, not results."""
    gc.set_threshold(500_000, 20, 100)  # the tables are many small objects without cycles
    return WordBpe(path, kept)


@lru_cache(maxsize=4)
def word_ids(path: str, kept: int = 700_000) -> WordIds:
    """One per worker process and size of its word table; the size changes speed and memory, not results."""
    gc.set_threshold(500_000, 20, 100)  # the table is large and has no cycles
    return WordIds(path, kept)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process."""
    gc.set_threshold(500_000, 20, 100)
    return ByteBpe(path)

