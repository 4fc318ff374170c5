"""Token counts by a compiled finite-state tokenizer (operator 5).

``bpe.ByteBpe`` compiles pattern and merge list into one deterministic transducer
over characters whose transitions carry the change of the token count.  Every
text is cut into chunks, wherever a cut falls.  A chunk is summarised by its state
map, from states at its start to (state at its end, tokens emitted).  A map covers
the initial state and every state that the map before it leads to; chunks are read
from those independently of each other, in rounds, until nothing new comes up.
White space makes all states one, so behind a chunk's first unit its map is
constant and one more state costs one more look at that unit.  Maps are associative
under ``compose`` and combine in a parallel prefix scan; the count is what the
last entry emits from the initial state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.llm.bpe import ByteBpe, byte_bpe
from meshset.llm.common import arrow_map

#: Characters of a chunk, and chunks of which the maps are held at a time.
CHUNK, HELD = 2048, 256
START = 0
StateMap = dict[int, tuple[int, int]]


class Chunk:
    """A chunk as its first unit, where the state at the start matters, and the constant map of all that follows."""

    def __init__(self, bpe: ByteBpe, text: str):
        units = bpe.UNIT.findall(text)
        self.bpe, self.first, self.rest = bpe, units[0], None
        if len(units) > 1:
            state, n = bpe.steps[START, units[-1]]
            self.rest = state, n + sum(map(bpe.counts.__getitem__, units[1:-1]))

    def read(self, state: int) -> tuple[int, int]:
        state, n = self.bpe.steps[state, self.first]
        return (state, n) if self.rest is None else (self.rest[0], n + self.rest[1])


def state_maps(bpe: ByteBpe, texts: list[str], start: int = START) -> list[StateMap]:
    """The maps of consecutive chunks, each on the initial states and all that the one before leads to."""
    chunks = [Chunk(bpe, x) for x in texts]
    maps: list[StateMap] = [{} for _ in chunks]
    wanted = [{START}] * len(chunks)
    wanted[0] = {START, start}
    while any(wanted):
        for chunk, m, states in zip(chunks, maps, wanted, strict=True):
            m.update((s, chunk.read(s)) for s in states)
        wanted = [set(), *({to for to, _ in a.values()} - b.keys() for a, b in zip(maps, maps[1:], strict=False))]
    return maps


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of a's text followed by b's."""
    return {s: (b[to][0], n + b[to][1]) for s, (to, n) in a.items()}


def scan(maps: list[StateMap]) -> list[StateMap]:
    """Inclusive prefix scan: each round composes what lies twice as far apart, so a round's steps are independent."""
    step, out = 1, list(maps)
    while step < len(out):
        out = [m if k < step else compose(out[k - step], m) for k, m in enumerate(out)]
        step *= 2
    return out


def count_plain(bpe: ByteBpe, text: str, chunk: int = CHUNK) -> int:
    """Tokens of a text without special strings; ``HELD`` chunks at a time, so that memory is bounded on any length."""
    state, total = START, 0
    for at in range(0, len(text), HELD * chunk):
        state = bpe.carry(state)
        texts = [text[k : k + chunk] for k in range(at, min(len(text), at + HELD * chunk), chunk)]
        state, n = scan(state_maps(bpe, texts, state))[-1][state]
        total += n
    return total


def count_text(bpe: ByteBpe, text: str | None, chunk: int = CHUNK) -> int:
    """Tokens of a whole text; a special string in it is one token, as the library counts it by default."""
    if not text:
        return 0
    if bpe.special is None or not any(s in text for s in bpe.v.special):
        return count_plain(bpe, text, chunk)
    parts = bpe.special.split(text)
    return len(parts) - 1 + sum(count_plain(bpe, p, chunk) for p in parts)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (n_tokens > limit).

    A null text counts as empty, with 0 bytes and tokens; a null id stays null;
    repeated rows give repeated results; other columns, whatever their names,
    are not read.  An empty table gives an empty result.  No shuffle: the plan
    is one scan of two columns.
    """

    def run(b):
        bpe = byte_bpe(path)
        texts = [x or "" for x in b.column(1).to_pylist()]
        counts = [count_text(bpe, x) for x in texts]
        return {"doc_id": b.column(0), "n_bytes": b.column(2), "n_tokens": counts, "over_limit": [c > limit for c in counts]}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return arrow_map(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
