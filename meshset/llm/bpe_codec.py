"""BPE encoding and decoding as streaming transducers (operator 7).

Encoding runs ``bpe.Machine.stream``: symbols go in one by one, and tokens come
out once no later symbol within the merge list's lookahead can move them, so a
piece of any length needs constant memory.  Decoding is a state machine from
bytes to text: a token brings its bytes, before it the separator that is due where
a file has no decoder, and characters come out as their bytes are complete.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.llm.bpe import Vocabulary, word_bpe
from meshset.llm.common import arrow_map


class Detokenizer:
    """Ids to text, incrementally: ``feed`` any number of times, then ``finish``.

    With a byte-level decoder the tokens' bytes are joined and turned into text
    as they complete characters (broken bytes become the replacement character);
    without a decoder tokens are joined by one space, special ones included.  What
    is held between calls is an unfinished character and whether a separator is due.
    """

    def __init__(self, vocab: Vocabulary):
        self.raw, self.between = raw_bytes(vocab)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.due = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.raw.__getitem__, ids))
        if not data:
            return ""
        data, self.due = self.due + data, self.between
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


def raw_bytes(vocab: Vocabulary) -> tuple[dict[int, bytes], bytes]:
    """The bytes of each token, and those between two tokens."""
    if not hasattr(vocab, "raw"):
        own = bool(vocab.spec.get("decoder"))
        vocab.raw = {i: bytes(vocab.bytes_of[c] for c in s) if own and all(c in vocab.bytes_of for c in s) else s.encode() for i, s in vocab.strings.items()}, b"" if own else b" "
    return vocab.raw


def decode_ids(vocab: Vocabulary, ids: list[int], block: int = 1 << 16) -> str:
    machine = Detokenizer(vocab)
    return "".join([*(machine.feed(ids[k : k + block]) for k in range(0, len(ids), block)), machine.finish()])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text; a null or empty text has no ids; other columns are not read."""

    def run(b):
        bpe = word_bpe(path)
        return {"doc_id": b.column(0), "ids": [array("I", bpe.ids_bytes(x)).tolist() for x in b.column(1).to_pylist()]}

    return arrow_map(_two(df, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every list of ids; a null list decodes to the empty text."""

    def run(b):
        v = word_bpe(path).v
        return {"doc_id": b.column(0), "text": [decode_ids(v, x or []) for x in b.column(1).to_pylist()]}

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts: counts and digests of the ids and of the decoded text.

    Ids pass from the encoder through the decoder in blocks and are never held
    whole.  One row per input row, repeated rows included: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by a space), ``decoded_sha256``.  A null id
    stays null; null and empty texts have 0 tokens and the digests of the empty
    string; other columns, whatever their names, are not read.  Empty in, empty out.
    """

    def run(b):
        bpe = word_bpe(path)
        numbers = _decimals(path)
        out = {"doc_id": b.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in b.column(1).to_pylist():
            n, said, back, machine = 0, hashlib.sha256(), hashlib.sha256(), Detokenizer(bpe.v)
            for ids in filter(None, bpe.stream(text)):
                said.update(((" " if n else "") + " ".join(map(numbers.__getitem__, ids))).encode())
                back.update(machine.feed(ids).encode())
                n += len(ids)
            back.update(machine.finish().encode())
            out["n_tokens"].append(n)
            out["ids_sha256"].append(said.hexdigest())
            out["decoded_sha256"].append(back.hexdigest())
        return out

    return arrow_map(_two(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_numbers: dict[str, list[str]] = {}


def _decimals(path: str) -> list[str]:
    if path not in _numbers:
        _numbers[path] = [str(k) for k in range(1 + max(word_bpe(path).v.strings))]
    return _numbers[path]


def _two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
