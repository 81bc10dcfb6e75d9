"""Byte-level BPE as a reduction over a balanced tree of text halves.

A text is halved until its parts are short, the parts are encoded, and neighbours are joined. A join
re-encodes a window around the seam that grows until the tokens outside it provably stay as they are:

* No alternative of the split pattern crosses from a visible character to white space, so such a place
  is a piece boundary of every text that holds it, whatever lies around. In ordinary text the window
  ends at the nearest such places, a few characters from the seam.
* Where these are far away (one giant word, scripts without spaces), the pieces around the seam are
  found again from the first piece that the text behind the seam could change (it ends at the seam or begins
  within two characters of it) to the first boundary that the right part has as well. Inside a
  piece the window grows token by token: a sequence is what BPE yields if each pair of
  neighbours is, so the tokens outside stand as soon as the window's outermost token on each
  side is the one that was there before.

Decoding concatenates bytes up the same kind of tree. Texts of any length take a recursion of
logarithmic depth, and no part is longer than ``leaf`` for the splitter, which fails on huge runs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sparkwatch.llm.common import byte_bpe, rank_file, texts_of, vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, tokens of a leaf when decoding.
LEAF = 2048
#: A window between two sure boundaries is encoded as a whole up to this many characters.
NEAR = 1024
ID_TYPE = "<u4"


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, leaf: int = LEAF, near: int = NEAR):
        import public_tokenizers

        self.leaf, self.near = max(4, leaf), near
        self.bpe = byte_bpe(path)
        ranks = rank_file(path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = [len(x) for x in self.bytes_of]
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if text[mid] in " \n" and not text[mid - 1].isspace():
            return left + right
        begin, end = _boundary_before(text, lo, mid), _boundary_after(text, mid, hi)
        kept = len(left) - self._count(reversed(left), len(text[begin:mid].encode()))
        taken = self._count(right, len(text[mid:end].encode()))
        if end - begin <= self.near:
            window = self.bpe.encode_ordinary(text[begin:end])
        else:
            window = self._seam(text, begin, mid, end, left[kept:], right[:taken])
        return left[:kept] + window + right[taken:]

    def _count(self, tokens, n_bytes: int) -> int:
        """How many of the first tokens make up so many bytes."""
        n = 0
        for token in tokens:
            if n_bytes <= 0:
                break
            n_bytes -= self.size[token]
            n += 1
        return n

    def _seam(self, text: str, begin: int, mid: int, end: int, left: list[int], right: list[int]) -> list[int]:
        before = [m.span() for m in self.pattern.finditer(text, begin, mid)]
        after = [m.span() for m in self.pattern.finditer(text, mid, end)]
        at = next((s for s, e in before if s > mid - 3 or e == mid), mid)
        known = {s for s, _ in after} | {end}
        pieces = []
        cut = at
        while at < mid or at not in known:
            pieces.append(self.pattern.match(text, at, end).span())
            at = pieces[-1][1]
        tail = self._count(reversed(right), len(text[at:end].encode()))
        head = self._count(left, len(text[begin:cut].encode()))
        made = left[:head]
        left_end, right_start = dict(before), {e: s for s, e in after}
        for s, e in pieces:
            known_left: list[int] = []
            known_right: list[int] = []
            stop, start = s, e
            if s in left_end and left_end[s] <= e:
                stop = left_end[s]
                skip = self._count(left, len(text[begin:s].encode()))
                known_left = left[skip : skip + self._count(left[skip:], len(text[s:stop].encode()))]
            if e in right_start and right_start[e] >= stop:
                start = right_start[e]
                skip = self._count(right, len(text[mid:start].encode()))
                known_right = right[skip : skip + self._count(right[skip:], len(text[start:e].encode()))]
            made += self._piece(known_left, text[stop:start].encode(), known_right)
        return made + right[len(right) - tail :]

    def _piece(self, left: list[int], between: bytes, right: list[int]) -> list[int]:
        """The tokens of one piece whose ends are encoded already."""
        width = 1
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            inner = b"".join(map(self.bytes_of.__getitem__, left[len(left) - a :])) + between
            inner += b"".join(map(self.bytes_of.__getitem__, right[:b]))
            window = self.bpe._encode_single_piece(inner) if inner else []
            left_stands = a == len(left) or window[:1] == [left[len(left) - a]]
            right_stands = b == len(right) or window[-1:] == [right[b - 1]]
            if left_stands and right_stands:
                return left[: len(left) - a] + window + right[b:]
            width *= 2

    def decode(self, ids) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _boundary_before(text: str, lo: int, mid: int) -> int:
    """The last place before ``mid`` with a visible character to its left and white space to its right, or ``lo``."""
    at = mid
    while True:
        at = max(text.rfind(" ", lo + 1, at), text.rfind("\n", max(lo + 1, at - 256), at))
        if at < 0:
            return lo
        if not text[at - 1].isspace():
            return at


def _boundary_after(text: str, mid: int, hi: int) -> int:
    at = mid
    while True:
        at = text.find(" ", at + 1, hi)
        if at < 0:
            return hi
        if not text[at - 1].isspace():
            return at


@lru_cache(maxsize=2)
def codec(name: str, leaf: int = LEAF) -> Codec:
    return Codec(name if name.startswith("/") else vocabulary(name), leaf)


def encode(df: DataFrame, text: str = "text", out: str = "ids", name: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``df`` with ``out``: the text's token ids as little-endian 32-bit integers, in one binary value.

    ``name`` is a public vocabulary or an absolute path of a rank file on the workers. A text that is missing or empty has an empty value.
    A column named ``out`` is replaced; all others stay. Rows are independent, so repeated rows give repeated results.
    """

    def ids(column: pa.Array) -> pa.Array:
        to = codec(name, leaf)
        return pa.array([np.array(to.encode(x), ID_TYPE).tobytes() for x in texts_of(column)], pa.binary())

    return df.withColumn(out, F.arrow_udf(ids, "binary")(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", name: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``df`` with ``out``: the bytes of the tokens in ``ids``; missing or empty ids give an empty value."""

    def back(column: pa.Array) -> pa.Array:
        to = codec(name, leaf)
        return pa.array([to.decode(np.frombuffer(x or b"", ID_TYPE).tolist()) for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, F.arrow_udf(back, "binary")(F.col(ids)))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = VOCABULARY) -> DataFrame:
    """Per document: the number of tokens and the SHA-256 of its ids and of what they decode to."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = decode(encode(rows, name=name), name=name)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
