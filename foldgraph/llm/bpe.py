"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A byte string is encoded by encoding its halves and joining the two token lists.
The join re-encodes a window of bytes around the boundary, first one token on
each side, then two, four ... until the tokens next to the window are provably
stable.  The proof rests on one property of rank-ordered merging: a token list is
the encoding of its bytes exactly if every adjacent pair of it is the encoding of
the pair's bytes.  The list left of the window, the window's encoding and the
list right of it each have that property, so only the two seams are tested.

Words of a text (the matches of the split pattern) never merge with each other,
so up the tree from there joining is concatenation; decoding concatenates all the
way up.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Byte strings of at most this length are leaves of the tree.
LEAF = 12
#: Entries of a worker's memo of encoded words, after which it starts afresh.
MEMO = 600_000
#: Entries of its memo of neighbouring tokens.
PAIRS = 100_000

_NONE = 1 << 60
_BYTES = [bytes([i]) for i in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TreeBpe:
    """Encoder and decoder for one rank table and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, memo: int = MEMO):
        self.ranks, self.leaf, self.most = ranks, max(1, leaf), memo
        self.split = regex.compile(pattern).findall
        self.tokens = {v: k for k, v in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain rank-ordered merging, leftmost pair first among equals: for leaves and windows."""
        get = self.ranks.get
        parts = [_BYTES[b] for b in piece]
        rank = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], _NONE)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        return parts

    def stable(self, a: bytes, b: bytes) -> bool:
        """Is ``[a, b]`` the encoding of ``a + b``?"""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            window = self.merged(b"".join(left[-a:] + right[:b]))
            seam_left = a == len(left) or self.stable(left[-a - 1], window[0])
            seam_right = b == len(right) or self.stable(window[-1], right[b])
            if seam_left and seam_right:
                return left[: len(left) - a] + window + right[b:]
            if not seam_left:
                a = min(2 * a, len(left))
            if not seam_right:
                b = min(2 * b, len(right))

    def tree(self, piece: bytes) -> list[bytes]:
        """Encode halves and join them, level by level from the leaves."""
        n = self.leaf
        if len(piece) <= n:
            return self.merged(piece)
        level = [self.merged(piece[i : i + n]) for i in range(0, len(piece), n)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _word(self, word: str) -> bytes:
        piece = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.tree(piece)]
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers (null: none)."""
        words = self.split(text or "")
        memo = self.memo
        if new := set(words).difference(memo):
            if len(memo) + len(new) > self.most:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = self._word(w)
        return b"".join([memo[w] for w in words])

    def decode(self, ids: bytes | None, block: int = 4096) -> bytes:
        """The bytes of ids: blocks are concatenated, then neighbours up the tree."""
        ids, tokens = ids or b"", self.tokens
        level = [b"".join([tokens[i] for i in memoryview(ids[k : k + 4 * block]).cast("I")]) for k in range(0, len(ids), 4 * block)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def worker_bpe(path: str, pattern: str) -> TreeBpe:
    """One encoder for each Python worker and vocabulary."""
    return TreeBpe(read_ranks(path), pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """BINARY: the ids of a text column, little-endian unsigned 32-bit."""

    @F.arrow_udf("binary")
    def encode(t: pa.Array) -> pa.Array:
        return pa.array(list(map(worker_bpe(path, pattern).encode, t.to_pylist())), pa.binary())

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """BINARY: the bytes that ids stand for."""

    @F.arrow_udf("binary")
    def decode(t: pa.Array) -> pa.Array:
        return pa.array(list(map(worker_bpe(path, pattern).decode, t.to_pylist())), pa.binary())

    return decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids, decoded)``: the ids of each whole text and the bytes they decode to.

    Null and empty texts have no ids.  One row for each row of ``docs``; repeated
    rows and null keys are ordinary rows.  Both directions run in one pass.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def both(t: pa.Array) -> pa.Array:
        bpe = worker_bpe(path, pattern)
        ids = list(map(bpe.encode, t.to_pylist()))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(list(map(bpe.decode, ids)), pa.binary())], ["ids", "decoded"])

    return docs.select(F.col(key), both(F.col(text)).alias("x")).select(key, "x.ids", "x.decoded")
