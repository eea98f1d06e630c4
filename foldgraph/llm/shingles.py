"""SimHash of word shingles (pure functions, no Spark)."""

from __future__ import annotations

import numpy as np
import xxhash

_SEED = 42
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, repeats included.

    A-Z are lower-cased, words are maximal runs without ASCII white space.  A
    text of fewer words has one shingle, its whole sequence; no word, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, _SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], _SEED) for a, b in pairs), np.uint64, n - width + 1)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many rows of a matrix of 64-bit words have each bit set: a vector of 64 counts for each column."""
    rows, columns = h.shape
    total = np.zeros(64 * columns, np.int64)
    step = 255 * max(1, _BLOCK // 255 // columns)  # bounded memory for very long texts
    for i in range(0, rows, step):
        bits = np.unpackbits(np.ascontiguousarray(h[i : i + step], dtype="<u8").view(np.uint8).reshape(-1, 8 * columns), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        # sums of 255 bits fit a byte, and bytes are added many at once
        total += bits[:whole].reshape(-1, 255, 64 * columns).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return total


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint: a bit is set if over half of the shingle hashes have it."""
    h = shingle_hashes(text, width)
    if not h.size:
        return 0
    return int(np.packbits(2 * bit_counts(h[:, None]) > h.size, bitorder="little").view("<u8")[0])
