"""Winnowed word fingerprints over byte buffers (numpy, no Spark).

A k-gram is ``k`` consecutive words.  Of every ``w`` consecutive k-grams the ones
with the smallest hash are kept, so two texts that share ``k + w - 1`` words in a
row keep a common k-gram at the same place of the shared run: whatever window of
``w`` k-grams lies in it has the same minimum on both sides.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of an evaluation window; words of a k-gram; k-grams of a winnowing window.
SPAN, K = 13, 5
_BLOCK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def as_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, _BLOCK)
        grow = np.full(size, _BASE)
        grow[0] = 1
        _powers = np.multiply.accumulate(grow)
        grow[1:] = _INVERSE
        _inverses = np.multiply.accumulate(grow)
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one block."""
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([False], _IS_WORD[raw], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(raw.size + 1)
    total = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: raw.size], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and the number of words of each text.

    Works on blocks of about 2 MB, whether they hold many short texts or a part of
    a long one (cut where no word is), so memory is bounded by the words' hashes.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            starts, h = _block_words(b" ".join(held))
            begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])))
            np.add.at(counts, np.array(owner), np.diff(np.searchsorted(starts, begin)))
            hashes.append(h)
            held.clear()
            owner.clear()

    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or at == 0:
            end = min(len(t), at + _BLOCK)
            while end < len(t) and _IS_WORD[t[end]]:
                end += 1
            if size + end - at > _BLOCK:
                flush()
                size = 0
            held.append(t[at:end])
            owner.append(i)
            size += end - at
            at = end if end else 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (not cut at the ends of texts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _GRAM + words[j : j + n]
    return mixed(h)


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over each run of ``w`` values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def kept(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the minimum of some window of ``w`` (fewer than ``w``: of all)."""
    w = min(w, len(h))
    if w <= 1:
        return np.arange(len(h))
    least = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), w, np.maximum) == h)


class ItemIndex:
    """Fingerprints of evaluation items and the exact extension of hits."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, k: int = K):
        self.span, self.names = span, [name for name, _ in items]
        self.words = [WORD.findall(as_bytes(text)) for _, text in items]
        found: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for i, words in enumerate(self.words):
            if words:
                # a shorter item must occur whole: its one gram, in every place
                size, w = (k, span - k + 1) if len(words) >= span else (len(words), 1)
                h = grams(word_hashes([b" ".join(words)])[0], size)
                for q in kept(h, w).tolist():
                    found.setdefault((size, w), {}).setdefault(int(h[q]), []).append((i, q))
        self.tables = [(size, w, np.array(sorted(by), np.uint64), by) for (size, w), by in sorted(found.items())]

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: words, hit runs ``[first, end)`` of words, names of the items found."""
        data = [as_bytes(t) for t in texts]
        words, counts = word_hashes(data)
        begin = np.concatenate(([0], np.cumsum(counts)))
        places: dict[int, list[tuple[int, int, list[tuple[int, int]]]]] = {}
        for size, w, table, by in self.tables:
            h = grams(words, size)
            at = kept(h, w)
            slot = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
            at = at[table[slot] == h[at]]
            doc = np.searchsorted(begin, at, "right") - 1
            inside = at + size <= begin[doc + 1]
            for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                places.setdefault(d, []).append((p - int(begin[d]), size, by[int(h[p])]))
        out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(int(n), [], []) for n in counts]
        for d, found in places.items():
            runs, names = self._extended(WORD.findall(data[d]), found)
            out[d] = (out[d][0], runs, names)
        return out

    def _extended(self, doc: list[bytes], found: list) -> tuple[list[tuple[int, int]], list[str]]:
        runs, names, reached = [], set(), {}
        for p, size, owners in sorted(found, key=lambda x: x[0]):
            for i, q in owners:
                item, line = self.words[i], (i, p - q)
                if reached.get(line, 0) >= p + size or doc[p : p + size] != item[q : q + size]:
                    continue
                a, b = p, p + size
                while a > 0 and a + q - p > 0 and doc[a - 1] == item[a - 1 + q - p]:
                    a -= 1
                while b < len(doc) and b + q - p < len(item) and doc[b] == item[b + q - p]:
                    b += 1
                reached[line] = b
                if b - a >= min(self.span, len(item)):
                    runs.append((a, b))
                    names.add(self.names[i])
        return united(runs), sorted(names)


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs, in order, that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
