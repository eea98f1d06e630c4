"""Linear-chain conditional random field over words, for language labels (numpy, no Spark)."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
#: Most letters of a word; a longer run of letters is taken as several, each with the two letters before it.
PIECE, SEAM = 30, 2
#: Words of one training window, and of one block of the parallel forward-backward pass.
WINDOW, BLOCK = 32, 32
MEMO = 400_000
#: Words of the texts labelled together; one longer text is labelled by itself.
TOGETHER = 200_000


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; a run over ``PIECE`` letters in pieces of about one size.

    Pieces hold every letter and every three neighbours of a run; ``-`` marks an end that isn't one of the run.
    """
    out = []
    for run in WORD.findall(text.lower()):
        if (n := len(run)) <= PIECE:
            out.append(run)
            continue
        parts = -(-n // (PIECE - SEAM))
        cuts = [n * k // parts for k in range(parts + 1)]
        out += [("-" if a else "") + run[max(0, a - SEAM) : b] + ("-" if b < n else "") for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def own_letters(word: str) -> str:
    """What a piece adds to the pieces before it; a whole word as it is."""
    return word[1 + SEAM :].rstrip("-") if word[0] == "-" else word.rstrip("-")


def word_features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Buckets of a word of ``words_of``: itself, affixes at ends of the run, letter n-grams, lexicons that have it."""
    first, final = word[0] != "-", word[-1] != "-"
    w = "<" * first + word.strip("-") + ">" * final
    keys = [w, *(w[: k + 1] + "|" for k in (1, 2, 3) if first), *("|" + w[-k - 1 :] for k in (1, 2, 3) if final)]
    keys += [w[i : i + 3] for i in range(len(w) - 2)]
    keys += [w[i : i + 2] + "." for i in range(len(w) - 1)]
    keys += [f"lexicon {label}" for label in lexicon.get(word, (-1,))]
    return [crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys]


class Crf:
    """Emission weights by feature bucket, transition scores between labels."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((BUCKETS, max(1, len(labels))), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))
        self.lexicon: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.labels)), np.float32)

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "moves": self.moves, "lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    # -------------------------------------------------------------- training

    def fit(self, texts: list[str], truth: list[int], rounds: int = 4, rate: float = 0.25, ridge: float = 1e-6, seed: int = 7) -> None:
        """Maximum likelihood by AdaGrad over windows of words.

        A third of the windows are spliced from two documents, so that transitions
        between labels are learned as well as staying.
        """
        rng, size = np.random.default_rng(seed), len(self.labels)
        docs = [words_of(t) for t in texts]
        seen: dict[str, dict[int, int]] = {}
        for words, label in zip(docs, truth, strict=True):
            for w in set(words):
                by = seen.setdefault(w, {})
                by[label] = by.get(label, 0) + 1
        self.lexicon = {w: tuple(sorted(k for k, n in by.items() if n >= 3)) for w, by in seen.items() if any(n >= 3 for n in by.values())}
        vocabulary = {w: i for i, w in enumerate(sorted(seen))}
        feats = [word_features(w, self.lexicon) for w in sorted(seen)]
        width = max(map(len, feats), default=1)
        table = np.full((len(feats) + 1, width), BUCKETS, np.int32)
        for i, f in enumerate(feats):
            table[i, : len(f)] = f
        windows, labels = [], []
        for words, label in zip(docs, truth, strict=True):
            ids = [vocabulary[w] for w in words]
            for i in range(0, len(ids), WINDOW):
                part = ids[i : i + WINDOW]
                windows.append(part + [len(feats)] * (WINDOW - len(part)))
                labels.append(label)
        if not windows or size < 2:
            return
        x, y = np.array(windows, np.int32), np.array(labels)[:, None].repeat(WINDOW, 1)
        mixed = rng.permutation(len(x))[: len(x) // 3]
        other, cut = rng.permutation(len(x))[: len(mixed)], rng.integers(4, WINDOW - 4, len(mixed))
        late = np.arange(WINDOW)[None, :] >= cut[:, None]
        x, y = np.concatenate((x, np.where(late, x[other], x[mixed]))), np.concatenate((y, np.where(late, y[other], y[mixed])))
        weights, moves = np.zeros((BUCKETS + 1, size), np.float32), np.zeros((size, size))
        gw, gm = np.full((BUCKETS + 1, size), 1e-6, np.float32), np.full((size, size), 1e-6)
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                ids, labels = x[at], y[at]
                real = ids < len(feats)
                f = table[ids]
                e = weights[f].sum(2, dtype=np.float64)
                single, double = _marginals(e, moves, real)
                onehot = np.eye(size)[labels] * real[:, :, None]
                step = ((single * real[:, :, None]) - onehot)[:, :, None, :].repeat(width, 2).reshape(-1, size)
                grad = np.zeros_like(weights)
                np.add.at(grad, f.reshape(-1), step.astype(np.float32))
                grad = grad / len(at) + ridge * weights
                grad[BUCKETS] = 0
                both = real[:, 1:] & real[:, :-1]
                gold = np.zeros((size, size))
                np.add.at(gold, (labels[:, :-1][both], labels[:, 1:][both]), 1)
                move = (double - gold) / len(at)
                gw += grad * grad
                gm += move * move
                weights -= rate * grad / np.sqrt(gw)
                moves -= rate * move / np.sqrt(gm)
        self.weights, self.moves = weights[:BUCKETS], moves - moves.mean()
        self.reset()

    # -------------------------------------------------------------- labelling

    def _emissions(self, words: list[str]) -> np.ndarray:
        if new := set(words).difference(self.rows):
            if len(self.rows) + len(new) > MEMO:
                self.reset()
                new = set(words)
            feats = [word_features(w, self.lexicon) for w in new]
            sizes = np.fromiter(map(len, feats), np.int64, len(feats))
            flat = np.concatenate([np.array(f, np.int32) for f in feats])
            scores = np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, scores))
        return self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def posteriors(self, words: list[list[str]]) -> list[np.ndarray]:
        """Of each text: the probability of each label for each word, given the whole text."""
        counts = np.array([len(w) for w in words])
        flat = [w for ws in words for w in ws]
        if not flat:
            return [np.zeros((0, len(self.labels))) for _ in words]
        gamma = _forward_backward(self._emissions(flat).astype(np.float64), counts, self.moves)
        return np.split(gamma, np.cumsum(counts)[:-1])

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """``(word, label, probability)`` of each word, or piece of a long one, of a code-switched text."""
        words = words_of(text)
        g = self.posteriors([words])[0]
        return [(own_letters(w), self.labels[k], float(p[k])) for w, p, k in zip(words, g, g.argmax(1), strict=True)] if words else []

    def document_labels(self, texts: list[str | None], together: int = TOGETHER) -> list[tuple[str, float]]:
        """The label with the largest mean posterior over all words; ``und`` without letters.

        Memory is that of about ``together`` words, or of the longest text.
        """
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        size = 0
        for i, t in enumerate(texts):
            words = words_of(t or "")
            # The pattern also takes signs that count as numbers, such as a half or a raised two.
            held.append(words if any(c.isalpha() for w in words for c in w) else [])
            size += len(words)
            if size >= together or i == len(texts) - 1:
                out += self._labels_of(held)
                held, size = [], 0
        return out

    def _labels_of(self, words: list[list[str]]) -> list[tuple[str, float]]:
        out = []
        for g in self.posteriors(words) if self.labels else [np.zeros((0, 1))] * len(words):
            if len(g):
                mean = g.mean(0)
                k = int(mean.argmax())
                out.append((self.labels[k], float(min(1.0, max(0.0, mean[k])))))
            else:
                out.append(("und", 0.0))
        return out


def _marginals(e: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of windows, and expected transitions summed over all of them."""
    n, t, size = e.shape
    a = np.exp(moves)
    em = np.exp(e - e.max(2, keepdims=True))
    em[~real] = 1
    alpha, beta = np.empty((n, t, size)), np.ones((n, t, size))
    alpha[:, 0] = em[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ a) * em[:, i]
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        nxt = (beta[:, i + 1] * em[:, i + 1]) @ a.T
        beta[:, i] = np.where(real[:, i + 1, None], nxt / nxt.sum(1, keepdims=True), 1)
    single = alpha * beta
    single /= single.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a[None, None] * (em[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return single, (pair * (real[:, 1:] & real[:, :-1])[:, :, None, None]).sum((0, 1))


def _forward_backward(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posteriors of each word, texts of any lengths at once.

    Texts are cut into blocks.  The product of a block's step matrices carries
    messages across it, so only one small product per block is sequential; inside
    the blocks all of them advance together.  Exact, up to rounding.
    """
    size, a = scores.shape[1], np.exp(moves)
    em = np.exp(scores - scores.max(1, keepdims=True))
    per_text = -(-counts // BLOCK)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    em[first[counts > 0]] /= a.sum(0)  # every step below begins with a move; a text's first word has none
    text = np.repeat(np.arange(len(counts)), per_text)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = first[text] + rank * BLOCK
    length = np.minimum(BLOCK, first[text] + counts[text] - begin)
    n = len(text)
    at = np.minimum(begin[:, None] + np.arange(BLOCK)[None, :], len(scores) - 1)
    real = np.arange(BLOCK)[None, :] < length[:, None]
    step = np.where(real[:, :, None], em[at], 1.0)
    product = np.broadcast_to(np.eye(size), (n, size, size)).copy()
    for i in range(BLOCK):
        new = (product @ a) * step[:, i, None, :]
        new /= new.sum((1, 2), keepdims=True)
        product = np.where(real[:, i, None, None], new, product)
    before, after = np.ones((n, size)), np.ones((n, size))
    order = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[order], np.arange(1, int(rank.max()) + 1))
    levels = np.split(order, cuts)
    for level in levels[1:]:  # blocks of the same rank, one of each text
        v = np.einsum("ni,nij->nj", before[level - 1], product[level - 1])
        before[level] = v / v.sum(1, keepdims=True)
    for level in reversed(levels[1:]):
        v = np.einsum("nij,nj->ni", product[level], after[level])
        after[level - 1] = v / v.sum(1, keepdims=True)
    alpha, here = np.empty((n, BLOCK, size)), before
    for i in range(BLOCK):
        new = (here @ a) * step[:, i]
        new /= new.sum(1, keepdims=True)
        here = np.where(real[:, i, None], new, here)
        alpha[:, i] = here
    gamma, back = np.empty((n, BLOCK, size)), after
    for i in range(BLOCK - 1, -1, -1):
        gamma[:, i] = alpha[:, i] * back
        new = (back * step[:, i]) @ a.T
        new /= new.sum(1, keepdims=True)
        back = np.where(real[:, i, None], new, back)
    out = gamma[real]
    return out / out.sum(1, keepdims=True)
