"""Document quality: classifier evidence, shrunk site posteriors, one decision.

1. A logistic regression on the shape of the whole text and on words that labelled
   bad documents have gives each document its own evidence, a probability of being
   good: of good quality and not toxic.
2. Hosts and paths get Beta posteriors by hierarchical empirical Bayes.  How far
   hosts differ is estimated from the hosts themselves (method of moments), and
   gives the weight, in documents, of the global prior; how far paths differ within
   hosts gives the weight of the host's posterior for its paths.  A site with few
   documents stays near the level above, a site with many speaks for itself.
3. The log odds of document and path, less the global log odds, decide.  A document's
   own probability is taken out of the posteriors of its sites first, so that no
   evidence counts twice.

Sites are aggregated by plain sums (combined before the shuffle), so one host with
a third of all rows is no burden.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_batches, smallest_hashes, unused, written

#: Most labelled rows that the classifier is fitted on (the smallest hashes of their keys).
TRAIN_ROWS = 20_000
#: Paths up to which the site table is broadcast; a larger one is joined by salted keys.
BROADCAST_SITES = 50_000
SALTS = 64

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOLS = b"#$%&*+<=>@^_`{}~\\"
_LONG = re.compile(rb"\S{40,}")
#: Documents that a word of the lexicon is in, at least; words looked at, the most frequent; and how many standard
#: errors its log odds of being in good rather than bad documents lie below zero.
LEXICON_DOCS, LEXICON_WORDS, LEXICON_ERRORS = 5, 50_000, 4.0
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = ["caps", "symbols", "pipes", "exclamations", "digits", "repeats", "distinct", "same_lines", "word_length", "long_words", "log_words", "caps_lines", "symbol_lines", "pipe_lines", "repeat_lines"]
LEXICAL = ["worst_word", "second_word", "bad_words", "n_very_bad"]


def features(text: str | None) -> list[float]:
    """Shape of one whole text; every feature of a text without words is 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    drop = lambda b, cls: len(b) - len(b.translate(None, cls))
    upper, lower = drop(data, _UPPER), drop(data, _LOWER)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    bad = [0, 0, 0, 0]
    for x in lines:
        if len(x) >= 15:
            u, s, w = drop(x, _UPPER), drop(x, _SYMBOLS), x.split()
            bad[0] += len(x) * (2 * u > u + drop(x, _LOWER))
            bad[1] += len(x) * (2 * s > len(w))
            bad[2] += len(x) * (4 * x.count(b"|") > len(w))
            bad[3] += len(x) * (4 * sum(map(bytes.__eq__, w, w[1:])) > len(w))
    return [
        upper / max(1, upper + lower), drop(data, _SYMBOLS) / n, data.count(b"|") / n, data.count(b"!") / n, drop(data, _DIGIT) / chars, same / n,
        math.log(len(set(words))) / max(math.log(n), 0.7), 1 - len(set(lines)) / max(1, len(lines)), min(chars / n, 40) / 10, len(_LONG.findall(data)) / n, math.log(n) / 10,
        *(b / len(data) for b in bad),
    ]


def words_in(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters."""
    return set(_WORD.findall((text or "").lower()))


def lexical(words: set[str], lexicon: dict[str, float]) -> list[float]:
    """What the words of a text say that a lexicon has: the two worst, their sum, and the number of very bad ones."""
    found = sorted(map(lexicon.__getitem__, lexicon.keys() & words)) if lexicon else []
    return [found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, max(sum(found), -30.0) / 5, float(min(sum(x < -3 for x in found), 6))]


def lexicon_of(words: list[str], good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> dict[str, float]:
    """Log odds (-6 at least) of the words that bad documents surely have more often."""
    if not words:
        return {}
    odds = np.log((good + 0.5) / (n_good + 1)) - np.log((bad + 0.5) / (n_bad + 1))
    sure = (odds < -LEXICON_ERRORS * np.sqrt(1 / (good + 0.5) + 1 / (bad + 0.5))) & (good + bad >= LEXICON_DOCS)
    return {words[i]: max(float(odds[i]), -6.0) for i in np.flatnonzero(sure)}


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant
    lexicon: dict[str, float] = field(default_factory=dict)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t) + lexical(words_in(t), self.lexicon) for t in texts], np.float64)
        return self.log_odds(x.reshape(-1, len(FEATURES) + len(LEXICAL)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit_classifier(x: np.ndarray, y: np.ndarray, lexicon: dict[str, float] | None = None, ridge: float = 1.0, rounds: int = 25) -> Classifier:
    """Ridge logistic regression by Newton steps.  One class only, or no row: a constant."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        k = len(FEATURES) + len(LEXICAL)
        return Classifier(np.zeros(k), np.ones(k), np.append(np.zeros(k), math.log(rate / (1 - rate))))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w, lexicon or {})


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", reject: str | None = "toxic", rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents; only features and word counts come to the driver.

    A document is good if ``label`` is 1 and ``reject``, where ``labels`` has that
    column, is not 1; rows without ``label`` are not used.  Keys, ``rows`` at most, are
    broadcast, so no text is shuffled.  Lexical features of one half of the documents
    come from a lexicon of the other, so the regression learns what they are worth on
    unseen texts.
    """
    small_batches(docs.sparkSession)
    rejected = F.max(F.coalesce(F.col(reject), F.lit(0)) == 1) if reject in labels.columns else F.lit(False)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(((F.max(label) == 1) & ~rejected).cast("int").alias("y"))
    share = 2 * rows / max(1, labels.count())
    chosen = chosen.where(smallest_hashes(F.col("k"), F.lit(share))) if share < 1 else chosen
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(rows)
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    found, _ = written(found.select("y", "t", F.xxhash64("k").alias("h"), F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)).cast("int").alias("half")), "labelled")
    count = lambda y, half: F.count_if((F.col("y") == y) & (F.col("half") == half)).alias(f"n{y}{half}")
    four = [count(y, half) for y in (0, 1) for half in (0, 1)]
    own = found.select("y", "half", F.explode(_words(F.col("t"))).alias("w")).groupBy("w").agg(*four).withColumn("n", F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    seen = own.where(F.col("n") >= LEXICON_DOCS).orderBy(F.desc("n"), "w").limit(LEXICON_WORDS).toArrow().to_pydict()
    total = found.agg(*four).first()
    n = {c: np.array(seen[c], np.float64) for c in ("n00", "n01", "n10", "n11")}
    halves = [lexicon_of(seen["w"], n[f"n1{1 - half}"], n[f"n0{1 - half}"], total[f"n1{1 - half}"], total[f"n0{1 - half}"]) for half in (0, 1)]
    whole = lexicon_of(seen["w"], n["n10"] + n["n11"], n["n00"] + n["n01"], total["n10"] + total["n11"], total["n00"] + total["n01"])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(t: pa.Array, half: pa.Array) -> pa.Array:
        return pa.array([features(x) + lexical(words_in(x), halves[h]) for x, h in zip(t.to_pylist(), half.to_pylist(), strict=True)], pa.list_(pa.float64()))

    x = found.select("y", vectors("t", "half").alias("x"), "h").orderBy("h").limit(rows).toArrow()
    values = np.array(x["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES) + len(LEXICAL))
    return fit_classifier(values, np.array(x["y"].to_pylist(), np.float64), whole)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(t: pa.Array) -> pa.Array:
    return pa.array([[w for w in words_in(x) if len(w) <= 40] for x in t.to_pylist()], pa.list_(pa.string()))


def evidence(text: Column, model: Classifier) -> Column:
    """DOUBLE: the log odds that a text is good, by itself."""

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(model.of_texts(t.to_pylist()), pa.float64())

    # Never null: else planning would add a null test that runs the function once more.
    return F.coalesce(score(text), F.lit(0.0))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path", p: str = "p") -> DataFrame:
    """``(host, path, host_rate, path_rate, base)`` from documents' own probabilities ``p``, and what they are made of:

    ``n`` and ``s``, documents of the path and the sum of their probabilities; ``hn`` and
    ``hs``, those of the host; ``k1`` and ``k2``, the strengths of the priors of hosts and paths.
    Null hosts and paths are sites of their own.
    """
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("q"))
    paths, _ = written(paths, "paths")  # all that follows is on sites
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    top = _strength(hosts, "hn", "hs", "hq", None).select(F.col("mean").alias("base"), F.col("strength").alias("k1"))
    rated = hosts.crossJoin(F.broadcast(top)).withColumn("host_rate", (F.col("k1") * F.col("base") + F.col("hs")) / (F.col("k1") + F.col("hn")))
    same = paths.host.eqNullSafe(rated.host)
    joined = paths.join(rated, same).drop(rated.host).withColumn("host_mean", F.col("hs") / F.col("hn"))
    low = _strength(joined, "n", "s", "q", "host_mean").select(F.col("strength").alias("k2"))
    rate = (F.col("k2") * F.col("host_rate") + F.col("s")) / (F.col("k2") + F.col("n"))
    return joined.crossJoin(F.broadcast(low)).select("host", "path", "n", "s", "hn", "hs", "k1", "k2", "host_rate", rate.alias("path_rate"), "base")


def _strength(groups: DataFrame, n: str, s: str, q: str, centre: str | None) -> DataFrame:
    """One row: mean rate and prior strength in documents, by the method of moments.

    The spread of the groups' means beyond what their sizes explain is the variance
    of the prior; no spread means a prior that no site overrules.
    """
    rate = F.col(s) / F.col(n)
    total = groups.agg(F.sum(n).alias("N"), F.sum(s).alias("S"), F.sum(q).alias("Q"), F.count("*").alias("G"), F.sum(F.col(n) * F.col(n)).alias("N2"), F.sum(F.col(s) * rate).alias("B"),
                       F.sum(F.col(n) * F.pow(rate - (F.col(centre) if centre else rate), F.lit(2))).alias("D"))
    mean = F.coalesce(F.least(F.greatest(F.col("S") / F.col("N"), F.lit(1e-4)), F.lit(1 - 1e-4)), F.lit(0.5))
    between = F.col("D") if centre else F.col("B") - F.col("S") * F.col("S") / F.col("N")
    within = (F.col("Q") - F.col("B")) / F.greatest(F.col("N") - F.col("G"), F.lit(1))
    spread = (between - F.greatest(F.col("G") - 1, F.lit(0)) * within) / F.greatest(F.col("N") - F.col("N2") / F.col("N"), F.lit(1))
    strength = F.when(spread > mean * (1 - mean) * 1e-6, F.greatest(mean * (1 - mean) / spread - 1, F.lit(1e-2))).otherwise(F.lit(1e6))
    return total.select(mean.alias("mean"), F.coalesce(strength, F.lit(1e6)).alias("strength"))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", path: Column | None = None, label: str = "quality", reject: str | None = "toxic", rows: int = TRAIN_ROWS, prefix: str = "q_", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, less the columns in ``drop``, with ``q_evidence``, ``q_host_rate``, ``q_path_rate``, ``q_score`` and ``q_keep``.

    ``path`` is a column expression for the first path segment below the host
    (default: the column ``lang``, as in URLs of the form host/language/...).  Null
    hosts and paths are sites of their own, apart from empty ones.  The rates are those
    of the document's sites without the document itself.  Null and empty texts have no
    features, the same evidence for all.  Without labels of both kinds the evidence is
    constant and everything at or above even odds is kept.  ``prefix`` names the new
    columns; columns of those names are replaced.  Each text's evidence is computed
    once, and written with its row.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        model = train(docs, labels, text, key, label, reject, rows)
    stay = [c for c in docs.columns if c not in drop]
    site = F.struct(F.col(host).cast("string").alias("host"), (F.col("lang") if path is None else path).cast("string").alias("path"))
    held = F.struct(*[F.col(f"`{c}`") for c in stay]) if stay else F.struct(F.lit(0))
    own, _ = written(docs.select(held.alias("row"), site.alias("site"), evidence(F.col(text), model).alias("e")), "evidence")
    sites = site_posteriors(own.select("site.host", "site.path", (1 / (1 + F.exp(-F.col("e")))).alias("p")))
    out = _with_sites(own, sites.select(F.struct("host", "path").alias("at"), F.struct("n", "s", "hn", "hs", "k1", "k2", "base").alias("x")))
    p = 1 / (1 + F.exp(-F.col("e")))
    host_rate = (F.col("x.k1") * F.col("x.base") + F.col("x.hs") - p) / (F.col("x.k1") + F.col("x.hn") - 1)
    path_rate = (F.col("x.k2") * host_rate + F.col("x.s") - p) / (F.col("x.k2") + F.col("x.n") - 1)
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    score = 1 / (1 + F.exp(-(F.col("e") + _logit(clip(path_rate)) - _logit(clip(F.col("x.base"))))))
    new = {f"{prefix}evidence": F.col("e"), f"{prefix}host_rate": host_rate, f"{prefix}path_rate": path_rate, f"{prefix}score": score, f"{prefix}keep": score >= 0.5}
    replaced = {c.lower() for c in new}
    return out.select(*[F.col("row").getField(c).alias(c) for c in stay if c.lower() not in replaced], *[c.alias(name) for name, c in new.items()])


def _with_sites(own: DataFrame, sites: DataFrame) -> DataFrame:
    sites, _ = written(sites, "sites")
    if sites.count() <= BROADCAST_SITES:
        return own.join(F.broadcast(sites), own.site.eqNullSafe(sites["at"]))
    # Too many sites to broadcast: one host may hold a third of the rows, so keys are salted.
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("own_salt", F.pmod(F.xxhash64("e", "row"), F.lit(SALTS)).cast("int"))
    return own.join(salted, own.site.eqNullSafe(salted["at"]) & (own.own_salt == salted.salt))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    prefix = unused(docs, "__quality_")[0]
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return judged(docs, labels, prefix=prefix, **options).where(F.col(f"{prefix}keep")).select(*[F.col(f"`{c}`") for c in docs.columns])
