"""Texts with similar sets of word shingles, by multi-index hashing of wide SimHash fingerprints.

Two texts whose shingle sets have Jaccard similarity ``s`` share a cosine of
``2 s / (1 + s)``, so each bit of their SimHash differs with the probability ``p`` =
arc cosine / pi (0.15 at 0.8).  64 bits with a small radius would miss nearly all
such pairs.  So the fingerprint is wide: ``tables`` segments of ``bits`` bits and 128
bits more.  Each segment is a table of its own: a fingerprint is entered under its
segment and under the Hamming ball of radius 1 below it (one set bit cleared).  Two
segments that differ in one bit, or in two bits of opposite sense, meet; the number
of tables is such that a pair at exactly the least similarity is missed in all of
them with a chance of ``MISS``, and closer pairs far more rarely.  What meets is
verified on 128 bits in the join, then on the whole fingerprint and on parities, and
at last on the shingle sets themselves.

Parities: shingle hashes are dealt to ``64 * PARITIES`` places, and a bit tells if a
place got an odd number.  Each place in
which two texts differ holds a shingle of only one of them, so the differing bits are
never more than the shingles that are not common.  This bound loses no link, and as
common shingles cancel out it is close unless very many differ.

The width of a segment grows with the number of texts, so that a bucket holds about
as many at every size; rows per text grow with it, as the 0.24th power of their number.

Groups are the components of the verified links.  Nothing makes all pairs of a large
group: buckets with very many texts give stars around a few of them, and of the
candidates only as many are verified as are needed to join components; what crosses
components at the end is verified in full, so no link between groups is lost.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, small_batches, written
from .components import connected_components
from .shingles import bit_counts, shingle_hashes

#: Chance that a pair at exactly the least similarity meets in no table.
MISS = 0.01
#: Bits verified in the join; standard deviations that a true pair's distance may lie above its mean.
SKETCH, DEVIATIONS = 128, 3.5
#: 64-bit words of the fingerprint that the entries of crowded buckets carry for verification.
LONGS = 16
_W = [f"w{i}" for i in range(LONGS)]
#: 64-bit words of parities.
PARITIES = 16
_P = [f"p{i}" for i in range(PARITIES)]
#: Members of a bucket (about) beyond which it gives stars, or as many times the mean as ``ABOVE`` says, as buckets
#: fill up until their width grows; one text in ``SAMPLE`` is counted to tell.
CROWD, ABOVE, SAMPLE = 24, 8, 4
#: Stars of each crowded bucket.
STARS = 3
#: Shingle hashes of all texts that a round verifies up to which their sets are broadcast; share of all
#: texts' shingles that one round may move if those of all candidates are more.
BROADCAST_HASHES, MOVED = 2_000_000, 0.15
_BLOCK = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def flip(similarity: float) -> float:
    """Probability that a bit differs between texts of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segment_bits(n_texts: int) -> int:
    """18 bits up to 2**20 texts, 6 more for each further factor of 64."""
    return 18 + 6 * max(0, -(-(max(1, n_texts).bit_length() - 21) // 6))


def n_tables(bits: int, p: float, miss: float = MISS) -> int:
    q = 1 - p
    meet = q**bits + bits * p * q ** (bits - 1) + math.comb(bits, 2) * p * p * q ** (bits - 2) / 2
    return max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def limit(bits: int, p: float) -> int:
    return math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_simhash(h: np.ndarray, n_bits: int) -> np.ndarray:
    """``n_bits`` booleans: is a bit set in over half of the distinct shingle hashes?"""
    steps = _STEP * np.arange(1, -(-n_bits // 64) + 1, dtype=np.uint64)
    ones = np.zeros(64 * len(steps), np.int64)
    for i in range(0, h.size, _BLOCK):  # bounded memory for very long texts
        ones += bit_counts(_mixed(h[i : i + _BLOCK, None] + steps))
    return (2 * ones > h.size)[:n_bits]


def parities(h: np.ndarray) -> np.ndarray:
    """``64 * PARITIES`` bits: does an odd number of the distinct hashes fall to a place?"""
    n = 64 * PARITIES
    return np.bincount((_mixed(h) % np.uint64(n)).astype(np.int64), minlength=n) & 1


def _longs(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


_WIDE = "struct<d0:bigint,d1:bigint,n:int,sketch:array<bigint>,segments:array<bigint>,p:array<bigint>>"


def wide_fingerprints(text: Column, width: int, tables: int, bits: int) -> Column:
    """Digest and size of the shingle set, 128 bits to verify, the segments, and the parities."""

    @F.arrow_udf(_WIDE)
    def f(t: pa.Array) -> pa.Array:
        d, n, sketch, segments, odd = [], [], [], [], []
        place = 1 << np.arange(bits, dtype=np.int64)
        for x in t.to_pylist():
            h = np.unique(shingle_hashes(x, width))
            own = wide_simhash(h, SKETCH + tables * bits)
            n.append(h.size)
            d.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8"))
            sketch.append(_longs(own[:SKETCH]))
            odd.append(_longs(parities(h)))
            segments.append((own[SKETCH:].reshape(tables, bits) @ place).tolist())
        d = np.array(d, np.int64).reshape(-1, 2)
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(n, pa.int32()), pa.array(sketch, longs), pa.array(segments, longs), pa.array(odd, longs)], ["d0", "d1", "n", "sketch", "segments", "p"])

    return f(text)


def shingle_sets(text: Column, width: int) -> Column:
    """The sorted hashes ``h`` of a text's shingles, and ``w``, the fingerprint's next ``64 * LONGS`` bits."""

    @F.arrow_udf("struct<h:array<bigint>,w:array<bigint>>")
    def f(t: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(x, width)) for x in t.to_pylist()]
        wide = [_longs(wide_simhash(h, SKETCH + 64 * LONGS)[SKETCH:]) for h in sets]
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([h.view(np.int64) for h in sets], longs), pa.array(wide, longs)], ["h", "w"])

    return f(text)


def _entries(reps: DataFrame, bits: int) -> DataFrame:
    """``(bucket, id, s0, s1)``: each segment and the ball below it."""
    own = reps.select("id", "s0", "s1", F.posexplode("segments").alias("t", "v")).select("id", "s0", "s1", F.shiftleft(F.col("t").cast("bigint"), bits).bitwiseOR(F.col("v")).alias("k"))
    below = [F.when(F.col("k").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.col("k") - F.lit(1 << i)) for i in range(bits)]
    return own.select(F.explode(F.array("k", *below)).alias("bucket"), "id", "s0", "s1").where("bucket is not null")


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) <= most


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Can ``n`` shingles with ``q`` of their own, on both sides, be similar enough?"""
    one = lambda x, y: F.col(f"{x}.n") - F.col(f"{x}.q") >= F.lit(similarity) * (F.col(f"{x}.n") + F.col(f"{y}.q")) - 1e-9
    return one(a, b) & one(b, a)


def _apart(a: str, b: str, words: list[str]) -> Column:
    return reduce(add, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words])


def _not_common(a: str, b: str, similarity: float) -> Column:
    """Most shingles that only one of two similar texts may have, by the sizes of their sets."""
    return F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-6


def _near_in_all(a: str, b: str, similarity: float) -> Column:
    """Are all bits that crowded entries carry those of a pair that may be similar enough?"""
    return _may_be_similar(a, b, similarity) & (_apart(a, b, _P) <= _not_common(a, b, similarity)) & (_apart(a, b, _W) <= limit(64 * LONGS, flip(similarity)))


def _with_own_shingles(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Entries with more of the fingerprint, the parities, the size ``n`` of each set and the number ``q`` of its shingles that no other text of the entries has."""
    alone = sets.select("id", F.explode("h").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("q"))
    words = [F.col(c)[i].alias(name) for c, names in (("w", _W), ("p", _P)) for i, name in enumerate(names)]
    own = sets.select("id", F.size("h").alias("n"), *words).join(alone, "id", "left").fillna(0, ["q"])
    return crowded.join(own, "id")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _stars(crowded: DataFrame, most: int, similarity: float) -> DataFrame:
    """Each entry of a crowded bucket with the bucket's first text, in several orders of all texts."""
    out, own = None, [c for c in crowded.columns if c != "bucket"]
    for k in range(STARS):
        first = crowded.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("order"), *own)).alias("f")).select("bucket", *[f"f.{c}" for c in own])
        met = crowded.alias("x").join(first.hint("merge").alias("y"), "bucket").where((F.col("x.id") != F.col("y.id")) & _near("x", "y", most) & _near_in_all("x", "y", similarity))
        met = met.select(*_pair(F.col("x.id"), F.col("y.id")))
        out = met if out is None else out.union(met)
    return out.distinct()


def _odd_ones(crowded: DataFrame, comp: DataFrame, most: int, similarity: float) -> DataFrame:
    """Pairs of a crowded bucket in different components: the entries outside a bucket's largest component with all others."""
    own = _labelled(crowded, comp, "id", "c")
    own, _ = written(own, "crowded-components")
    sizes = own.groupBy("bucket", "c").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct("count", "c")).alias("m")).select("bucket", F.col("m.c").alias("main"))
    odd = own.join(main, "bucket").where("c <> main").drop("main")
    met = own.hint("merge").alias("x").join(odd.hint("merge").alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c")) & _near("x", "y", most) & _near_in_all("x", "y", similarity))
    return met.select(*_pair(F.col("x.id"), F.col("y.id"))).distinct()


def _labelled(df: DataFrame, comp: DataFrame, on: str, out: str) -> DataFrame:
    """``df`` with the component of the text in column ``on``; a text of no link is its own."""
    x = comp.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return df.join(x, df[on] == x["__n"], "left").withColumn(out, F.coalesce("__r", on)).drop("__n", "__r")


def _close(pairs: DataFrame, reps: DataFrame, bits: int, tables: int, similarity: float) -> DataFrame:
    """The pairs whose whole fingerprints and parities are close enough, and whose sets are not too different in size to be similar."""
    fp = reps.select("id", "n", "s0", "s1", "segments", "p")
    both = pairs.join(fp.alias("x"), F.col("a") == F.col("x.id")).join(fp.alias("y"), F.col("b") == F.col("y.id"))
    apart = lambda c: F.aggregate(F.zip_with(f"x.{c}", f"y.{c}", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, d: n + d)
    whole = apart("segments") + F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    alike = F.least("x.n", "y.n") >= F.lit(similarity) * F.greatest("x.n", "y.n") - 1e-9
    return both.where(alike & (apart("p") <= _not_common("x", "y", similarity)) & (whole <= limit(SKETCH + tables * bits, flip(similarity)))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), F.col("b") == F.col("y.id"))
    common = F.size(F.array_intersect("x.h", "y.h"))
    union = F.size("x.h") + F.size("y.h") - common
    return both.where(common >= F.lit(similarity) * union - 1e-9).select("a", "b", "ca", "cb")


def _sets_of(tried: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the texts of these pairs, marked for broadcast if they are small."""
    ids, _ = written(tried.select(F.col("a").alias("id")).union(tried.select("b")).distinct(), "tried")
    own = sets.join(few(ids), "id", "left_semi")
    hashes = own.agg(F.sum(F.size("h"))).first()[0] or 0
    return F.broadcast(own) if hashes <= BROADCAST_HASHES else own


def _joined(pairs: DataFrame, comp: DataFrame | None, sets: DataFrame, similarity: float, at_once: float) -> DataFrame | None:
    """Components ``(node, root)`` of those in ``comp`` and the links among ``pairs`` (written).

    Up to ``at_once`` candidates are verified together.  Of more, a round verifies, for each component, some of the candidates that leave it, four
    times as many each round; candidates within a component need no verification.
    """
    share = 1
    while True:
        if comp is None:
            left = pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
        else:
            left = _labelled(_labelled(pairs, comp, "a", "ca"), comp, "b", "cb").where("ca <> cb")
        left, _ = written(left, "candidates")
        n = left.count()
        if not n:
            return comp
        ends = left.select(F.col("ca").alias("c"), "a", "b").union(left.select(F.col("cb"), "a", "b"))
        if n > at_once:
            rank = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("a", "b"), "a", "b"))
            chosen, _ = written(ends.withColumn("rank", rank).where(F.col("rank") <= share).select("a", "b").distinct(), "chosen")
            tried = left.join(chosen, ["a", "b"], "left_semi")
            pairs = left.join(chosen, ["a", "b"], "left_anti").select("a", "b")
        else:
            tried, pairs = left, None
        links, _ = written(_verified(tried, _sets_of(tried, sets), similarity), "links")
        if links.head(1):
            moved = connected_components(links, "ca", "cb")
            if comp is None:
                comp = moved
            else:
                old = comp.select("node", F.col("root").alias("was"))
                now = moved.select(F.col("node").alias("was"), "root")
                kept = old.join(now, "was", "left").select("node", F.coalesce("root", "was").alias("root"))
                comp = kept.union(moved.join(old.select("node"), "node", "left_anti").select("node", "root"))
            comp, _ = written(comp, "components")
        if pairs is None:
            return comp
        pairs, share = written(pairs, "candidates-left")[0], 4 * share


def _sets(rows: DataFrame, row: str, text: str, width: int, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """``(id, h, w)``: the shingle sets of the texts ``ids``."""
    members, _ = written(ids.join(reps, "id").select("id", F.col(f"rep.{row}").alias("row")), "members")
    found = rows.select(F.col(row).alias("row"), F.col(text).alias("text")).join(few(members), "row")
    return written(found.select("id", shingle_sets(F.col("text"), width).alias("x")).select("id", "x.h", "x.w"), "shingle-sets")[0]


def similar_groups(rows: DataFrame, row: str, text: str, rank: Column, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(rank, first)`` for each row: its rank and the smallest rank of its group.

    ``rows`` has a distinct number for each row in the column ``row`` and is reread at
    will; ``rank`` is a struct that orders rows and ends with that number.  Texts
    without words are one group; a text of fewer words than ``width`` has one shingle.
    """
    spark = rows.sparkSession
    small_batches(spark)
    p = flip(similarity)
    bits = segment_bits(rows.count())
    tables = n_tables(bits, p)
    own, _ = written(rows.select(rank.alias("rank"), wide_fingerprints(F.col(text), width, tables, bits).alias("f")).select("rank", "f.*"), "wide-fingerprints")
    any_of = lambda c: F.any_value(c)
    reps = own.groupBy("d0", "d1").agg(F.min("rank").alias("rep"), any_of(F.col("sketch")[0]).alias("s0"), any_of(F.col("sketch")[1]).alias("s1"), any_of(F.col("segments")).alias("segments"), any_of(F.col("p")).alias("p"), any_of(F.col("n")).alias("n"))
    reps, _ = written(reps.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    entries, most = _entries(reps, bits), limit(SKETCH, p)
    counted = _entries(reps.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), bits).groupBy("bucket").count()
    mean = reps.count() * (bits / 2 + 1) / 2**bits
    busy, _ = written(counted.where(F.col("count") * SAMPLE >= max(CROWD, ABOVE * mean)).select("bucket"), "crowded")
    any_busy = bool(busy.head(1))
    plain = entries.join(busy, "bucket", "left_anti") if any_busy else entries
    met = plain.hint("merge").alias("x").join(plain.hint("merge").alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & _near("x", "y", most))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    if any_busy:
        crowded, _ = written(entries.join(busy, "bucket", "left_semi"), "crowded-entries")
        their_sets = _sets(rows, row, text, width, crowded.select("id").distinct(), reps)
        crowded, _ = written(_with_own_shingles(crowded, their_sets.join(reps.select("id", "p"), "id")).where(F.col("n") - F.col("q") >= F.lit(similarity) * F.col("n") - 1e-9), "crowded-sizes")
        stars, _ = written(_stars(crowded, most, similarity), "stars")
    pairs, _ = written(pairs, "met")
    pairs, _ = written(_close(pairs, reps, bits, tables, similarity), "close")
    if any_busy:  # their distances are complete already
        pairs = pairs.union(stars).distinct()
    members = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    if any_busy:
        members = members.union(crowded.select("id"))
    sets = _sets(rows, row, text, width, members.distinct(), reps)
    size = sets.agg(F.count("*").alias("n"), F.sum(F.size("h")).alias("hashes")).first()
    at_once = math.inf
    if (size.hashes or 0) > BROADCAST_HASHES:  # so many that the sets that move are no more than MOVED of all texts
        at_once = MOVED * reps.agg(F.sum("n")).first()[0] * size.n / (2 * size.hashes)
    comp = _joined(pairs, None, sets, similarity, at_once)
    if any_busy:
        nothing = spark.createDataFrame([], "node bigint, root bigint")
        odd, _ = written(_odd_ones(crowded, nothing if comp is None else comp, most, similarity), "odd-pairs")
        comp = _joined(odd, comp, sets, similarity, at_once)
    if comp is None:
        return own.join(reps.select("d0", "d1", "rep"), ["d0", "d1"]).select("rank", F.col("rep").alias("first"))
    linked = comp.join(reps.select("id", "rep"), comp.node == reps.id).select("id", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("first"))
    least, _ = written(linked.join(least, "root").select("id", "first"), "group-firsts")
    whole = reps.select("d0", "d1", "id", "rep").join(least, "id", "left").select("d0", "d1", F.coalesce("first", "rep").alias("first"))
    return own.join(whole, ["d0", "d1"]).select("rank", "first")
