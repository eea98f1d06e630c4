"""Near-duplicate documents: SimHash fingerprints, linked by multi-index hashing.

Two 64-bit fingerprints within ``radius`` bits of each other differ by at most
``radius // 2`` bits in one of their two 32-bit segments.  So each fingerprint is
stored in one table per segment, and looks up the Hamming ball of radius
``radius // 2`` around each of its own segments; what it meets there is verified
on the whole fingerprint.  Only distinct fingerprints are compared: copies share
one, and come back by a join at the end.

A segment value that very many distinct fingerprints share would make pairs with
the square of their number.  Buckets of more than ``hot`` fingerprints are
therefore left out of the pair search, and everything that could meet there is
linked another way, exactly and in linear size: over whole-fingerprint balls.
Each such fingerprint is put into the buckets of all 64-bit values within 1 bit
("inner") and 2 bits ("outer").  Any inner and any other member of one bucket are
within 3 bits, and any two fingerprints within 3 bits meet as inner and member of
some bucket, so linking every member of a bucket to its smallest inner member
gives the same components as all pairs.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, numbered, scratch, small_batches, written
from .components import connected_components
from .shingles import simhash
from .similar import similar_groups

#: Distinct fingerprints in one segment bucket beyond which pairs are not formed.
HOT = 512


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """``docs`` with a BIGINT column ``out``, the SimHash of ``text`` (null or empty: 0)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def f(t: pa.Array) -> pa.Array:
        fps = [simhash(x, width) for x in t.to_pylist()]
        return pa.array([x - (1 << 64) if x >> 63 else x for x in fps], pa.int64())

    return docs.withColumn(out, f(F.col(text)))


def _masks(bits: int, least: int, most: int) -> list[int]:
    """All ``bits``-bit words with ``least`` to ``most`` bits set, as signed longs."""
    words = [sum(1 << b for b in c) for k in range(least, most + 1) for c in combinations(range(bits), k)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def _spread(masks: list[int]):
    return F.explode(F.array(*[F.lit(m).cast("long") for m in masks])) if len(masks) < 100 else F.explode(F.from_json(F.lit(str(masks)), "array<bigint>"))


def fingerprint_links(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """``(a, b)``, ``a < b``: links whose components are those of all pairs within ``radius`` bits.

    ``fps``: distinct non-null fingerprints in a column ``fp``.  Outside hot
    buckets every pair is returned; within them a star per ball (see above).
    """
    if radius != 3:
        raise ValueError("the ball cover of hot buckets is made for 3 bits")
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("s"), upper.alias("half")), F.struct(F.lit(1).alias("s"), lower.alias("half")))).alias("k")).select("fp", "k.s", "k.half")
    probes = halves.select("fp", "s", "half", _spread(_masks(32, 0, radius // 2)).alias("m")).select(F.col("fp").alias("q"), "s", F.col("half").bitwiseXOR(F.col("m")).alias("half"))
    crowded = halves.groupBy("s", "half").count().where(F.col("count") > hot).select("s", "half", F.lit(True).alias("is_hot"))
    crowded, _ = written(crowded, "hot")
    if not crowded.head(1):
        return _verified(probes, halves, radius)
    tagged = probes.join(crowded, ["s", "half"], "left")
    rest = halves.join(crowded, ["s", "half"], "left_anti")
    members, _ = written(tagged.where("is_hot").select(F.col("q").alias("fp")).distinct(), "hot-members")
    return _verified(tagged.where("is_hot is null").drop("is_hot"), rest, radius).union(_ball_stars(members)).distinct()


def _verified(probes: DataFrame, halves: DataFrame, radius: int) -> DataFrame:
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("t.fp"))) <= radius
    on = (F.col("p.s") == F.col("t.s")) & (F.col("p.half") == F.col("t.half")) & (F.col("q") < F.col("t.fp")) & near
    # Sizes after an explode are underestimated: without the hints one side would be broadcast.
    return probes.hint("merge").alias("p").join(halves.hint("merge").alias("t"), on).select(F.col("q").alias("a"), F.col("t.fp").alias("b")).distinct()


def _ball_stars(members: DataFrame) -> DataFrame:
    def ball(least: int, most: int) -> DataFrame:
        return members.select("fp", _spread(_masks(64, least, most)).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("y"), "fp")

    inner = ball(0, 1)
    least = inner.groupBy("y").agg(F.min("fp").alias("m"))
    links = ball(0, 2).hint("merge").join(least.hint("merge"), "y").where("fp <> m")
    return links.select(F.least("fp", "m").alias("a"), F.greatest("fp", "m").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, radius: int = 3, hot: int = HOT) -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest key whose fingerprint is reachable by links
    of at most ``radius`` differing bits.  Null and word-less texts have
    fingerprint 0 and are linked like any other.  Rows that repeat a key come
    back as often as they went in.  A null key has a fingerprint too; it is never
    the smallest unless its component has no other key.  Empty table: empty.
    """
    spark = docs.sparkSession
    own = fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "t", "fp", width).select("id", "fp")
    own, _ = written(own, "fingerprints")
    reps, _ = written(own.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(reps.select("fp"), radius, hot), "a", "b")
    roots, _ = written(roots.join(reps, roots.node == reps.fp).select("fp", "root", "rep"), "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "component_id")
    whole = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return own.join(whole, "fp").select(F.col("id").alias(key), "fp", "component_id")


def keep_representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", repeats: bool = True, width: int = 5, similarity: float | None = 0.8, **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest key of their near-duplicate group.

    Texts are linked if their sets of ``width``-word shingles have a Jaccard similarity
    of ``similarity`` or more (see ``similar``); with ``similarity=None`` by the fingerprints
    of ``near_duplicates`` and its ``options``.  All columns stay.  Rows whose key is null
    stay only if no keyed row is in their group, and then one of them does.  Rows are
    told apart by number, not by key: a row that goes takes no other row of its key
    along.  Rows of a group that repeat its smallest key stay together, or with
    ``repeats=False`` one of them does, so that exactly one row of each group is left.
    Only numbers of rows that go are moved, no texts, as long as they are few.
    """
    rows, row = numbered(docs, "near-rows")
    rank = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col(row).alias(row))
    goes = F.col(f"rank.{row}") != F.col(f"first.{row}")
    if repeats:
        goes = goes & ~F.coalesce(F.col("rank.key") == F.col("first.key"), F.lit(False))
    with scratch(docs.sparkSession):
        if similarity is None:
            found = near_duplicates(rows.select(rank.alias("rank"), F.col(text).alias("t")), "t", "rank", width, **options).withColumnRenamed("component_id", "first")
        else:
            found = similar_groups(rows, row, text, rank, width, similarity)
        gone, _ = written(found.where(goes).select(F.col(f"rank.{row}").alias(row)), "near-gone", lasting=True)
    return rows.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
