"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest.  A batch is first reduced to
one row per digest (partial aggregation, so a digest that a third of the rows
share is combined before the shuffle), then anti-joined with the index by a
sort-merge join that reads the index bucket by bucket without moving it, and what
is new is appended to the same buckets.  A table is taken in by batches of
ascending keys, so the first batch that has a text also has its smallest key.

An append that is run again, or a second writer, may store a digest twice; rows
carry the number of their batch, and the row of the earliest one counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, numbered, scratch, written

#: Batches that a table is taken in by; batches after which an index is rewritten with one file a bucket.
BATCHES, COMPACT_AFTER = 2, 16
#: Least and most buckets of a new index, and rows of its first batch to a bucket.  Fixed when the index is made.
BUCKETS, MOST_BUCKETS, BUCKET_rowS = 16, 1 << 16, 4_000_000

_WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket of an index made for ``rows`` is sorted by one task."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (max(1, -(-rows // BUCKET_rowS)) - 1).bit_length()))


class DigestIndex:
    """A catalog table ``(digest, keep_id, batch)``, bucketed and sorted by digest.

    A table that is there already is opened with the buckets that it has.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS, id_type: str = "bigint"):
        self.spark, self.buckets, self.id_type = spark, buckets, id_type
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.name):
            about = {r.col_name: r.data_type for r in spark.sql(f"describe extended {self.name}").collect()}
            self.buckets, self.id_type = int(about["Num Buckets"]), about["keep_id"]
        else:
            self._write(spark.createDataFrame([], f"digest string, keep_id {id_type}, batch bigint"), self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def table(self) -> DataFrame:
        """``(digest, keep_id)``, each digest once; grouped within its bucket, without a shuffle."""
        return self.spark.table(self.name).groupBy("digest").agg(F.min_by("keep_id", "batch").alias("keep_id"))

    def ingest(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` ``(id, digest)`` that the index lacks.

        A digest that the index has keeps its row, whatever ids the batch brings.
        """
        number = (self.spark.table(self.name).agg(F.max("batch")).first()[0] or 0) + 1
        least = batch.groupBy("digest").agg(F.min("id").cast(self.id_type).alias("keep_id"))
        new = least.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")
        new, _ = written(new.withColumn("batch", F.lit(number).cast("bigint")), "new-digests")  # the table read above is the one appended to
        self._write(new.repartition(self.buckets, "digest"), self.name)
        if number % COMPACT_AFTER == 0:
            self.compact()

    def compact(self) -> None:
        """Rewrite the table with one sorted file a bucket, each digest once, and put it in the old one's place."""
        once = self.spark.table(self.name).groupBy("digest").agg(F.min_by("keep_id", "batch").alias("keep_id"), F.min("batch").alias("batch"))
        new, old = (f"{self.name}_{x}_{uuid.uuid4().hex}" for x in ("new", "old"))
        self._write(once.repartition(self.buckets, "digest"), new)
        self.spark.sql(f"alter table {self.name} rename to {old}")
        self.spark.sql(f"alter table {new} rename to {self.name}")
        self.spark.sql(f"drop table {old}")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def ascending(own: DataFrame, batches: int) -> list[DataFrame]:
    """``own`` cut by ``id`` into about equal batches, the smallest ids first and null ones last; not cut if ids are no numbers."""
    if batches < 2 or not isinstance(own.schema["id"].dataType, T.NumericType):
        return [own]
    cuts = own.select(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0]
    bounds = sorted(set(cuts or []))
    parts = [own.where((F.col("id") > a if a is not None else F.lit(True)) & (F.col("id") <= z)) for a, z in zip([None, *bounds], bounds, strict=False)]
    return [*parts, own.where(F.col("id").isNull() | (F.col("id") > bounds[-1]))] if bounds else [own]


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when they are identical after each run of ASCII white space
    became one space.  Of equal texts the row with the smallest key stays, unless
    an earlier batch of ``index`` has the text: then none of this batch does, and
    ``keep_id`` names the earlier row.  ``group_size`` counts this batch's rows.
    Null texts count as empty.  Rows that repeat a key stay or go together; rows
    of null key stay only if no row with a key has their text.  Empty: empty.
    Columns named in ``carry`` come back too.  Without ``index`` one is made for this
    call and dropped when the groups are written.
    """
    spark = docs.sparkSession
    own, _ = written(docs.select(F.col(key).alias("id"), digest(F.col(text)).alias("digest"), *carry), "digests")
    lasting, index = index, index or DigestIndex(spark, buckets=buckets_for(own.count()), id_type=docs.schema[key].dataType.simpleString())
    for batch in ascending(own, batches):
        index.ingest(batch)
    sizes = own.groupBy("digest").agg(F.count("*").alias("group_size"))
    # Written, so that the last join has plain shuffles on both sides and a digest that very many rows share is split.
    groups, _ = written(sizes.join(index.table().hint("merge"), "digest"), "groups")
    if lasting is None:
        index.drop()
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return own.join(groups, "digest").select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), *carry)


def keep_first(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", key: str = "doc_id", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns.

    Rows are told apart by number, not by key: a row that goes takes no other row of
    its key along.  Of rows of null key with one text, one stays.  Rows that repeat
    both key and text stay together, or with ``repeats=False`` one of them does, so
    that exactly one row of each text is left.
    """
    rows, row = numbered(docs, "exact-rows")
    stays = (F.col(row) == F.col("first")) | ((F.col(key).isNotNull() & F.col("kept")) if repeats else F.lit(False))
    with scratch(docs.sparkSession):
        found, _ = written(deduplicate(rows, index, text, key, (row,)), "exact")
        one = found.where("kept").groupBy("text_sha256").agg(F.min(row).alias("first"))
        gone, _ = written(found.join(one, "text_sha256", "left").where(~F.coalesce(stays, F.lit(False))).select(row), "exact-gone", lasting=True)
    return rows.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
