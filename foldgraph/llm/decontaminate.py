"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused
from .winnow import K, SPAN, ItemIndex, united

#: Bytes of item texts in one block.  A block is the only thing broadcast; a
#: larger benchmark is searched for block by block.
BLOCK_BYTES = 8 << 20

_HITS = "struct<n_words:bigint,hits:array<struct<first:bigint,end:bigint>>,items:array<string>>"
_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_built: dict[str, ItemIndex] = {}


def _item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The items in blocks of about ``block_bytes``, each collected by itself."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [[(r.i, r.t) for r in rows.where(block == b).collect()] for b in range(n)]


def _search(spark, items: list[tuple[str, str]], span: int, k: int) -> Callable[[Column], Column]:
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.arrow_udf(_HITS)
    def search(t: pa.Array) -> pa.Array:
        if name not in _built:
            if len(_built) >= 8:  # indexes that a worker keeps
                _built.clear()
            _built[name] = ItemIndex(shared.value, span, k)
        found = _built[name].hits(t.to_pylist())
        return pa.array([{"n_words": n, "hits": [{"first": a, "end": b} for a, b in runs], "items": names} for n, runs, names in found], _TYPE)

    return search


def _merged(blocks: list[Column]) -> Column:
    @F.arrow_udf(_HITS)
    def merge(parts: pa.Array) -> pa.Array:
        out = []
        for x in parts.to_pylist():
            runs = united([(r["first"], r["end"]) for p in x for r in p["hits"]])
            out.append({"n_words": x[0]["n_words"], "hits": [{"first": a, "end": b} for a, b in runs], "items": sorted({i for p in x for i in p["items"]})})
        return pa.array(out, _TYPE)

    return merge(F.array(*blocks))


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str = "contamination", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``out``: words, hit runs and items found of each row.

    A window is ``span`` consecutive words of an item, or all of a shorter item;
    every word inside an occurrence of a window is hit.  Fingerprints of windows
    are winnowed on both sides, met by hash, and every meeting is extended word by
    word along its diagonal, so the result is exact.  Documents are not moved:
    each block of the benchmark goes to the documents.  Null and word-less texts
    have no words and no hits; items without words are never found.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = _item_blocks(benchmark, item, item_text, block_bytes)
    if len(blocks) == 1:
        return docs.withColumn(out, _search(spark, blocks[0], span, k)(F.col(text)))
    return docs.withColumn(out, _merged([_search(spark, b, span, k)(F.col(text)) for b in blocks]))


def n_hit(column: str) -> Column:
    return F.aggregate(F.col(f"{column}.hits"), F.lit(0).cast("bigint"), lambda total, r: total + r["end"] - r["first"])


def is_contaminated(column: str) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit(column) > 0) & (20 * n_hit(column) >= F.col(f"{column}.n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    out = unused(docs, "__contamination")[0]
    return with_hits(docs, benchmark, out, **options).where(~is_contaminated(out)).select(*[F.col(f"`{c}`") for c in docs.columns])
