"""Personal data in documents, by a semi-Markov CRF on top of exact patterns."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, smallest_hashes
from .pii_spans import SemiCrf, all_spans, base_spans, may_hold_secret, practice_lines, regions

#: Most documents that training lines are taken from (the smallest hashes of their keys), and lines of them.
TRAIN_DOCS, TRAIN_LINES = 300, 1200
_SPANS = "struct<base:array<struct<first:bigint,end:bigint,kind:string>>,spans:array<struct<first:bigint,end:bigint,kind:string>>>"
_LIST = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_models: dict[str, SemiCrf] = {}


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_DOCS) -> SemiCrf:
    """Learn from made-up lines and from at most ``rows`` documents, labelled by the patterns.

    Lines of documents that may hold a secret are left out, as no pattern tells it.
    """
    has = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    lines = practice_lines()
    # Keys first: what every task sends for a sorted limit would else be whole texts.
    share = 50 * rows / max(1, docs.count())
    has = has.where(smallest_hashes(F.col("k"), F.lit(share))) if share < 1 else has
    has = has.where(F.col("t").rlike(r"@|[0-9]{3}"))
    keys = has.select("k").where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(rows)
    chosen = has.join(F.broadcast(keys), "k").orderBy(F.xxhash64("k"), "t").limit(rows)
    for t in [r.t for r in chosen.select("t").collect()]:
        for a, b in regions(t)[:TRAIN_LINES]:
            a, b = max(0, a - 20), min(len(t), b + 20)
            if len(lines) < 4 * TRAIN_LINES and not may_hold_secret(t[a:b]):
                lines.append((t[a:b], base_spans(t[a:b])))
    model = SemiCrf()
    model.fit(lines)
    return model


def with_spans(docs: DataFrame, model: SemiCrf, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out.base`` and ``out.spans``: runs of code points with their kinds.

    Base spans are the leftmost non-overlapping matches of each kind's pattern that
    pass its test, and are always among ``spans``; what the model finds is added
    where it touches no base span.  Null and empty texts have none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf(_SPANS)
    def find(t: pa.Array) -> pa.Array:
        if name not in _models:
            _models.clear()
            _models[name] = shared.value
        both = [all_spans(_models[name], x) for x in t.to_pylist()]
        rows = [[[{"first": a, "end": b, "kind": k} for a, b, k in spans] for spans in x] for x in both]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], _LIST), pa.array([r[1] for r in rows], _LIST)], ["base", "spans"])

    return docs.withColumn(out, find(F.col(text)))


def redacted(docs: DataFrame, model: SemiCrf, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def redact(t: pa.Array) -> pa.Array:
        out = []
        for x in t.to_pylist():
            if x is not None:
                done, end = [], 0
                for a, b, k in all_spans(shared.value, x)[1]:
                    if a >= end:
                        done += [x[end:a], f"[{k}]"]
                    end = max(end, b)
                x = "".join(done) + x[end:]
            out.append(x)
        return pa.array(out, pa.string())

    return docs.withColumn(text, redact(F.col(text)))
