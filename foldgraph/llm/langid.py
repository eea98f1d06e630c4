"""Language of documents and of their words, by a linear-chain CRF."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, smallest_hashes, unused
from .crf import Crf

#: Most training documents of each language (the smallest hashes of their keys).
TRAIN_DOCS = 150
_models: dict[str, Crf] = {}


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = TRAIN_DOCS) -> Crf:
    """Learn labels, lexicons and weights from at most ``per_lang`` documents a language.

    Only rows with a language, a text and a key that is not held out are used.  No
    such row: a model without labels, which says ``und``.
    """
    usable = docs.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # One row per language, and a language is a label of the model: a small table.
    counts = docs.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__rows"))
    few = smallest_hashes(F.col(key), F.lit(20.0 * per_lang) / F.col("__rows"))
    usable = usable.select(key, lang, text).join(F.broadcast(counts), F.col(lang) == F.col("__lang")).where(few)
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), key, text)
    chosen = usable.select(key, lang, text).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang)  # limited before it is shuffled
    rows = sorted(((r[lang], r["__n"], r[text]) for r in chosen.collect()), key=lambda r: r[:2])
    labels = sorted({r[0] for r in rows})
    crf = Crf(labels)
    crf.fit([r[2] for r in rows], [labels.index(r[0]) for r in rows])
    return crf


def _apply(docs: DataFrame, crf: Crf, out_type: str, text: str, each) -> Column:
    spark = docs.sparkSession
    small_batches(spark)
    shared, name = spark.sparkContext.broadcast(crf), uuid.uuid4().hex

    @F.arrow_udf(out_type)
    def label(t: pa.Array) -> pa.Array:
        if name not in _models:
            _models.clear()
            _models[name] = shared.value
        return each(_models[name], t.to_pylist())

    return label(F.col(text))


def predicted(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    ``score`` is the mean, over all words, of the posterior of the predicted
    language.  Texts that are null or have no letters: ``und``, 0.
    Columns named ``lang_pred`` and ``score`` are replaced.
    """

    def each(model: Crf, texts: list) -> pa.Array:
        found = model.document_labels(texts)
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])

    own = unused(docs, "__found")[0]
    out = docs.withColumn(own, _apply(docs, crf, "struct<lang_pred:string,score:double>", text, each))
    return out.withColumn("lang_pred", F.col(f"{own}.lang_pred")).withColumn("score", F.col(f"{own}.score")).drop(own)


def labelled_words(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """``docs`` with ``words``: each word, its language and the probability of it."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def each(model: Crf, texts: list) -> pa.Array:
        return pa.array([[{"word": w, "lang": k, "p": p} for w, k, p in model.label_words(t or "")] for t in texts], kind)

    return docs.withColumn("words", _apply(docs, crf, "array<struct<word:string,lang:string,p:double>>", text, each))
