"""From raw documents to tokens: five stages, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldgraph.llm import decontaminate, exact_dedup, near_dedup, quality
from foldgraph.llm.common import table, written
from foldgraph.llm.queries import encoded_digests


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs, repeats=False)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_representatives(docs, repeats=False)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what is left."""
    return encoded_digests(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier of the first stage can't be written in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None
