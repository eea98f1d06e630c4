"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldgraph.llm import bpe, chat, decontaminate, exact_dedup, html_text, langid, near_dedup, pii, quality, token_store

LONG = "word " * 30_000 + "x" * 50_000
ROWS = [(1, "the cat sat on the mat", "en", "a", 22), (1, "the cat sat on the mat", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "the cat sat on  the mat", "en", "b", 23), (4, LONG, "de", "b", len(LONG)), (5, " \n\t", None, "b", 3), (6, "ñandú 漢字 🙂 é", "es", None, 9)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASH = ["id", "t", "k", "fp", "q_keep", "kept", "digest", "keep_id", "component_id", "gone_key", "contamination", "host", "path", "n_words", "ids", "score", "pii", "root", "rep", "label", "__row_number", "__contamination", "__found", "__quality_keep", "__v", "__h", "__p", "__b", "__x", "row", "site", "e", "at", "n", "salt"]


@pytest.fixture(params=["plain", "clash", "empty"])
def docs(spark, request):
    df = spark.createDataFrame([] if request.param == "empty" else ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}) if request.param == "clash" else df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (6, 1, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "cat sat on"), (2, None), (3, ""), (None, "ñandú 漢字"), (1, "cat sat on")], "item_id bigint, text string")


def test_exact(docs):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.deduplicate(docs).collect()}
    if rows:
        mat = hashlib.sha256(b"the cat sat on the mat").hexdigest()
        assert rows[1, mat].keep_id == 1 and rows[1, mat].group_size == 3 and rows[1, mat].kept and not rows[None, mat].kept
        assert rows[2, hashlib.sha256(b"").hexdigest()].group_size == 2
        assert rows[5, hashlib.sha256(b" ").hexdigest()].kept
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == (6 if rows else 0)


def test_near(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    if rows:
        found = {r.doc_id: r for r in rows}
        assert {found[k].fp for k in (2, 3, 5)} == {0} and {found[k].component_id for k in (2, 3, 5)} == {2}
        assert found[None].component_id == 1
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == (5 if rows else 0)  # 1 twice, 2, 4, 6


def test_rows_of_one_key_are_told_apart(spark):
    """A copied text takes no unique text of its key along; of each text, and of each group, one row is left."""
    copy, own, third, more = "a b c d e f", "words that no other row has", "once more something else here", "copies of a null key alone"
    rows = [(1, copy), (None, copy), (None, own), (None, more), (None, more), (7, third), (7, third), (7, copy)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for keep in (exact_dedup.keep_first, near_dedup.keep_representatives):
        whole = {(1, copy), (None, own), (None, more), (7, third)}
        found = [tuple(r) for r in keep(docs, repeats=False).collect()]
        assert len(found) == 4 and set(found) == whole
        found = [tuple(r) for r in keep(docs).collect()]
        assert len(found) == 5 and set(found) == whole


def test_quality(docs, labels):
    out = quality.judged(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.q_score <= 1 for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    if out and "q_keep" in docs.columns:
        assert {r.q_keep for r in kept.collect()} == {"own q_keep"}
    none = quality.judged(docs, labels.where("false"))
    assert none.where("q_keep").count() == docs.count()


def test_language(docs):
    out = langid.predicted(docs, langid.train(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) or r.lang_pred == "und"
        assert 0 <= r.score <= 1
    assert len(langid.labelled_words(docs, langid.train(docs)).collect()) == len(out)


def test_decontamination(docs, benchmark):
    rows = decontaminate.with_hits(docs, benchmark, "c").withColumn("n_hit", decontaminate.n_hit("c")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.text and r.text.startswith("the cat"):
            assert (r.c.n_words, r.n_hit, r.c["items"]) == (6, 3, ["1"])
        elif r.text and r.text.startswith("ñ"):
            assert (r.n_hit, r.c["items"]) == (2, ["null"])
        else:
            assert r.n_hit == 0
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == (4 if rows else 0)
    assert decontaminate.keep_clean(docs, benchmark.where("false")).count() == docs.count()


def test_tokens(docs, spark):
    rows = token_store.store_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).orderBy("start").collect()
    assert len(rows) == docs.count()
    if rows:
        assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6]
        assert rows[3].ids == b"\0\0\0\0" and sum(r.n_tokens for r in rows[:3]) == rows[3].start


def test_bpe(docs):
    rows = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r.text or "").encode() for r in docs.select("text").collect())


def test_pii(docs):
    rows = pii.with_spans(docs, pii.train(docs), out="p").collect()
    assert len(rows) == docs.count() and all(r.p.base == [] for r in rows)


def test_html(docs):
    rows = html_text.extracted(docs, "text", "shown").collect()
    assert len(rows) == docs.count() and all(r.shown is not None for r in rows)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 5, "assistant", "<|im_end|>"), (1, 700, "assistant", "")]
    for data in (rows, []):
        made = chat.formatted(chat.to_turns(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("chunk", F.lit("own"))))
        back = made.select("conv_id", "chunk", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
        said = {(r.conv_id, r.chunk): ([tuple(t) for t in r.t], r.loss) for r in back}
        assert said == ({(1, None): ([("", "")], ""), (1, 0): ([("user", "a")] * 2, ""), (1, 10): ([("assistant", "")], ""), (None, 0): ([("assistant", "<|im_end|>")], "<|im_end|>")} if data else {})


def test_stages(docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(docs.sparkSession, now, str(tmp_path))
        if name != "bpe":
            assert nxt.columns == docs.columns
            now = nxt
        assert nxt.count() <= now.count()
    assert corpus_pipeline.run(docs.sparkSession, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
