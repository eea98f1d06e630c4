"""The registered queries and the pipeline, held against brute force on the driver's tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from brute import contamination, pattern_spans, similar_components
from foldgraph.llm import bpe, near_dedup, pii_spans, quality, similar
from foldgraph.llm.queries import ORACLE, QUERIES
from foldgraph.llm.shingles import simhash

SF = "/root/testdata/sf0.001"


def read(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(read("documents", "doc_id, text"))


def plain_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest key reachable, by comparing all pairs."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    values = np.array([fps[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            a, b = find(k), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_query(spark, texts):
    fps = {k: plain_simhash(t or "") for k, t in texts.items()}
    own = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == {k: (f"{fps[k]:016x}", own[k]) for k in texts}


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_hot_buckets(spark, hot):
    """Clusters of fingerprints around few centres: every bucket size gives the components of all pairs."""
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}))
    signed = {x - (1 << 64) if x >> 63 else x for x in fps}
    links = near_dedup.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), hot=hot)
    assert all((a ^ b).bit_count() <= 3 for a, b in ((x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in links.collect()))
    got = {x.node: x.root for x in near_dedup.connected_components(links, "a", "b").collect()}
    own = components({x: x & (1 << 64) - 1 for x in signed})
    assert {x: got.get(x, x) for x in signed} == own


@pytest.mark.parametrize("crowd,hashes,moved", [(64, 10**9, 0.5), (8, 0, 0.0), (10**9, 0, 0.5)])
def test_similar_texts(spark, monkeypatch, crowd, hashes, moved):
    """Groups of copies with few and with many changes: the groups of all pairs, by buckets and by stars, verified at once and in rounds."""
    for name, value in (("CROWD", crowd), ("SAMPLE", 1), ("BROADCAST_HASHES", hashes), ("MOVED", moved)):
        monkeypatch.setattr(similar, name, value)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    made = ["", " \n", None, "two words", "Two Words", "two  words more"]
    for size, n, changes in ((120, 60, 3), (80, 25, 4), (60, 12, 1), (300, 9, 9), (12, 6, 1), (40, 40, 2)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            copy = list(base)
            for _ in range(r.randrange(changes + 1)):
                copy[r.randrange(size)] = word()
            made.append(" ".join(copy))
    texts = dict(enumerate(r.sample(made, len(made))))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    own = similar_components(texts)
    assert {x.doc_id for x in near_dedup.keep_representatives(docs).collect()} == set(own.values()) and 12 < len(set(own.values())) < len(own) // 2


def test_jvm_hash_is_ours(spark):
    from pyspark.sql import functions as F

    t = "é ñ words here"
    row = spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(t.encode(), 42)
    assert simhash(t) == plain_simhash(t)


def test_language_query(spark):
    truth = dict(read("documents", "doc_id, lang"))
    rows = QUERIES["op3_langid"](spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_decontamination_query(spark, texts):
    items = [(str(i), t) for i, t in read("benchmark", "item_id, text")]
    for r in QUERIES["op4_decontaminate"](spark, SF).collect():
        n, hit, names = contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n)


def test_decontamination_in_blocks(spark):
    from foldgraph.llm import decontaminate

    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.with_hits(docs, bench, "c").select("doc_id", "c").collect()
    assert len(decontaminate._item_blocks(bench, "item_id", "text", 3000)) > 2
    assert sorted(one) == sorted(decontaminate.with_hits(docs, bench, "c", block_bytes=3000).select("doc_id", "c").collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_token_query(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for k in sorted(texts):
        ids = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_store"](spark, SF).collect()} == want


def test_pii_query(spark, texts):
    for r in QUERIES["op9_pii"](spark, SF).collect():
        base = pattern_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii_spans.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(",")) | {""}


def tokenised(texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {}
    for k, t in texts.items():
        ids = enc.encode_ordinary(t or "")
        out[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return out


def test_bpe_query(spark, texts):
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe"](spark, SF).collect()} == tokenised(texts)


def test_quality_query(spark):
    """All labelled rows that nothing but their quality speaks for or against."""
    truth = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet' where coalesce(toxic, 0) = 0").fetchall())
    got = {r.doc_id: r.q_keep for r in QUERIES["op1_quality"](spark, SF).collect()}
    assert np.mean([got[k] == bool(q) for k, q in truth.items()]) >= 0.98


def test_quality_on_labels_kept_out_of_the_fit(spark):
    """Fitted on two thirds of the labels; of the rest, clean documents stay and bad or toxic English ones go."""
    large = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    out = quality.judged(docs, labels.where("crc32(string(doc_id)) % 3 <> 0"), drop=("text",))
    held = out.join(labels.where("crc32(string(doc_id)) % 3 = 0"), "doc_id").select("lang", "q_keep", "quality", "toxic").collect()
    clean = [r.q_keep for r in held if r.quality == 1 and r.toxic == 0]
    bad = [r.q_keep for r in held if r.quality == 0]
    toxic = [r.q_keep for r in held if r.toxic == 1 and r.lang == "en"]
    print(len(clean), np.mean(clean), len(bad), np.mean(bad), len(toxic), np.mean(toxic))
    assert np.mean(clean) >= 0.99 and np.mean(bad) <= 0.05 and np.mean(toxic) <= 0.1


def test_pipeline(spark, texts):
    """Each stage again by plain means, on what the classifier kept."""
    good = {r.doc_id for r in QUERIES["op1_quality"](spark, SF).where("q_keep").collect()}
    left = {k: t for k, t in texts.items() if k in good}
    first = {}
    for k in sorted(left):
        first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", left[k] or "")), k)
    left = {k: left[k] for k in first.values()}
    own = similar_components(left)
    left = {k: t for k, t in left.items() if own[k] == k}
    items = [(str(i), t) for i, t in read("benchmark", "item_id, text")]
    found = {k: contamination(t, items) for k, t in left.items()}
    left = {k: t for k, t in left.items() if not (found[k][1] and 20 * found[k][1] >= found[k][0])}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == tokenised(left)


def test_no_python_on_native_paths(spark):
    for name in ("op5_exact_dedup", "op6_chat"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
