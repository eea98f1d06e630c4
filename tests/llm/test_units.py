"""Single operators on small made-up inputs."""

from __future__ import annotations

import io
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from brute import pattern_spans
from foldgraph.llm import bpe, chat, common, exact_dedup, quality, similar, token_store
from foldgraph.llm.crf import Crf, _forward_backward, words_of
from foldgraph.llm.html_tree import visible_text
from foldgraph.llm.pii_spans import MODEL_KINDS, SemiCrf, _cuts, all_spans, base_spans, practice_lines, regions, segment_features

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("leaf", [1, 2, 5, 12])
def test_tree_encodes_as_the_library(leaf):
    """One piece per text, so that halves meet inside words, of alphabets that merge a lot."""
    own = bpe.TreeBpe(RANKS, r"(?s).+", leaf)
    lib = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=RANKS, special_tokens={})
    r = random.Random(leaf)
    for _ in range(300):
        letters = r.choice(["a", "ab", " the", "ingtion ", "éè ñ", "0123", " \n\t", "<|>endoftx"])
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 150)))
        ids = own.encode(text)
        assert list(memoryview(ids).cast("I")) == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode() and own.decode(ids, block=3) == text.encode()


def test_store_file():
    out = io.BytesIO()
    w = token_store.Writer(out, frame_bytes=40)
    docs = {k: np.arange(k % 17, dtype="<u4").tobytes() for k in range(50)}
    for k, ids in docs.items():
        w.add(k, ids)
    w.close()
    r = token_store.Reader(io.BytesIO(out.getvalue()))
    assert len(r.frames) > 5 and [r.ids(k) for k in range(50)] == list(docs.values())
    read: list[int] = []
    r.frame = lambda k, f=r.frame: (read.append(k), f(k))[1]
    assert dict(r.find([3, 16])) == {3: docs[3], 16: docs[16]} and len(set(read)) == 2
    broken = bytearray(out.getvalue())
    broken[int(r.begin[2]) + 9] ^= 255
    bad = token_store.Reader(io.BytesIO(bytes(broken)))
    with pytest.raises(token_store.StoreError):
        bad.frame(2)
    assert bad.frame(1)
    for cut in (5, len(broken) // 2, len(broken) - 1):
        with pytest.raises(token_store.StoreError):
            token_store.Reader(io.BytesIO(out.getvalue()[:cut]))


def test_buckets_grow_with_the_first_batch():
    rows = exact_dedup.BUCKET_ROWS
    assert [exact_dedup.buckets_for(n) for n in (0, 1, 16 * rows, 16 * rows + 1, 10**15)] == [16, 16, 16, 32, exact_dedup.MOST_BUCKETS]


def test_index_over_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    batch = lambda rows: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), index).collect()}
    assert batch([(5, "a  b"), (7, "a b"), (6, "c")]) == {5: (5, 2, True), 7: (5, 2, False), 6: (6, 1, True)}
    assert batch([(1, "a\tb"), (2, "d")]) == {1: (5, 1, False), 2: (2, 1, True)}
    assert batch([(1, "a\tb"), (2, "d")]) == {1: (5, 1, False), 2: (2, 1, True)}  # a batch that is run again
    assert index.table().count() == 3
    index.drop()


def test_index_reopened(spark):
    """A named index keeps its own number of buckets; digests stored twice count once, by the earlier batch; compaction changes no answer."""
    index = exact_dedup.DigestIndex(spark, "own_index", buckets=32)
    rows = lambda *x: spark.createDataFrame(x, "id bigint, digest string")
    index.ingest(rows((5, "a"), (6, "b"), (7, "a")))
    again = exact_dedup.DigestIndex(spark, "own_index")
    assert again.buckets == 32
    again.ingest(rows((1, "a"), (2, "c")))
    again._write(spark.createDataFrame([("a", 1, 9), ("c", 0, 9)], "digest string, keep_id bigint, batch bigint"), "own_index")  # a second writer
    want = {"a": 5, "b": 6, "c": 2}
    assert {r.digest: r.keep_id for r in again.table().collect()} == want
    again.compact()
    assert {r.digest: r.keep_id for r in exact_dedup.DigestIndex(spark, "own_index").table().collect()} == want and spark.table("own_index").count() == 3
    plan = again.table()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again.drop()


def test_query_removes_rows_by_the_index(spark, monkeypatch):
    """The registered query takes the documents in by ascending batches, and later batches meet digests that are there."""
    from foldgraph.llm.queries import QUERIES

    seen = []

    def ingest(self, batch, real=exact_dedup.DigestIndex.ingest):
        seen.append((batch.agg(F.min("id")).first()[0], batch.select("digest").distinct().join(self.table(), "digest", "left_semi").count()))
        real(self, batch)

    monkeypatch.setattr(exact_dedup.DigestIndex, "ingest", ingest)
    QUERIES["op5_exact_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert len(seen) >= 2 and seen == sorted(seen) and seen[0][1] == 0 and all(n > 0 for _, n in seen[1:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_layouts(spark):
    records = [
        {"prompt": "q", "response": "a"}, {"completion": "a", "prompt": "q"}, {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "input": "i", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"other": 1}, {"prompt": "q", "response": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)] + [(98, "{broken"), (99, None)], "id int, record string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.to_turns(df).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {0: ("prompt_response", qa), 1: ("prompt_completion", qa), 2: ("instruction_input", qa), 3: ("instruction_input", [qa[0], ("user", "i"), qa[1]]), 4: ("messages", qa), 5: ("conversations", qa), 6: ("unknown", []), 7: ("prompt_response", qa[:1]), 98: ("unknown", []), 99: ("unknown", [])}
    table = spark.createDataFrame([("q", "a")], "prompt string, response string")
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in chat.to_turns(table).collect()] == [("prompt_response", qa)]


def test_additional_fields_lose_no_turns(spark):
    qa = [("user", "q"), ("assistant", "a")]
    said = [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}]
    records = [
        {"id": 1, "messages": said}, {"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "score": 1}]}, {"prompt": "q", "response": "a", "meta": {"x": [1]}},
        {"system": "s", "messages": said, "prompt": "p"}, {"instruction": "q", "input": "", "output": "a", "system": "s", "id": 2}, {"conv_id": 1, "turn": 0, "role": "user", "text": "q", "id": 3}, {"messages": [1, *said]},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "id int, record string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.to_turns(df).collect()}
    system = [("system", "s"), *qa]
    assert got == {0: ("messages", qa), 1: ("conversations", qa), 2: ("prompt_response", qa), 3: ("system_messages", system), 4: ("system_instruction_input", system), 5: ("turn_rows", qa[:1]), 6: ("messages", [(None, None), *qa])}
    table = spark.createDataFrame([(1, "q", "a", "x")], "id int, prompt string, response string, extra string")
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in chat.to_turns(table).collect()] == [("prompt_response", qa)]
    rows = spark.createDataFrame([(1, 0, "user", "q", "x")], "conv_id int, turn int, role string, text string, extra string")
    assert chat.layout_of(chat.paths_of(rows.schema)) is chat.TURN_ROWS and chat.to_turns(rows).first().layout == "turn_rows"


def test_template_is_reversible(spark):
    r = random.Random(3)
    bits = [*chat.CONTROL, *(c[:1] + "\\" + c[1:] for c in chat.CONTROL), "\\", "<", "[", "|", ">", "s>", "INST]", "a", "\n", "é🙂", "$1"]
    rows = [(c, t, r.choice(["user", "assistant", "<s>", "|im_sep|>"]), "".join(r.choice(bits) for _ in range(r.randrange(9)))) for c in range(60) for t in range(4)]
    made = chat.formatted(chat.to_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    for x in made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        own = [(role, text) for c, _, role, text in rows if c == x.conv_id]
        assert [tuple(t) for t in x.t] == own and x.loss == "".join(t for role, t in own if role == "assistant")
        assert x.formatted.count(chat.OPEN) == x.formatted.count(chat.END) == 4 and "[INST]" not in x.formatted and "</s>" not in x.formatted


def test_pages():
    assert visible_text("<p>a<p>b <b>c</b>  d<br>e<div>f</div>g") == "a\n\nb c d\ne\n\nf\ng"  # a paragraph ends with a blank line
    assert visible_text("<ul><li>x<li>y<ol start=3><li>q</ol></ul>") == "- x\n- y\n  3. q"
    assert visible_text("<table><tr><th>A<th>Longer<tr><td>longest<td>2</table>") == "A        Longer\nlongest  2"
    assert visible_text("<pre>\n a\n  b</pre>") == " a\n  b"
    assert visible_text("<title>t</title><script>if (a<b) c()</script><style>x</style>v<span hidden>n</span><i style='DISPLAY: none'>n</i>") == "v"
    assert visible_text("<div style='visibility:hidden'>n<b style='visibility:visible'>y</b></div>") == "y"
    assert visible_text("<details><summary>s</summary>n</details><details open>o</details>") == "s\no"
    assert visible_text("a &amp; b &lt;c&gt; &copy; < d <!-- x > y --> e") == "a & b <c> © < d e"
    assert visible_text("<p>x<a href='u>v'>w</a></p></div></b>z") == "xw\n\nz"
    assert visible_text("<div>" * 5000 + "deep") == "deep" and visible_text(None) == visible_text("") == ""


def test_deep_pages():
    """Whatever the depth: code and hidden text stay out, marks, cells and end tags count."""
    for n in (150, 300, 5000):
        deep = "<div>" * n
        assert visible_text(deep + "<script>c()</script><style>s</style><i hidden>n</i><b style='display:none'>n</b>v") == "v"
        assert visible_text(deep + "<ul><li>x<li>y</ul><table><tr><td>a<td>b</table>") == "- x\n- y\n\na  b"
        assert visible_text("<div hidden>" + deep + "<b><i>n</i></b>" * 300 + "</div>" * n + "n</div>v") == "v"
    n = 20_000
    assert visible_text("<ul><li>x" * n).count("- x") == n and visible_text("<table><tr><td>x<td>" * 3000).count("x") == 3000
    assert visible_text("<p><button>" + "<b>x<div>" * n).count("x") == n


def test_formulas_and_drawings():
    assert visible_text("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/><annotation encoding='t'>n</annotation></math> b") == "a x= 1 2 b"
    assert visible_text("<svg><title>n</title><desc>n</desc><defs><text>n</text></defs><metadata>n</metadata><style/><path d='M0'/>n<g><text>A<tspan>b</tspan></text><text>C</text></g></svg>d") == "Ab C d"
    assert visible_text("<svg><defs/><title/><text>y</text><text display='none'>n</text><g visibility='hidden'><text>n</text></g></svg>z") == "y z"
    assert visible_text("<svg><switch><foreignObject><div>in <b>it</b></div></foreignObject><text>n</text></switch></svg>") == "in it"
    assert visible_text("<svg><g>n<div>out</div>v") == "out\nv" and visible_text("<div><svg/>v</div>") == "v"


def test_spans():
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice(r.choice(["a@.b-", "1234567890.", "12 -", "+1 ()-.2", "a@b.c1 +2-3(4).%_\n"])) for _ in range(r.randrange(60)))
        assert base_spans(text) == pattern_spans(text)
    model = SemiCrf()
    model.fit(practice_lines())
    text = "call (555) 123-4567, +1 (269) 555-3296 4524132264652876 on 2024-05-06"
    base, every = all_spans(model, text)
    for odd in ("see 10.2.3\u00b2.44 now", "1\u00b2.2.3.4567 @\u00bd.\u0663", "+1" * 300, "1.1" * 300):  # digits that are no numbers; regions of many candidates
        assert all_spans(model, odd)[0] == pattern_spans(odd)
    assert base == [] and {(text[a:b], k) for a, b, k in every} == {("(555) 123-4567", "phone"), ("+1 (269) 555-3296", "phone"), ("4524132264652876", "card")}


def test_code_switching():
    r = random.Random(1)
    words = {"x": ["kalo", "kami", "kate", "kuru"], "y": ["bex", "box", "bix", "bux"]}
    texts = [(k, " ".join(r.choice(words[k]) for _ in range(60))) for k in "xy" for _ in range(20)]
    crf = Crf(["x", "y"])
    crf.fit([t for _, t in texts], ["xy".index(k) for k, _ in texts])
    assert [k for _, k, _ in crf.label_words("kalo kate kami kuru bex bix box bux kalo kami kate")] == ["x"] * 4 + ["y"] * 4 + ["x"] * 3
    assert crf.moves[0, 0] > crf.moves[0, 1] and crf.moves[1, 1] > crf.moves[1, 0]


def test_language_of_odd_texts():
    """Signs that count as numbers are no letters; texts labelled together or one by one are labelled alike."""
    crf = Crf(["x", "y"])
    crf.fit(["kalo kami kate"] * 9 + ["bex box bix"] * 9, [0] * 9 + [1] * 9)
    texts = ["\u00bd \u00b2", "1 2", None, "", "kalo", "m\u00b2 bex box", "kami " * 500]
    found = crf.document_labels(texts)
    assert [k for k, _ in found] == ["und"] * 4 + ["x", "y", "x"] and [s for _, s in found[:4]] == [0.0] * 4
    assert [k for k, _ in crf.document_labels(texts, together=1)] == [k for k, _ in found] and crf.document_labels([]) == []


def test_language_of_long_runs():
    """Text without spaces is judged by all of its letters, and every three neighbours are features."""
    crf = Crf(["x", "y"])
    crf.fit(["kalo kami kate"] * 9 + ["bex box bix"] * 9, [0] * 9 + [1] * 9)
    run = "kalokami" * 5 + "bexboxbix" * 40
    assert [k for k, _ in crf.document_labels([run, run[::-1], "kalokami" * 50 + "bex"])] == ["y", "y", "x"]
    found = crf.label_words(run)
    assert "".join(w for w, _, _ in found) == run and found[0][1] == "x" and found[-1][1] == "y"
    for n in range(28, 130):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        parts = [w.strip("-") for w in words_of(run)]
        assert {w[i : i + 3] for w in parts for i in range(len(w) - 2)} == {run[i : i + 3] for i in range(n - 2)} and max(map(len, parts)) <= 30


def test_batches_are_bounded(spark):
    """Long texts come in batches of few rows."""

    @F.arrow_udf("long")
    def rows_of_batch(t: pa.Array) -> pa.Array:
        return pa.array([len(t)] * len(t), pa.int64())

    common.small_batches(spark, rows=400, size=1 << 20)
    try:
        seen = spark.range(0, 300, 1, 1).select(rows_of_batch(F.repeat(F.lit("x"), 100_000))).distinct().toArrow()[0].to_pylist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", common.BATCH_BYTES)
    assert max(seen) < 20


def test_sites_shrink(spark):
    """A sparse site stays near the level above it; a large one speaks for itself."""
    rows = [("good", "a", 0.95)] * 400 + [("bad", "a", 0.05)] * 400 + [("bad", "b", 0.95)] + [("new", "a", 0.05)] + [(f"h{i}", "a", 0.9 if i % 3 else 0.2) for i in range(60) for _ in range(20)]
    got = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["good", "a"].path_rate > 0.9 and got["bad", "a"].path_rate < 0.1
    assert 0.05 < got["bad", "b"].path_rate < 0.9 and 0.1 < got["new", "a"].host_rate < got["new", "a"].base
    same = quality.site_posteriors(spark.createDataFrame([(f"h{i % 5}", "a", 0.8 if i % 7 else 0.3) for i in range(700)], "host string, path string, p double")).collect()
    assert max(abs(r.path_rate - r.base) for r in same) < 0.02  # no spread between sites: nobody overrules the prior


def test_added_tokens_in_texts():
    """The library as it comes: an added token inside a text is that token, wherever it stands."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_store.WordEncoder(path, public_tokenizers.PATTERN)
    mark = sorted(t.content for t in lib.get_added_tokens_decoder().values())[0]
    texts = [f"a {mark} b", mark, mark * 3, f"x{mark}y", mark[:-1], f"{mark[:-1]} {mark[-1]}", "plain words only", None, "", f" {mark}\n"]
    assert [list(memoryview(x).cast("I")) for x in own.encode_all(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lib.token_to_id(mark) in memoryview(own.encode(texts[0])).cast("I")


def labelings(size, n):
    return np.stack(np.meshgrid(*[range(size)] * n, indexing="ij"), -1).reshape(-1, n)


def test_posteriors_by_enumeration():
    """All labelings of short texts, several texts at once; long texts against a plain pass."""
    r = np.random.default_rng(4)
    moves = r.normal(size=(3, 3))
    counts = np.array([1, 2, 0, 3, 4, 5, 6, 1])
    scores = r.normal(size=(counts.sum(), 3)) * 2
    got = np.split(_forward_backward(scores, counts, moves), np.cumsum(counts)[:-1])
    for e, g in zip(np.split(scores, np.cumsum(counts)[:-1]), got, strict=True):
        if len(e):
            ways = labelings(3, len(e))
            weight = np.exp(sum(e[i, ways[:, i]] for i in range(len(e))) + sum(moves[ways[:, i], ways[:, i + 1]] for i in range(len(e) - 1)))
            own = np.array([[weight[ways[:, i] == k].sum() for k in range(3)] for i in range(len(e))]) / weight.sum()
            assert np.abs(own - g).max() < 1e-9
    counts = np.array([200, 1, 33, 32, 31, 64])
    scores = r.normal(size=(counts.sum(), 3))
    got = np.split(_forward_backward(scores, counts, moves), np.cumsum(counts)[:-1])
    for e, g in zip(np.split(scores, np.cumsum(counts)[:-1]), got, strict=True):
        a, b = [np.exp(e[0])], [np.ones(3)]
        for x in e[1:]:
            v = (a[-1] @ np.exp(moves)) * np.exp(x)
            a.append(v / v.sum())
        for x in e[:0:-1]:
            v = np.exp(moves) @ (b[-1] * np.exp(x))
            b.append(v / v.sum())
        own = np.array(a) * np.array(b[::-1])
        assert np.abs(own / own.sum(1, keepdims=True) - g).max() < 1e-9


@pytest.fixture(scope="module")
def span_model():
    model = SemiCrf()
    model.fit(practice_lines())
    return model


def test_added_spans_of_unseen_lines(span_model):
    """Precision and recall on made-up lines of another seed: of what the patterns miss, and of everything."""
    want, got = set(), set()
    for k, (text, gold) in enumerate(practice_lines(seed=77, n=60)):
        want |= {(k, *s) for s in gold}
        got |= {(k, *s) for s in all_spans(span_model, text)[1]}
    lines = [t for t, _ in practice_lines(seed=77, n=60)]
    base = {(k, *s) for k, t in enumerate(lines) for s in base_spans(t)}
    for w, g in ((want, got), (want - base, got - base)):
        precision, recall = len(w & g) / len(g), len(w & g) / len(w)
        print(f"precision {precision:.3f}, recall {recall:.3f} of {len(w)}")
        assert precision >= 0.9 and recall >= 0.9


def segmentations(segments, n, at=0):
    """All ways to cover cuts ``at`` to ``n - 1`` by segments and single tokens outside them."""
    if at == n - 1:
        yield []
        return
    yield from segmentations(segments, n, at + 1)
    for i, j in segments:
        if i == at:
            for rest in segmentations(segments, n, j):
                yield [(i, j), *rest]


def test_best_segmentation_by_enumeration(span_model):
    """Boundaries and kinds of the decoder are those of the best of all segmentations."""
    for text in ("a 10.2.3.44 b@c.org x", "+1 (269) 555-3296", 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"', "12 345 678 9012"):
        for a, b in regions(text):
            cuts = _cuts(text, a, b)
            segments = list(span_model._segments(text, cuts))
            value = {(i, j): max(zip(span_model.scores(segment_features(text, cuts[i], cuts[j])), MODEL_KINDS, strict=True)) for i, j in segments}
            best = max((sum(value[s][0] for s in way) for way in segmentations(segments, len(cuts))), default=0.0)
            where = {c: k for k, c in enumerate(cuts)}
            found = span_model.decode(text, a, b)
            assert abs(sum(value[where[x], where[y]][0] for x, y, _ in found) - best) < 1e-9
            assert all(value[where[x], where[y]][1] == k for x, y, k in found)


def test_fit_follows_the_likelihood():
    """The gradient's sums over segmentations are those of an enumeration: one small step raises the likelihood of the truth."""
    text, gold = "10.2.3.44 or 12345678", [(0, 9, "ip")]

    def likelihood(model):
        total, own = [], 0.0
        for a, b in regions(text):
            cuts = _cuts(text, a, b)
            segments = list(model._segments(text, cuts))
            score = {(i, j): dict(zip(MODEL_KINDS, model.scores(segment_features(text, cuts[i], cuts[j])), strict=True)) for i, j in segments}
            total.append(np.log(sum(np.prod([sum(np.exp(v) for v in score[s].values()) for s in way]) for way in segmentations(segments, len(cuts)))))
            where = {c: k for k, c in enumerate(cuts)}
            own += sum(score[where[x], where[y]][k] for x, y, k in gold if x in where and y in where)
        return own - sum(total)

    model = SemiCrf()
    before = likelihood(model)
    for _ in range(4):
        model.fit([(text, gold)], rounds=1, rate=0.05)
        now = likelihood(model)
        assert now > before
        before = now


def plain_strength(groups, centres):
    """Mean rate and prior strength of groups of probabilities, by the method of moments."""
    n, g = sum(map(len, groups)), len(groups)
    rates = [np.mean(x) for x in groups]
    mean = min(max(sum(map(sum, groups)) / n, 1e-4), 1 - 1e-4)
    centres = [sum(map(sum, groups)) / n] * g if centres is None else centres
    between = sum(len(x) * (r - c) ** 2 for x, r, c in zip(groups, rates, centres, strict=True))
    within = sum(((np.array(x) - r) ** 2).sum() for x, r in zip(groups, rates, strict=True)) / max(n - g, 1)
    spread = (between - max(g - 1, 0) * within) / max(n - sum(len(x) ** 2 for x in groups) / n, 1)
    return mean, max(mean * (1 - mean) / spread - 1, 0.01) if spread > mean * (1 - mean) * 1e-6 else 1e6


def test_site_posteriors_by_definition(spark):
    """Rates of sites without the document itself, and scores, again in plain Python; null sites are apart from empty ones."""
    r = random.Random(8)
    sites = [(h, p) for h in ("a", "b", None, "", "c") for p in ("x", "y", None, "")]
    rows = [(i, *r.choice(sites), r.choice(["", "good words here", "word " * 9, "X | Y | Z", "A!! B!!"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, lang string, text string")
    labels = spark.createDataFrame([(i, int("|" not in t and "!" not in t), 0) for i, _, _, t in rows if i % 2], "doc_id int, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judged(docs, labels).collect()}
    p = {k: 1 / (1 + np.exp(-x.q_evidence)) for k, x in got.items()}
    hosts, paths = {}, {}
    for i, h, q, _ in rows:
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, q), []).append(p[i])
    base, k1 = plain_strength(list(hosts.values()), None)
    _, k2 = plain_strength(list(paths.values()), [np.mean(hosts[h]) for h, _ in paths])
    logit = lambda x: np.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for i, h, q, _ in rows:
        host = (k1 * base + sum(hosts[h]) - p[i]) / (k1 + len(hosts[h]) - 1)
        path = (k2 * host + sum(paths[h, q]) - p[i]) / (k2 + len(paths[h, q]) - 1)
        score = 1 / (1 + np.exp(-(got[i].q_evidence + logit(path) - logit(base))))
        assert np.allclose([got[i].q_host_rate, got[i].q_path_rate, got[i].q_score], [host, path, score], atol=1e-9)


@pytest.mark.parametrize("size", [0, 1, 60, 700, 5000])
def test_parities_are_a_lower_bound(size):
    """Differing parities are never more than what is not common, and close to it as long as that is little."""
    r = np.random.default_rng(size)
    for extra in (0, 1, 30, 400, 3000):
        common, own = (np.unique(r.integers(0, 1 << 64, n, np.uint64, endpoint=False)) for n in (size, extra))
        cut = r.integers(0, own.size + 1)
        a, b = (np.union1d(common, x) for x in (own[:cut], own[cut:]))
        apart = int((similar.parities(a) ^ similar.parities(b)).sum())
        assert apart <= np.setxor1d(a, b).size
        assert apart >= 0.8 * own.size or own.size > 100


def test_stored_rows_are_numbered_without_a_copy(spark, tmp_path):
    """Files in several folders, more rows than a row group's share of a task, names that clash, none at all."""
    own = spark.range(3000).selectExpr("id", "id % 3 AS part", "id AS __file_path", "id AS __row_number")
    own.repartition(4).write.partitionBy("part").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    rows, row = common.numbered(stored, "n")
    assert common._stored(stored) and not common._stored(stored.where("id > 1")) and not common._stored(own)
    first, again = ({r.id: r[row] for r in x.select("id", row).collect()} for x in (rows, rows.where("id % 2 = 0")))
    assert len(set(first.values())) == 3000 and again == {k: v for k, v in first.items() if k % 2 == 0}
    assert {tuple(r) for r in rows.drop(row).collect()} == {tuple(r) for r in stored.collect()}
    twice, row = common.numbered(spark.read.parquet(f"{tmp_path}/t/part=0", f"{tmp_path}/t/part=0"), "n")
    assert twice.select(row).distinct().count() == twice.count() == 2000
    other, row = common.numbered(own.withColumnRenamed("part", "_metadata"), "n")
    assert other.select(row).distinct().count() == 3000
    own.where("id < 0").write.parquet(f"{tmp_path}/e")
    assert common.numbered(spark.read.parquet(f"{tmp_path}/e"), "n")[0].count() == 0
