"""Parsers, records, sessions, streams and the registered queries."""

from __future__ import annotations

import os
import struct
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from foldgraph.functions.terms import LITERAL_NODE, RDF, RDF_TYPE, TYPE_NODE, level_name, percent_encoded
from foldgraph.operators import preprocess
from foldgraph.plans.oracle import ORACLE
from foldgraph.plans.queries import QUERIES
from foldgraph.plans.session import SummarySession
from foldgraph.sources import ntriples, records
from foldgraph.streaming.triples import append_triples, triple_stream

SF = "/root/testdata/sf0.001"
LINES = [
    "# a comment", "", '<http://x/s> <http://x/p> <http://x/o> .', '<http://x/s> <http://x/p> "plain" .', '  <http://x/s> <http://x/p> "5"^^<http://x/int> .  ', '<http://x/s> <http://x/p> "hé"@fr .',
    r'<http://x/s> <http://x/p> "a \"quoted\" one \\" .', '_:b1 <http://x/p> _:b2 .', '_:odd@<>"" <_:what?> <http://x/o> .', '<http://x/s> <http://x/p> <http://x/o> .',
]


def lines(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "value string")


def test_triples(spark):
    rows = ntriples.terms(ntriples.parsed(lines(spark, LINES))).collect()
    assert len(rows) == 8 and [r.o_kind for r in rows].count("literal") == 4
    assert ("_:b1", "http://x/p", "_:b2", "blank") in map(tuple, rows) and ('_:odd@<>""', "_:what?", "http://x/o", "iri") in map(tuple, rows)
    plain = {tuple(r) for r in preprocess.preprocessed(ntriples.terms(ntriples.parsed(lines(spark, LINES)))).distinct().collect()}
    assert ("http://x/s", "http://x/p", LITERAL_NODE) in plain and len(plain) == 4


def test_bad_lines(spark):
    bad = lines(spark, ["<a> <b> .", "<a> <b> <c> ."])
    assert [r.bad for r in ntriples.parsed(bad, strict=False).collect()] == ["<a> <b> .", None]
    with pytest.raises(Exception, match="not a triple"):
        ntriples.parsed(bad).collect()


def test_quads_and_wrapped(spark):
    q = lines(spark, ["<a> <b> <c> <g> .", '<a> <b> "x y" <g> .', "<a> <b> <c> ."])
    assert [r.value for r in ntriples.quads_to_triples(q).collect()] == ["<a> <b> <c> .", '<a> <b> "x y" .', "<a> <b> <c> ."]
    w = lines(spark, ["<g> {", "<a> <b> <c> .", "}"])
    assert ntriples.unwrapped(w).count() == 1
    with pytest.raises(Exception, match="opening"):
        ntriples.unwrapped(lines(spark, ["<a> <b> <c> ."])).collect()


def test_flags(spark):
    rows = spark.createDataFrame([("s", RDF_TYPE, "T", "iri"), ("s", RDF + "first", "o", "iri"), ("s", "p", RDF + "nil", "iri"), (RDF + "List", "p", "o", "iri"), ("s", RDF + "Fakething", "o", "iri"), ("s", "p", '"x"', "literal")], "s string, p string, o string, o_kind string")
    found = lambda **flags: {tuple(r) for r in preprocess.preprocessed(rows, **flags).collect()}
    assert {p for _, p, _ in found(skip_rdf_lists=True, skip_literals=True)} == {RDF_TYPE, RDF + "Fakething"}
    assert ("s", "T", TYPE_NODE) in found(types_to_predicates=True)


def test_records(spark, tmp_path):
    data = [(1, 2, 3), (2**40 - 1, 2**32 - 1, 0)]
    (tmp_path / "e.bin").write_bytes(b"".join(s.to_bytes(5, "little") + p.to_bytes(4, "little") + o.to_bytes(5, "little") for s, p, o in data))
    assert sorted(map(tuple, records.read_edges(spark, str(tmp_path / "e.bin")).collect())) == data
    assert sorted(tuple(r)[0] for r in records.read_edges(spark, str(tmp_path / "e.bin"), reverse=True).collect()) == [0, 3]
    signed = spark.createDataFrame([(-5, 7), (12, 0)], "b bigint, k int").withColumn("k", F.col("k").cast("bigint"))
    packed = [bytes(r.record) for r in records.packed(signed, [("b", "block_or_singleton"), ("k", "level")]).collect()]
    assert packed == [(-5).to_bytes(5, "little", signed=True) + struct.pack("<H", 7), (12).to_bytes(5, "little") + struct.pack("<H", 0)]
    (tmp_path / "b.bin").write_bytes(b"".join(packed))
    assert sorted(map(tuple, records.read_records(spark, str(tmp_path / "b.bin"), [("b", "block_or_singleton"), ("k", "level")]).collect())) == [(-5, 7), (12, 0)]


def test_checked_records(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(bytes(42))
    assert records.checked_edges(spark, str(tmp_path / "e.bin")) == 3
    (tmp_path / "f.bin").write_bytes(bytes(43))
    with pytest.raises(ValueError, match="f.bin"):
        records.checked_edges(spark, str(tmp_path))
    assert spark.range(1).select(level_name(F.lit(7)).alias("x")).first().x == "0007"


def test_names_are_combined_before_the_shuffle(spark):
    plan = QUERIES["rdf_sizes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_percent(spark):
    from urllib.parse import quote

    text = "iri_block-a b:/?#[]@!$&'()*+,;=~%é_.-"
    assert spark.range(1).select(percent_encoded(F.lit(text)).alias("x")).first().x == quote(text, safe=":/?#[]@!$&'()*+,;=")


def test_session(spark, tmp_path):
    (tmp_path / "g.nt").write_text("".join(f"<v{i}> <e> <v{i + 1}> .\n<v{i}> <{RDF_TYPE}> <T{i % 2}> .\n" for i in range(4)))
    s = SummarySession(spark, str(tmp_path / "g.nt"), str(tmp_path / "out"))
    s.change_settings(typed_start=True, names="iri_set")
    with pytest.raises(RuntimeError):
        s.summarise()
    with pytest.raises(KeyError):
        s.change_settings(nothing=1)
    assert "multi_summary_complete" in s.run()
    assert s.quotient(0).count() > 0 and s.counts().count() > 0 and s.plot_data()["density"].count() > 0
    text = "\n".join(r.value for r in spark.read.text(s.serialize("cdirs")).collect())
    assert all(f"#{x}>" in text for x in ("size", "contains", "refines", "startLevel", "endLevel"))
    assert s.experiment_state == {"summary_status": "multi_summary_complete", "plotted": True, "serialized": True}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<a> <b> <c> .\nbroken\n")
    for more in ("", "<d> <b> <c> .\n"):
        if more:
            (tmp_path / "in" / "b.nt").write_text(more)
        append_triples(triple_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", "b", "c"), ("d", "b", "c")}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    want = tables.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_rest_works_without_the_corpus_operators(tmp_path):
    """The driver contract holds where the corpus operators are absent."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "foldgraph"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else _without_llm(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'data_edges_condensed' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def _without_llm(source, target):
    os.mkdir(target)
    for x in os.listdir(source):
        if x not in ("llm", "__pycache__"):
            os.symlink(f"{source}/{x}", f"{target}/{x}")
