"""Summaries of small graphs against known results, and of random graphs against the definition."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from foldgraph.operators import stats, summary
from foldgraph.operators.bisimulation import refinement, typed_start, universal_start
from foldgraph.operators.graphs import nodes


def path(*names, p="1"):
    return [(a, p, b) for a, b in zip(names, names[1:], strict=False)]


V = [f"v{i}" for i in range(20)]
RUNGS = [((1, 2), (3, 4)), ((3, 4), (5, 6)), ((5, 6), (7, 8)), ((7, 8), (9, 10))]
BONDS = [("H1 C1", 1), ("H2 C1", 1), ("H3 C1", 1), ("C1 O1", 1), ("O1 C2", 1), ("C2 C3", 1), ("C4 C5", 1), ("C5 O4", 1), ("O4 C6", 1), ("C6 H4", 1), ("C6 H5", 1), ("C6 H6", 1), ("C2 O2", 2), ("C5 O3", 2), ("C3 C4", 3)]
GRAPHS = {
    "simple_edge": [("v1", "1", "L")],
    "simple_small_cycle": [("a", "1", "b"), ("b", "1", "a")],
    "simple_chain": path(*V[1:9], "L"),
    "simple_chain_fork": path(*V[1:10]) + [("v8", "1", "L")],
    "simple_cycle": path("v1", "v2", "v3", "v1") + [(v, "1", "L") for v in ("v1", "v2", "v3")],
    "simple_cycles": [("v1", "1", x) for x in ("v2", "v3", "v4", "L")] + path("v4", "v5", "v6", "v7") + [("v2", "1", "v7"), ("v3", "1", "v7"), ("v7", "1", "v1")],
    "simple_dag": [("v1", "1", "v3"), ("v2", "1", "v3"), ("v3", "1", "v5"), ("v4", "1", "v5"), ("v5", "1", "v7"), ("v6", "1", "v7"), ("v7", "1", "v8"), ("v8", "1", "L")],
    "heterogeneous_cycle": [("v1", "1", "v2"), ("v2", "2", "v3"), ("v3", "1", "v4"), ("v4", "2", "v1"), ("v2", "2", "L"), ("v4", "2", "L")],
    "heterogeneous_hubs": [("v1", "1", "v2"), ("v1", "2", "v3"), ("v1", "3", "L"), ("v2", "1", "v1"), ("v2", "2", "v3"), ("v2", "3", "L"), ("v3", "1", "v4")],
    "multi_block_tree": [("v1", "1", "v5"), ("v2", "1", "v5"), ("v3", "1", "v6"), ("v4", "1", "v6"), ("v5", "2", "L"), ("v6", "3", "L")],
    "multi_block": [("v1", "1", "v9"), ("v2", "1", "v9"), ("v3", "2", "v9"), ("v4", "2", "v9"), ("v5", "1", "v10"), ("v6", "1", "v10"), ("v7", "2", "v10"), ("v8", "2", "v10"), ("v9", "1", "v11"), ("v9", "1", "v12"), ("v10", "1", "v11"), ("v10", "1", "v13"), ("v11", "1", "v14"), ("v13", "2", "v15"), ("v14", "1", "L"), ("v12", "1", "L"), ("v15", "1", "L")],
    "toxic": [e for (a, b), (c, d) in RUNGS for e in ((V[a], "1", V[c]), (V[a], "2", V[d]), (V[b], "2", V[c]), (V[b], "1", V[d]))],
    "molecule": [e for pair, n in BONDS for a, b in [pair.split()] for e in ((a, str(n), b), (b, str(n), a))],
    "simple_self_loop": [("a", "1", "a")],
    "rdf_type_chain": [("v1", "type", "T1"), ("v2", "type", "T1"), ("v3", "type", "T2"), ("v1", "e", "v2"), ("v2", "e", "v3")],
    "rdf_type_cycle": [("v1", "type", "T1"), ("v2", "type", "T2"), ("v3", "type", "T3"), ("v1", "e", "v2"), ("v2", "e", "v3"), ("v3", "e", "v1")],
}
#: K, blocks touching a data edge, blocks per level, data edges as predicate[start,end].
KNOWN = {
    "simple_edge": (1, 3, [1, 2], "1[1,1] 1[2,2]"),
    "simple_small_cycle": (1, 2, [1, 2], "1[1,1] 1[2,2]"),
    "simple_chain": (8, 17, [1, 2, 3, 4, 5, 6, 7, 8, 9], "1[1,1] 1[2,2] 1[2,9] 1[3,3] 1[3,9] 1[4,4] 1[4,9] 1[5,5] 1[5,9] 1[6,6] 1[6,9] 1[7,7] 1[7,9] 1[8,8] 1[8,9] 1[9,9]"),
    "simple_chain_fork": (8, 17, [1, 2, 3, 4, 5, 6, 7, 8, 9], "1[1,1] 1[2,2] 1[2,9] 1[3,3] 1[3,9] 1[4,4] 1[4,9] 1[5,5] 1[5,9] 1[6,6] 1[6,9] 1[7,7] 1[7,9] 1[8,8] 1[8,9] 1[9,9]"),
    "simple_cycle": (1, 3, [1, 2], "1[1,1] 1[2,2] 1[2,2]"),
    "simple_cycles": (5, 11, [1, 2, 3, 4, 5, 6], "1[1,1] 1[2,2] 1[2,2] 1[2,6] 1[3,3] 1[3,3] 1[3,6] 1[4,4] 1[4,4] 1[4,6] 1[5,5] 1[5,5] 1[5,6] 1[5,6] 1[6,6] 1[6,6]"),
    "simple_dag": (5, 11, [1, 2, 3, 4, 5, 6], "1[1,1] 1[2,2] 1[2,6] 1[3,3] 1[3,6] 1[4,4] 1[4,6] 1[5,5] 1[5,6] 1[6,6]"),
    "heterogeneous_cycle": (1, 4, [1, 3], "1[1,1] 1[2,2] 2[1,1] 2[2,2] 2[2,2]"),
    "heterogeneous_hubs": (1, 4, [1, 3], "1[1,1] 1[1,1] 1[2,2] 1[2,2] 2[1,1] 2[2,2] 3[1,1] 3[2,2]"),
    "multi_block_tree": (2, 7, [1, 4, 5], "1[1,1] 1[2,3] 1[2,3] 2[1,1] 2[2,3] 3[1,1] 3[2,3]"),
    "multi_block": (3, 14, [1, 3, 5, 10], "1[1,1] 1[2,2] 1[2,2] 1[2,3] 1[2,4] 1[3,3] 1[3,3] 1[3,3] 1[3,4] 1[3,4] 1[3,4] 1[4,4] 1[4,4] 1[4,4] 1[4,4] 2[1,1] 2[2,2] 2[3,3] 2[3,4] 2[3,4] 2[4,4]"),
    "toxic": (4, 9, [1, 2, 3, 4, 5], "1[1,1] 1[2,2] 1[2,5] 1[3,3] 1[3,5] 1[4,4] 1[4,5] 1[5,5] 2[1,1] 2[2,2] 2[2,5] 2[3,3] 2[3,5] 2[4,4] 2[4,5] 2[5,5]"),
    "molecule": (3, 9, [1, 4, 5, 6], "1[1,1] 1[1,1] 1[1,1] 1[2,2] 1[2,2] 1[2,2] 1[2,4] 1[2,4] 1[2,4] 1[3,3] 1[3,3] 1[3,3] 1[3,4] 1[3,4] 1[4,4] 1[4,4] 1[4,4] 2[1,1] 2[1,1] 2[2,4] 2[2,4] 3[1,1] 3[2,4]"),
    "simple_self_loop": (1, 2, [1, 2], "1[1,1] 1[2,2]"),
    "rdf_type_chain": (1, 5, [3, 4], "e[1,1] e[1,2] e[2,2] type[1,2] type[1,2] type[1,2]"),
    "rdf_type_cycle": (0, 4, [4], "e[1,1] e[1,1] e[1,1] type[1,1] type[1,1] type[1,1]"),
}
ISOLATED = {"simple_small_cycle", "simple_self_loop"}


def run(spark, triples, alone=(), typed=False, **options):
    e = spark.createDataFrame(triples, "s string, p string, o string")
    v = nodes(e).union(spark.createDataFrame([(x,) for x in alone], "node string")).distinct()
    types = e.where("p = 'type'").selectExpr("s as node", "o as type")
    return refinement(e, typed_start(v, types) if typed else universal_start(v), **options)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", GRAPHS)
def test_known_summary(spark, name):
    k, touched, sizes, edges = KNOWN[name]
    r = run(spark, GRAPHS[name], ["alone"] if name in ISOLATED else [], name.startswith("rdf_type"))
    rows = summary.data_edges(r).collect()
    assert (r.k, r.sizes, r.fixed) == (k, sizes, True)
    assert sorted(f"{x.p}[{x.edge_start},{x.edge_end}]" for x in rows) == sorted(edges.split())
    assert len({(x.s_rep, x.s_start) for x in rows} | {(x.o_rep, x.o_start) for x in rows}) == touched
    assert stats.is_consistent(r).first()["consistent"]


def by_definition(triples, v, typed, min_support=1):
    """Levels as sets of node sets, from the definition."""
    e = set(triples)
    block = {x: frozenset(o for s, p, o in e if s == x and p == "type") if typed else 0 for x in v}
    levels = []
    while True:
        own = {x: frozenset(y for y in v if block[y] == block[x]) for x in v}
        if levels and own == levels[-1]:
            return levels
        levels.append(own)
        block = {x: (own[x], frozenset((p, own[o]) for s, p, o in e if s == x) if len(own[x]) > min_support else None) for x in v}


@pytest.mark.parametrize("seed,typed,support", [(1, False, 1), (2, True, 1), (3, True, 3)])
def test_random_graph(spark, seed, typed, support):
    r = random.Random(seed)
    v = [f"n{i}" for i in range(24)]
    triples = [(r.choice(v), r.choice("ab"), r.choice(v)) for _ in range(34)] + [(x, "type", r.choice(["T", "U"])) for x in v[:9]]
    triples += triples[:3]
    every = sorted({x for s, _, o in triples for x in (s, o)})
    levels = by_definition(triples, every, typed, support)
    got = run(spark, triples, typed=typed, min_support=support)
    last = len(levels) - 1
    assert (got.k, got.sizes) == (last, [len(set(x.values())) for x in levels])
    assert {x.node: x.block for x in got.final.collect()} == {x: min(levels[-1][x]) for x in every}
    exact = run(spark, triples, typed=typed, min_support=support, exact=True)
    assert sorted(map(tuple, exact.final.collect())) == sorted(map(tuple, got.final.collect()))
    life: dict = {}
    for k, level in enumerate(levels):
        for b in set(level.values()):
            a, _ = life.get((min(b), b), (k, k))
            life[min(b), b] = (a, k)
    assert {(x.rep, x.start_level, x.end_level, x.size) for x in summary.blocks(got).collect()} == {(m, a, z, len(b)) for (m, b), (a, z) in life.items()}
    copies = {(levels[min(k + 1, last)][s], p, levels[k][o], k + 1) for k in range(last + 1) for s, p, o in triples}
    spans: dict = {}
    for s, p, o, k in copies:
        a, z = spans.get((s, p, o), (k, k))
        spans[s, p, o] = (min(a, k), max(z, k))
    want = {(min(s), life[min(s), s][0], p, min(o), life[min(o), o][0], a, z) for (s, p, o), (a, z) in spans.items()}
    rows = summary.data_edges(got).collect()
    assert Counter(map(tuple, rows)) == Counter(want)
    counts = {x.k: (x.condensed, x.uncondensed) for x in stats.data_edge_counts(got).collect()}
    assert counts == {k: (sum(a <= k for a, _ in spans.values()), sum(c[3] <= k for c in copies)) for k in range(last + 2)}
    for k in range(last + 1):
        assert {tuple(x) for x in summary.quotient(got, k).collect()} == {(min(levels[k][s]), p, min(levels[k][o])) for s, p, o in triples}
        assert {tuple(x) for x in summary.contains(got, k).collect()} == {(min(levels[k][x]), x) for x in every}
    assert {(x.k, x.n_edges) for x in stats.quotient_edge_counts(got).collect()} == {(k, len({(levels[k][s], p, levels[k][o]) for s, p, o in triples})) for k in range(last + 1)}


def test_deep_chain(spark):
    """Past the first levels only blocks with an edge into a changed block are looked at; levels are those of the definition."""
    triples = path(*[f"c{i:02d}" for i in range(14)]) + [(f"d{i}", "1", "c13") for i in range(6)] + [(f"x{i}", "2", f"x{i + 1}") for i in range(4)]
    every = sorted({x for s, _, o in triples for x in (s, o)})
    levels = by_definition(triples, every, False)
    got = run(spark, triples)
    assert got.k == len(levels) - 1 and got.sizes == [len(set(x.values())) for x in levels]
    assert {x.node: x.block for x in got.final.collect()} == {x: min(levels[-1][x]) for x in every}
    third = run(spark, triples, max_k=3)
    assert {x.node: x.block for x in third.final.collect()} == {x: min(levels[3][x]) for x in every} and not third.fixed


def test_level_limit(spark):
    r = run(spark, GRAPHS["simple_chain"], max_k=3)
    assert (r.k, r.fixed, r.sizes) == (3, False, [1, 2, 3, 4])
    assert max(x.edge_end for x in summary.data_edges(r).collect()) == 3
    assert run(spark, GRAPHS["simple_edge"], max_k=1).fixed


def test_one_node(spark):
    r = run(spark, [("a", "1", "a")])
    assert (r.k, r.fixed) == (0, True)
    assert [tuple(x) for x in summary.data_edges(r).collect()] == [("a", 0, "1", "a", 0, 1, 1)]
