"""Operators on edge tables ``(s, p, o)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import LITERAL_NODE, RDF_TYPE, TYPE_NODE


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("s").alias("node")).union(edges.select(F.col("o").alias("node"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two graphs as sets of triples."""
    return a.select("s", "p", "o").union(b.select("s", "p", "o")).distinct()


def predecessors(edges: DataFrame) -> DataFrame:
    """``(o, s)``: the distinct sources of each target."""
    return edges.select("o", "s").distinct()


def degree_histogram(edges: DataFrame, all_nodes: DataFrame, end: str = "s") -> DataFrame:
    """``(degree, n_nodes)`` of out-degrees (``end='s'``) or in-degrees (``'o'``); degree 0 counts."""
    degree = edges.groupBy(F.col(end).alias("node")).count()
    joined = all_nodes.select("node").join(degree, "node", "left").select(F.coalesce("count", F.lit(0)).cast("bigint").alias("degree"))
    return joined.groupBy("degree").agg(F.count("*").alias("n_nodes"))


def relation_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("p").agg(F.count("*").alias("n_edges"), F.min("s").alias("min_s"), F.max("s").alias("max_s"), F.min("o").alias("min_o"), F.max("o").alias("max_o"))


def dangling(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node; a consistent graph has none."""
    known = all_nodes.select("node")
    return edges.join(known.withColumnRenamed("node", "s"), "s", "left_anti").union(edges.join(known.withColumnRenamed("node", "o"), "o", "left_anti").select("s", "p", "o")).select("s", "p", "o").distinct()


def with_binary_features(edges: DataFrame, features: DataFrame, base: int, sink: int) -> DataFrame:
    """Adds an edge ``(node, base + 2 i + bit, sink)`` for bit ``i`` of each node.

    ``features``: ``(node, bits)`` with an array of 0 and 1.
    """
    bits = features.select("node", F.posexplode("bits").alias("i", "bit"))
    added = bits.select(F.col("node").alias("s"), (F.lit(base).cast("bigint") + 2 * F.col("i") + F.col("bit")).alias("p"), F.lit(sink).cast("bigint").alias("o"))
    return merged(edges, added)


def metadata(entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """``(kind, iri, id, total)``: how many entities and predicates there are, and the ids of the special ones."""
    special = {"entity": (entities, [LITERAL_NODE, TYPE_NODE]), "predicate": (predicates, [RDF_TYPE])}
    out = None
    for kind, (dictionary, names) in special.items():
        row = dictionary.agg(F.count("*").alias("total"), *[F.max(F.when(F.col("iri") == x, F.col("id"))).alias(f"i{k}") for k, x in enumerate(names)])
        part = row.select(F.lit(kind).alias("kind"), "total", F.explode(F.array(*[F.struct(F.lit(x).alias("iri"), F.col(f"i{k}").alias("id")) for k, x in enumerate(names)])).alias("x"))
        part = part.select("kind", "x.iri", "x.id", "total")
        out = part if out is None else out.union(part)
    return out


def counts(edges: DataFrame) -> DataFrame:
    """One row: vertices and edges."""
    return edges.agg(F.count("*").alias("n_edges")).crossJoin(nodes(edges).agg(F.count("*").alias("n_vertices")))
