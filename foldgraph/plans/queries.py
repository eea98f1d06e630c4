"""Registered queries of the summary engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import singleton_id
from ..operators import graphs, preprocess, rdf, stats, summary
from ..operators.bisimulation import Refinement, dirty_blocks, refinement, typed_start, universal_start
from ..sources.ntriples import parsed, terms
from ..sources.store import cut
from . import driver_graphs as g

_done: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable):
    """A refinement that several queries of one session share (its tables are in the shared folder)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _done:
        _done[key] = make()
    return _done[key]


def star_refinement(spark: SparkSession, sf_dir: str, **options) -> Refinement:
    x = g.star(spark, sf_dir)
    return refinement(x.edges, typed_start(x.nodes, x.types), **options)


def _star(spark: SparkSession, sf_dir: str) -> Refinement:
    return _once(spark, sf_dir, "star", lambda: star_refinement(spark, sf_dir))


def _untyped(spark: SparkSession, sf_dir: str) -> Refinement:
    def make() -> Refinement:
        x = g.star(spark, sf_dir)
        return refinement(x.edges, universal_start(x.nodes))

    return _once(spark, sf_dir, "untyped", make)


def _limited(spark: SparkSession, sf_dir: str) -> Refinement:
    return _once(spark, sf_dir, "limited", lambda: star_refinement(spark, sf_dir, max_k=1))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "history", lambda: cut(summary.history(_star(spark, sf_dir)), "history"))


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "data", lambda: cut(summary.data_edges(_star(spark, sf_dir), _history(spark, sf_dir)), "data-edges"))


def _level(k: int | None, **options) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = star_refinement(spark, sf_dir, max_k=k, **options).final if k or options else _star(spark, sf_dir).final
        return p.select("node", "block", F.col("size").cast("bigint").alias("size"))

    return query


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(parsed(g.rdf_lines(spark, sf_dir)))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.preprocessed(_triples(spark, sf_dir)).distinct()


def _with(**flags) -> Callable:
    return lambda spark, d: preprocess.preprocessed(_triples(spark, d), **flags).distinct()


def triples_parsed(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d)


def edges_encoded(spark: SparkSession, d: str) -> DataFrame:
    t = _plain(spark, d)
    return preprocess.encoded(t, preprocess.entity_dictionary(t), preprocess.predicate_dictionary(t))


def binary_features(spark: SparkSession, d: str) -> DataFrame:
    c = g.read(spark, d, "customer")
    bits = c.select((F.lit(g.CUSTOMER * g.KIND) + F.col("c_custkey")).alias("node"), F.array((F.col("c_acctbal") > 0).cast("int"), (F.col("c_nationkey") % 2).cast("int")).alias("bits"))
    return graphs.with_binary_features(g.star(spark, d).edges, bits, 100, 0)


def feature_broadcast(spark: SparkSession, d: str) -> DataFrame:
    r = _star(spark, d)
    return summary.broadcast_features(r.final, r.final.groupBy("block").agg(F.count("*").alias("value")))


def p0_universal(spark: SparkSession, d: str) -> DataFrame:
    return universal_start(g.star(spark, d).nodes).select("node", "block", F.col("size").cast("bigint").alias("size"))


def p0_typed(spark: SparkSession, d: str) -> DataFrame:
    x = g.star(spark, d)
    return typed_start(x.nodes, x.types).select("node", "block", F.col("size").cast("bigint").alias("size"))


def _chain(k: int) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        x = g.chain(spark, d)
        return refinement(x.edges, typed_start(x.nodes, x.types), max_k=k).final.select("node", "block", F.col("size").cast("bigint").alias("size"))

    return query


def plus_k2_partition(spark: SparkSession, d: str) -> DataFrame:
    x = g.star(spark, d, parts=True)
    return refinement(x.edges, typed_start(x.nodes, x.types), max_k=2).final.select("node", "block", F.col("size").cast("bigint").alias("size"))


def _names(spark: SparkSession, d: str, how: str) -> DataFrame:
    return rdf.block_names(summary.members(_star(spark, d), _history(spark, d)), how)


def _predicates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).cast("bigint").alias("id"), F.lit(v).alias("iri")) for k, v in g.PREDICATES.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return summary.members(_star(spark, d), _history(spark, d))


def _rdf(part: str) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        r, names = _star(spark, d), _names(spark, d, "digest")
        if part == "s":
            return rdf.sizes_lines(summary.blocks(r), names)
        if part == "c":
            return rdf.contains_lines(_members(spark, d), names)
        if part == "r":
            return rdf.refines_lines(summary.refines(r), names)
        if part == "i":
            return rdf.intervals_lines(summary.blocks(r), names)
        return rdf.data_lines(_data(spark, d), names, _predicates(spark))

    return query


def rdf_merged(spark: SparkSession, d: str) -> DataFrame:
    return rdf.merged_lines({x: _rdf(x)(spark, d) for x in "sr"}, "sr")


def _kde(**options) -> Callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = stats.kde_grid(stats.block_size_histogram(_star(spark, d)), **options)
        return out.select("i", "j", F.round("density", 6).alias("density")).where("density > 0")

    return query


def graph_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = _plain(spark, d)
    return graphs.metadata(preprocess.entity_dictionary(t), preprocess.predicate_dictionary(t))


def summary_differences(spark: SparkSession, d: str) -> DataFrame:
    return summary.differences(_star(spark, d), _limited(spark, d))


def dirty_blocks_k1(spark: SparkSession, d: str) -> DataFrame:
    r = _limited(spark, d)
    return dirty_blocks(r.edges, r.final, 1)


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphs.counts(g.star(spark, d).edges)


def members_of_refines(spark: SparkSession, d: str) -> DataFrame:
    """Refines edges with the sizes of both ends, for inspection."""
    r = _star(spark, d)
    b = summary.blocks(r)
    child = b.select(F.col("rep").alias("child_rep"), F.col("start_level").alias("child_start"), F.col("size").alias("child_size"))
    parent = b.select(F.col("rep").alias("parent_rep"), F.col("start_level").alias("parent_start"), F.col("size").alias("parent_size"))
    return summary.refines(r).join(child, ["child_rep", "child_start"]).join(parent, ["parent_rep", "parent_start"]).select("child_rep", "child_start", "child_size", "parent_rep", "parent_start", "parent_size")


def quotient_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return summary.positive_ids(summary.quotient(_star(spark, d)))


def singleton_ids(spark: SparkSession, d: str) -> DataFrame:
    b = summary.blocks(_star(spark, d)).where("is_singleton")
    return b.select("rep", "start_level", singleton_id(F.col("rep")).alias("singleton_id"))


_E = lambda f: lambda spark, d: f(g.star(spark, d))
_R = lambda f: lambda spark, d: f(_star(spark, d))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "triples_parsed": triples_parsed,
    "triples_plain": _plain,
    "triples_skip_literals": _with(skip_literals=True),
    "triples_skip_rdf_lists": _with(skip_rdf_lists=True),
    "triples_types_to_predicates": _with(types_to_predicates=True),
    "entity_dictionary": lambda s, d: preprocess.entity_dictionary(_plain(s, d)),
    "predicate_dictionary": lambda s, d: preprocess.predicate_dictionary(_plain(s, d)),
    "edges_encoded": edges_encoded,
    "triples_star": _E(lambda x: x.edges),
    "graph_counts": graph_counts,
    "relation_distribution": _E(lambda x: graphs.relation_distribution(x.edges)),
    "out_degree_histogram": _E(lambda x: graphs.degree_histogram(x.edges, x.nodes, "s")),
    "in_degree_histogram": _E(lambda x: graphs.degree_histogram(x.edges, x.nodes, "o")),
    "reverse_edges": _E(lambda x: graphs.reversed_edges(x.edges)),
    "graph_merge": lambda s, d: graphs.merged(g.star(s, d).edges, g.chain(s, d).edges),
    "predecessors": _E(lambda x: graphs.predecessors(x.edges)),
    "consistency_check": lambda s, d: graphs.dangling(g.star(s, d).edges, g.star(s, d).nodes.where(F.col("node") % 7 != 0)),
    "binary_features": binary_features,
    "p0_universal": p0_universal,
    "p0_typed": p0_typed,
    "k1_partition": _level(1),
    "k2_partition": _level(2),
    "k2_partition_exact": _level(2, exact=True),
    "min_support_partition": _level(3, min_support=40),
    "fixpoint_partition": _level(None),
    "plus_k2_partition": plus_k2_partition,
    "deep_chain_k5": _chain(5),
    "feature_broadcast": feature_broadcast,
    "level_statistics": _R(stats.level_statistics),
    "block_size_histogram": _R(stats.block_size_histogram),
    "accumulated_size_histogram": _R(stats.accumulated_size_histogram),
    "block_intervals": _R(summary.blocks),
    "living_blocks_k1": _R(lambda r: summary.living(summary.blocks(r), 1)),
    "singleton_ids": singleton_ids,
    "refines_edges": _R(summary.refines),
    "singleton_refines": _R(lambda r: summary.refines(r, True)),
    "refines_with_sizes": members_of_refines,
    "split_counts": _R(stats.split_counts),
    "new_block_statistics": _R(stats.new_block_statistics),
    "data_edges_condensed": _data,
    "edges_per_level": lambda s, d: stats.edges_per_level(_data(s, d)),
    "data_edge_counts": lambda s, d: stats.data_edge_counts(_star(s, d), _data(s, d)),
    "quotient_k1": lambda s, d: summary.quotient(_star(s, d), 1, _history(s, d)),
    "quotient_fixpoint": _R(summary.quotient),
    "quotient_dense_ids": quotient_dense_ids,
    "quotient_contains_k1": lambda s, d: summary.contains(_star(s, d), 1, _history(s, d)),
    "quotient_edge_counts": lambda s, d: stats.quotient_edge_counts(_star(s, d), _history(s, d)),
    "full_counts": lambda s, d: stats.full_counts(_star(s, d), _history(s, d), e=_data(s, d)),
    "summary_consistency": _R(stats.is_consistent),
    "block_members": _members,
    "block_names_id_set": lambda s, d: _names(s, d, "id_set"),
    "block_names_hash": lambda s, d: _names(s, d, "hash"),
    "rdf_sizes": _rdf("s"),
    "rdf_contains": _rdf("c"),
    "rdf_refines": _rdf("r"),
    "rdf_data": _rdf("d"),
    "rdf_intervals": _rdf("i"),
    "rdf_merged": rdf_merged,
    "kde_grid": _kde(),
    "kde_grid_uniform": _kde(kernel="uniform"),
    "kde_grid_vertices": _kde(weight="vertex_based"),
    "fixpoint_untyped": lambda s, d: _untyped(s, d).final.select("node", "block", F.col("size").cast("bigint").alias("size")),
    "block_intervals_untyped": lambda s, d: summary.blocks(_untyped(s, d)),
    "data_edges_untyped": lambda s, d: summary.data_edges(_untyped(s, d)),
    "data_edges_max_k": lambda s, d: summary.data_edges(_limited(s, d)),
    "quotient_k2": lambda s, d: summary.quotient(_star(s, d), 2, _history(s, d)),
    "block_names_iri_set": lambda s, d: _names(s, d, "iri_set"),
    "block_names_digest": lambda s, d: _names(s, d, "digest"),
    "block_ids": _R(lambda r: summary.block_ids(summary.blocks(r))),
    "summary_degrees": lambda s, d: stats.summary_degrees(_data(s, d)),
    "graph_metadata": graph_metadata,
    "summary_differences": summary_differences,
    "dirty_blocks_k1": dirty_blocks_k1,
}
