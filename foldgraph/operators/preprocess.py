"""From parsed terms to a graph: flags, dictionaries, encoded edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import LITERAL_NODE, RDF_TYPE, TYPE_NODE, is_list_term
from ..sources.store import cut


def preprocessed(rows: DataFrame, skip_literals: bool = False, skip_rdf_lists: bool = False, types_to_predicates: bool = False) -> DataFrame:
    """``(s, p, o)``: literals become one node; flags drop or rewrite triples.

    ``types_to_predicates`` turns ``(s, rdf:type, t)`` into ``(s, t, one node)``.
    """
    out = rows
    if skip_literals:
        out = out.where(F.col("o_kind") != "literal")
    out = out.select("s", "p", F.when(F.col("o_kind") == "literal", LITERAL_NODE).otherwise(F.col("o")).alias("o"))
    if skip_rdf_lists:
        out = out.where(~(is_list_term(F.col("s")) | is_list_term(F.col("p")) | is_list_term(F.col("o"))))
    if types_to_predicates:
        typed = F.col("p") == RDF_TYPE
        out = out.select("s", F.when(typed, F.col("o")).otherwise(F.col("p")).alias("p"), F.when(typed, TYPE_NODE).otherwise(F.col("o")).alias("o"))
    return out


def numbered_ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with dense numbers ``id`` from 0 in order of ``by``, without one task seeing all rows.

    Rows are range-partitioned; each range is numbered by itself, after the sizes of
    the ranges before it.
    """
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    parts = cut(parts, "ranges")  # the ranges must not change between the two uses
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # one row per range
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return parts.withColumn("n", rank).join(F.broadcast(before), "part").select((F.col("before") + F.col("n") - 1).alias("id"), *rows.columns)


def _numbered(values: DataFrame) -> DataFrame:
    """``(id, iri)``: dense ids in order of the distinct names."""
    return numbered_ranges(values.select("iri").distinct(), ["iri"])


def entity_dictionary(triples: DataFrame) -> DataFrame:
    return _numbered(triples.select(F.col("s").alias("iri")).union(triples.select(F.col("o").alias("iri"))))


def predicate_dictionary(triples: DataFrame) -> DataFrame:
    return _numbered(triples.select(F.col("p").alias("iri")))


def encoded(triples: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """``(s, p, o)`` as ids; each triple once."""
    e, p = entities.select("id", "iri"), predicates.select("id", "iri")
    return (
        triples.distinct()
        .join(p.select(F.col("id").alias("pid"), F.col("iri").alias("p")), "p")
        .join(e.select(F.col("id").alias("sid"), F.col("iri").alias("s")), "s")
        .join(e.select(F.col("id").alias("oid"), F.col("iri").alias("o")), "o")
        .select(F.col("sid").alias("s"), F.col("pid").alias("p"), F.col("oid").alias("o"))
    )
