"""A summary as lines of N-Triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import block_iri, member_digest, percent_encoded

#: Prefix of all names that serialization makes; a parameter everywhere.
NAMESPACE = "http://example.org/summary#"


def block_names(members: DataFrame, how: str = "digest", entities: DataFrame | None = None) -> DataFrame:
    """``(rep, start_level, iri)``; names by ids, by member IRIs, or by a hash or digest of those.

    ``digest`` is the one for large graphs: sums of 128 bits of each member's MD5 and
    their number, combined before the shuffle.  The others gather all members of a block
    in one row: ``id_set`` and ``iri_set`` list them, ``hash`` hashes the sorted list, for
    exchange with tools that name blocks so.
    """
    rows = members
    if how != "id_set":
        rows = members.join(entities.select(F.col("id").alias("node"), "iri"), "node") if entities is not None else members.withColumn("iri", F.col("node").cast("string"))
    if how == "digest":
        sums = rows.groupBy("rep", "start_level").agg(*[F.sum(member_digest(F.col("iri"), i)).alias(f"d{i}") for i in range(4)], F.count("*").alias("n"))
        return sums.select("rep", "start_level", F.concat(F.lit("digest_block-"), F.concat_ws("-", "d0", "d1", "d2", "d3", "n")).alias("iri"))
    value = F.col("node") if how == "id_set" else F.col("iri")
    named = rows.groupBy("rep", "start_level").agg(block_iri(F.collect_list(value), how).alias("iri"))
    return named if how == "hash" else named.withColumn("iri", percent_encoded(F.col("iri")))


def _line(s: Column, p: Column, o: Column) -> Column:
    return F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" ."))


def _iri(c: Column, ns: str = "") -> Column:
    return F.concat(F.lit("<" + ns), c, F.lit(">"))


def _term(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def sizes_lines(blocks: DataFrame, names: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    return blocks.join(names, ["rep", "start_level"]).select(_line(_iri(F.col("iri"), ns), F.lit(f"<{ns}size>"), F.concat(F.lit('"'), F.col("size").cast("string"), F.lit('"'))).alias("value"))


def contains_lines(members: DataFrame, names: DataFrame, entities: DataFrame | None = None, ns: str = NAMESPACE) -> DataFrame:
    own = members.join(names, ["rep", "start_level"]).select("node", F.col("iri").alias("block_iri"))
    own = own.join(entities.select(F.col("id").alias("node"), "iri"), "node") if entities is not None else own.withColumn("iri", F.col("node").cast("string"))
    return own.select(_line(_iri(F.col("block_iri"), ns), F.lit(f"<{ns}contains>"), _term(F.col("iri"))).alias("value"))


def refines_lines(refines: DataFrame, names: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    child = names.select(F.col("rep").alias("child_rep"), F.col("start_level").alias("child_start"), F.col("iri").alias("c"))
    parent = names.select(F.col("rep").alias("parent_rep"), F.col("start_level").alias("parent_start"), F.col("iri").alias("b"))
    return refines.join(child, ["child_rep", "child_start"]).join(parent, ["parent_rep", "parent_start"]).select(_line(_iri(F.col("c"), ns), F.lit(f"<{ns}refines>"), _iri(F.col("b"), ns)).alias("value"))


def data_lines(edges: DataFrame, names: DataFrame, predicates: DataFrame | None = None, ns: str = NAMESPACE) -> DataFrame:
    s = names.select(F.col("rep").alias("s_rep"), F.col("start_level").alias("s_start"), F.col("iri").alias("si"))
    o = names.select(F.col("rep").alias("o_rep"), F.col("start_level").alias("o_start"), F.col("iri").alias("oi"))
    own = edges.join(s, ["s_rep", "s_start"]).join(o, ["o_rep", "o_start"])
    own = own.join(predicates.select(F.col("id").alias("p"), F.col("iri").alias("pi")), "p") if predicates is not None else own.withColumn("pi", F.col("p").cast("string"))
    return own.select(_line(_iri(F.col("si"), ns), _iri(F.col("pi")), _iri(F.col("oi"), ns)).alias("value")).distinct()


def intervals_lines(blocks: DataFrame, names: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.lit("startLevel").alias("name"), F.col("start_level").alias("level")), F.struct(F.lit("endLevel").alias("name"), F.col("end_level").alias("level"))))
    own = blocks.join(names, ["rep", "start_level"]).select("iri", ends.alias("x"))
    return own.select(_line(_iri(F.col("iri"), ns), F.concat(F.lit(f"<{ns}"), F.col("x.name"), F.lit(">")), F.concat(F.lit('"'), F.col("x.level").cast("string"), F.lit('"'))).alias("value"))


def merged_lines(parts: dict[str, DataFrame], letters: str) -> DataFrame:
    """The chosen parts in one table: c(ontains), d(ata), i(ntervals), r(efines), s(izes); two at least."""
    if len(set(letters)) < 2 or not set(letters) <= set("cdirs"):
        raise ValueError("choose two or more of c, d, i, r, s")
    return reduce(DataFrame.unionByName, [parts[x].select("value") for x in dict.fromkeys(letters)])
