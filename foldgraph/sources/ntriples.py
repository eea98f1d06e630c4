"""N-Triples, N-Quads and single-graph TriG files as tables of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TRIPLE, kind, stripped


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` for each line; compressed files by their extension."""
    return spark.read.text(path)


def unwrapped(lines: DataFrame, check: bool = True) -> DataFrame:
    """Without the ``<graph> {`` and ``}`` lines around the triples of one named graph.

    With ``check``, a table that hasn't exactly one of each raises when it is read.
    """
    text = F.trim("value")
    opens, closes = text.rlike(r"^<[^>]*>\s*\{$"), text == "}"
    body = lines.where(~(opens | closes))
    if not check:
        return body
    count = lines.agg(F.count_if(opens).alias("a"), F.count_if(closes).alias("b"))
    wrong = F.raise_error(F.lit("a wrapped graph needs one opening and one closing line")).cast("boolean")
    fine = count.select(F.when((F.col("a") == 1) & (F.col("b") == 1), F.lit(True)).otherwise(wrong).alias("fine"))
    return body.crossJoin(F.broadcast(fine)).where("fine").select("value")


def parsed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``(s, p, o, g)`` terms as written, of each line that isn't empty or a comment.

    A line that is no triple or quad raises when it is read; with ``strict=False``
    it comes back with null terms and its text in ``bad``.
    """
    text = F.trim("value")
    rows = lines.where((text != "") & ~text.startswith("#"))
    fine = F.col("value").rlike(TRIPLE)
    part = lambda i: F.when(fine, F.regexp_extract("value", TRIPLE, i))
    out = rows.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.nullif(part(4), F.lit("")).alias("g"), F.when(~fine, F.col("value")).alias("bad"))
    if not strict:
        return out
    wrong = F.raise_error(F.concat(F.lit("not a triple: "), F.col("bad"))).cast("string")
    return out.select(F.when(F.col("bad").isNotNull(), wrong).otherwise(F.col("s")).alias("s"), "p", "o", "g")


def terms(rows: DataFrame) -> DataFrame:
    """``(s, p, o, o_kind)`` with brackets taken off."""
    return rows.select(stripped(F.col("s")).alias("s"), stripped(F.col("p")).alias("p"), stripped(F.col("o")).alias("o"), kind(F.col("o")).alias("o_kind"))


def read_ntriples(spark: SparkSession, path: str, wrapped: bool = False, strict: bool = True) -> DataFrame:
    lines = lines_of(spark, path)
    return terms(parsed(unwrapped(lines) if wrapped else lines, strict).drop("g"))


def read_nquads(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Quads without their graph names."""
    return terms(parsed(lines_of(spark, path), strict).drop("g"))


def quads_to_triples(lines: DataFrame) -> DataFrame:
    """Lines of N-Triples from lines of N-Quads."""
    return parsed(lines).select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
