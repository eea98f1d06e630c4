"""Connected components of an undirected edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for each node of an edge, ``root`` the smallest of its component.

    Each round is two groupings and two joins over at most as many edges as came
    in; rounds grow with the logarithm of the diameter.  A round's edges are
    written to the shared folder, so neither the plan nor the lineage grows, and
    the driver only gets a count and a checksum.  The groupings are plain ``min``
    (combined before the shuffle) and the joins are on one key with a small side
    per key, so a node with very many edges is split by the adaptive planner.

    No edge, or edges from a node to itself only: an empty table.
    """
    e, path = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        nxt, new_path = written(_small_star(_large_star(e)), "edges")
        remove(e.sparkSession, path)
        e, path = nxt, new_path
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
