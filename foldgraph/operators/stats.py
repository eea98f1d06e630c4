"""Counts by level, histograms and the density grid of a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .bisimulation import Refinement
from .summary import blocks, data_edges, final_edges, history, refines


def _so_far() -> WindowSpec:
    """For running totals over levels; one row per level goes through it."""
    return Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _levels(r: Refinement, last: int | None = None) -> DataFrame:
    return r.edges.sparkSession.range((r.k if last is None else last) + 1).select(F.col("id").cast("int").alias("k"))


def level_statistics(r: Refinement) -> DataFrame:
    """``(k, block_count, singleton_count, accumulated_block_count)``, from births and deaths."""
    b = blocks(r)
    one, single = F.lit(1), F.when(F.col("is_singleton"), 1).otherwise(0)
    events = b.select(F.col("start_level").alias("k"), one.alias("n"), single.alias("m"), one.alias("born")).union(b.select((F.col("end_level") + 1).alias("k"), -one, -single, F.lit(0)))
    sums = events.groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("born").alias("born"))
    out = _levels(r).join(sums, "k", "left").fillna(0)
    return out.select("k", F.sum("n").over(_so_far()).alias("block_count"), F.sum("m").over(_so_far()).alias("singleton_count"), F.sum("born").over(_so_far()).alias("accumulated_block_count"))


def block_size_histogram(r: Refinement) -> DataFrame:
    """``(k, size, n_blocks)``; lifetimes are grouped before they are spread over levels."""
    alike = blocks(r).groupBy("start_level", "end_level", "size").agg(F.count("*").alias("n"))
    return alike.select(F.explode(F.sequence("start_level", "end_level")).alias("k"), "size", "n").groupBy("k", "size").agg(F.sum("n").alias("n_blocks"))


def accumulated_size_histogram(r: Refinement) -> DataFrame:
    """``(k, size, n_blocks)`` of all blocks born up to level ``k``."""
    alike = blocks(r).groupBy("start_level", "size").agg(F.count("*").alias("n"))
    return alike.select(F.explode(F.sequence("start_level", F.lit(r.k))).alias("k"), "size", "n").groupBy("k", "size").agg(F.sum("n").alias("n_blocks"))


def split_counts(r: Refinement) -> DataFrame:
    """``(k, n_split_blocks, n_split_vertices, n_disappeared)`` of the blocks of level k that are split into level k + 1."""
    b = blocks(r).select(F.col("rep").alias("parent"), F.col("start_level").alias("parent_start"), F.col("size").alias("parent_size"))
    by = r.born.where("parent is not null").groupBy("parent", "parent_start").agg((F.min("start") - 1).alias("k"), F.max("size").alias("largest"))
    return by.join(b, ["parent", "parent_start"]).groupBy("k").agg(F.count("*").alias("n_split_blocks"), F.sum("parent_size").alias("n_split_vertices"), F.count_if(F.col("largest") == 1).alias("n_disappeared"))


def new_block_statistics(r: Refinement) -> DataFrame:
    """``(k, n_new_blocks, n_new_vertices, n_new_singletons)`` of the blocks born at level k."""
    return r.born.groupBy(F.col("start").alias("k")).agg(F.count("*").alias("n_new_blocks"), F.sum("size").alias("n_new_vertices"), F.count_if(F.col("size") == 1).alias("n_new_singletons"))


def edges_per_level(e: DataFrame) -> DataFrame:
    """``(k, n_edges)`` of data edges that exist at level k."""
    alike = e.groupBy("edge_start", "edge_end").agg(F.count("*").alias("n"))
    return alike.select(F.explode(F.sequence("edge_start", "edge_end")).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n_edges"))


def summary_degrees(e: DataFrame) -> DataFrame:
    """``(k, direction, degree, n_blocks)``: blocks by their number of data edges at level ``k``; blocks without one don't count."""
    spread = e.select("s_rep", "s_start", "o_rep", "o_start", F.explode(F.sequence("edge_start", "edge_end")).alias("k"))
    out = None
    for direction, rep, start in (("out", "s_rep", "s_start"), ("in", "o_rep", "o_start")):
        part = spread.groupBy("k", rep, start).agg(F.count("*").alias("degree")).groupBy("k", "degree").agg(F.count("*").alias("n_blocks"))
        part = part.select("k", F.lit(direction).alias("direction"), "degree", "n_blocks")
        out = part if out is None else out.union(part)
    return out


def data_edge_counts(r: Refinement, e: DataFrame | None = None) -> DataFrame:
    """``(k, condensed, uncondensed)`` up to level K, and K + 1 at a fixed point.

    Uncondensed counts every copy of an edge between layers k and k - 1, of all layers so far.
    """
    e = e or data_edges(r)
    last = r.k + 1 if r.fixed else r.k
    alike = e.groupBy("edge_start", "edge_end").agg(F.count("*").alias("n"))
    spread = alike.select("n", "edge_start", "edge_end", F.explode(F.sequence("edge_start", F.greatest("edge_start", F.lit(last)))).alias("k")).where(F.col("k") <= last)
    copies = F.least(F.col("k"), F.col("edge_end")) - F.col("edge_start") + 1
    sums = spread.groupBy("k").agg(F.sum("n").alias("condensed"), F.sum(F.col("n") * copies).alias("uncondensed"))
    return _levels(r, last).join(sums, "k", "left").fillna(0)


def quotient_edge_counts(r: Refinement, hist: DataFrame | None = None, finals: DataFrame | None = None) -> DataFrame:
    """``(k, n_edges)`` of the quotient graph of each level, all levels in one pass over final edges."""
    hist, e = hist or history(r), finals or final_edges(r)
    s = hist.select(F.col("final").alias("s"), F.col("rep").alias("sb"), F.col("start_level").alias("s1"), F.col("end_level").alias("s2"))
    o = hist.select(F.col("final").alias("o"), F.col("rep").alias("ob"), F.col("start_level").alias("o1"), F.col("end_level").alias("o2"))
    both = e.join(s, "s").join(o, "o").select("sb", "p", "ob", F.greatest("s1", "o1").alias("a"), F.least("s2", "o2").alias("z")).where("a <= z").distinct()
    # (block, p, block) with its run of levels; a pair of reps can have several disjoint runs
    alike = both.groupBy("a", "z").agg(F.count("*").alias("n"))
    return alike.select(F.explode(F.sequence("a", "z")).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n_edges"))


def full_counts(r: Refinement, hist: DataFrame | None = None, finals: DataFrame | None = None, e: DataFrame | None = None) -> DataFrame:
    """``(k, metric, value)``: vertices, singletons, refines and data edges; condensed, uncondensed and quotient."""
    level = level_statistics(r)
    born = refines(r).groupBy(F.col("child_start").alias("k")).agg(F.count("*").alias("n"))
    condensed = _levels(r).join(born, "k", "left").fillna(0).select("k", F.sum("n").over(_so_far()).alias("v"))
    running = level.select(
        "k", F.sum("block_count").over(_so_far()).alias("vertices"), F.sum("singleton_count").over(_so_far()).alias("singletons"),
        (F.sum("block_count").over(_so_far()) - F.first("block_count").over(_so_far())).alias("refines"))
    edges, q = data_edge_counts(r, e), quotient_edge_counts(r, hist, finals)
    named = [
        (level, "accumulated_block_count", "vertices_condensed"), (running, "vertices", "vertices_uncondensed"), (level, "block_count", "vertices_quotient"), (level, "singleton_count", "singletons_condensed"),
        (level, "singleton_count", "singletons_quotient"), (running, "singletons", "singletons_uncondensed"), (condensed, "v", "refines_condensed"), (running, "refines", "refines_uncondensed"),
        (edges, "condensed", "data_edges_condensed"), (edges, "uncondensed", "data_edges_uncondensed"), (q, "n_edges", "data_edges_quotient"),
    ]
    out = None
    for df, column, metric in named:
        x = df.select("k", F.lit(metric).alias("metric"), F.col(column).cast("bigint").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def _cdf(x: Column, centre: Column, scale: float, kernel: str) -> Column:
    d = x - centre
    inner = F.lit(0.5) + F.lit(3 / (4 * scale)) * d - F.lit(1 / (4 * scale**3)) * d * d * d if kernel == "epanechnikov" else (d + scale) / (2 * scale)
    return F.when(d <= -scale, 0.0).when(d >= scale, 1.0).otherwise(inner)


def kde_grid(histogram: DataFrame, resolution: int = 16, scale: float = 0.1, epsilon: float = 0.1, kernel: str = "epanechnikov", weight: str = "block_based") -> DataFrame:
    """``(i, j, level, size, density)``: kernel density of block sizes over levels, by exact integrals.

    ``histogram``: ``(k, size, n_blocks)``.  Levels and sizes are divided by their
    maxima.  Cell ``i`` samples the level axis, cell ``j`` integrates the size axis
    between neighbours of ``resolution + 1`` points; the kernel is uniform in the
    level and ``epanechnikov`` or ``uniform`` in the size.  A row of the histogram
    only meets the cells within its kernel's support.
    """
    if kernel not in ("epanechnikov", "uniform") or weight not in ("block_based", "vertex_based"):
        raise ValueError("unknown kernel or weight")
    top = histogram.agg(F.greatest(F.max("k"), F.lit(1)).alias("mk"), F.max("size").alias("ms"))
    at = histogram.crossJoin(F.broadcast(top)).select((F.col("k") / F.col("mk")).alias("lk"), (F.col("size") / F.col("ms")).alias("ls"), F.col("n_blocks").cast("double").alias("n"), F.col("size").cast("double").alias("sz"))
    at = at.withColumn("w", F.col("n") * F.col("sz") if weight == "vertex_based" else F.col("n"))
    n = F.lit(resolution)
    x, y = F.col("i") / F.lit(max(1, resolution - 1)), F.col("j") / n
    span = lambda c, half, steps: F.sequence(F.greatest(F.lit(0), F.floor((c - half) * steps) - 1).cast("int"), F.least(F.lit(resolution - 1), F.ceil((c + half) * steps) + 1).cast("int"))
    cells = at.withColumn("i", F.explode(span(F.col("lk"), epsilon, resolution - 1))).where((x > F.col("lk") - epsilon) & (x < F.col("lk") + epsilon))
    cells = cells.withColumn("j", F.explode(span(F.col("ls"), scale, resolution)))
    mass = (_cdf((F.col("j") + 1) / n, F.col("ls"), scale, kernel) - _cdf(y, F.col("ls"), scale, kernel)) / (2 * epsilon)
    return cells.groupBy("i", "j").agg(F.sum(F.col("w") * mass).alias("density")).where("density > 0").select("i", "j", x.alias("level"), y.alias("size"), "density")


def is_consistent(r: Refinement) -> DataFrame:
    """One row: ``|blocks| - |P_0| = |refines edges|``."""
    b = blocks(r).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("start_level") == 0).alias("n_initial"))
    return b.crossJoin(refines(r).agg(F.count("*").alias("n_refines"))).withColumn("consistent", F.expr("n_blocks - n_initial = n_refines"))


