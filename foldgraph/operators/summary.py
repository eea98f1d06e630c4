"""The condensed summary of all levels: blocks with lifetimes, refines edges, data edges.

Everything past the refinement itself works on blocks, not nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import clip_end, clip_start
from ..sources.store import cut
from .bisimulation import Refinement


def blocks(r: Refinement) -> DataFrame:
    """``(rep, start_level, end_level, size, is_singleton)``; a block ends where it is split."""
    split = r.born.where("parent is not null").groupBy(F.col("parent").alias("block"), F.col("parent_start").alias("start")).agg(F.min("start").alias("until"))
    ended = r.born.join(split, ["block", "start"], "left")
    return ended.select(F.col("block").alias("rep"), F.col("start").alias("start_level"), F.coalesce(F.col("until") - 1, F.lit(r.k)).alias("end_level"), "size", (F.col("size") == 1).alias("is_singleton"))


def refines(r: Refinement, singletons_only: bool = False) -> DataFrame:
    """``(child_rep, child_start, parent_rep, parent_start)``, one for each block born above level 0."""
    born = r.born.where("parent is not null")
    born = born.where("size = 1") if singletons_only else born
    return born.select(F.col("block").alias("child_rep"), F.col("start").alias("child_start"), F.col("parent").alias("parent_rep"), "parent_start")


def history(r: Refinement) -> DataFrame:
    """``(final, rep, start_level, end_level)``: each final block and all blocks that it came from.

    Climbs the refines edges, all final blocks at once; at most as many steps as a
    block has ancestors.
    """
    own = cut(blocks(r), "blocks")
    up = r.born.where("parent is not null").select(F.col("block").alias("rep"), F.col("start").alias("start_level"), "parent", "parent_start")
    up = cut(up.join(own.select(F.col("rep").alias("parent"), F.col("start_level").alias("parent_start"), F.col("end_level").alias("parent_end")), ["parent", "parent_start"]), "parents")
    # The final partition may still hold what max_k cut off, so final blocks are those that live at k.
    step = own.where(F.col("end_level") == r.k).select(F.col("rep").alias("final"), "rep", "start_level", "end_level")
    found = []
    while True:
        step = cut(step, "history")
        found.append(step)
        step = step.join(up, ["rep", "start_level"]).select("final", F.col("parent").alias("rep"), F.col("parent_start").alias("start_level"), F.col("parent_end").alias("end_level"))
        if len(found) > r.k or not step.head(1):
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def final_edges(r: Refinement) -> DataFrame:
    """``distinct (block of s, p, block of o)`` at the last level."""
    p = r.final
    s, o = p.select(F.col("node").alias("s"), F.col("block").alias("sb")), p.select(F.col("node").alias("o"), F.col("block").alias("ob"))
    return r.edges.join(o, "o").join(s, "s").select(F.col("sb").alias("s"), "p", F.col("ob").alias("o")).distinct()


def data_edges(r: Refinement, hist: DataFrame | None = None, finals: DataFrame | None = None) -> DataFrame:
    """``(s_rep, s_start, p, o_rep, o_start, edge_start, edge_end)``.

    There is an edge where, at some level, a node of the subject's block has an edge
    into the object's block one level below.  As blocks nest, the edges of the last
    level and the histories of their ends say all: one join on final blocks, with
    the overlap of lifetimes as a condition on what meets there.
    """
    hist, e = hist or history(r), finals or final_edges(r)
    s = hist.select(F.col("final").alias("s"), F.col("rep").alias("s_rep"), F.col("start_level").alias("s_start"), F.col("end_level").alias("s_end"))
    o = hist.select(F.col("final").alias("o"), F.col("rep").alias("o_rep"), F.col("start_level").alias("o_start"), F.col("end_level").alias("o_end"))
    last = F.lit(r.k)
    for_ever = lambda c: F.when(c == last, F.lit(1 << 30)).otherwise(c) if r.fixed else c
    overlap = F.greatest("s_start", F.col("o_start") + 1) <= F.least(for_ever(F.col("s_end")), for_ever(F.col("o_end")) + 1)
    met = e.join(s, "s").join(o, "o").where(overlap)
    end = clip_end(F.col("s_end"), F.col("o_end"), last) if r.fixed else F.least("s_end", F.col("o_end") + 1)
    return met.select("s_rep", "s_start", "p", "o_rep", "o_start", clip_start(F.col("s_start"), F.col("o_start")).alias("edge_start"), end.alias("edge_end")).distinct()


def living(blocks_: DataFrame, k: int) -> DataFrame:
    return blocks_.where((F.col("start_level") <= k) & (F.col("end_level") >= k))


def quotient(r: Refinement, k: int | None = None, hist: DataFrame | None = None, finals: DataFrame | None = None) -> DataFrame:
    """``distinct (block of s, p, block of o)`` at level ``k`` (default: the last), from final blocks."""
    e = finals or final_edges(r)
    if k is None or k >= r.k:
        return e
    at = living(hist or history(r), k).select("final", "rep")
    s, o = at.select(F.col("final").alias("s"), F.col("rep").alias("sb")), at.select(F.col("final").alias("o"), F.col("rep").alias("ob"))
    return e.join(s, "s").join(o, "o").select(F.col("sb").alias("s"), "p", F.col("ob").alias("o")).distinct()


def contains(r: Refinement, k: int | None = None, hist: DataFrame | None = None) -> DataFrame:
    """``(block, node)`` of all blocks at level ``k``, singletons too."""
    if k is None or k >= r.k:
        return r.final.select("block", "node")
    at = living(hist or history(r), k).select(F.col("final").alias("block"), "rep")
    return r.final.join(at, "block").select(F.col("rep").alias("block"), "node")


def members(r: Refinement, hist: DataFrame | None = None) -> DataFrame:
    """``(rep, start_level, node)`` of every block of every level."""
    hist = hist or history(r)
    return r.final.select(F.col("block").alias("final"), "node").join(hist, "final").select("rep", "start_level", "node")


def positive_ids(e: DataFrame) -> DataFrame:
    """A quotient graph with its block ids made dense from 0, in order of the ids."""
    from .preprocess import _numbered

    ids = _numbered(e.select(F.col("s").alias("iri")).union(e.select(F.col("o").alias("iri"))))
    s, o = ids.select(F.col("iri").alias("s"), F.col("id").alias("sid")), ids.select(F.col("iri").alias("o"), F.col("id").alias("oid"))
    return e.join(s, "s").join(o, "o").select(F.col("sid").alias("s"), "p", F.col("oid").alias("o"))


def block_ids(blocks_: DataFrame) -> DataFrame:
    """``(rep, start_level, local_id, global_id)``: dense numbers of blocks, of all levels and among those born at one.

    In order of level and block; ranges are numbered by themselves, so no task sees all blocks.
    """
    from .preprocess import numbered_ranges

    ids = numbered_ranges(blocks_.select("rep", "start_level"), ["start_level", "rep"])
    first = ids.groupBy("start_level").agg(F.min("id").alias("first"))  # one row a level
    return ids.join(F.broadcast(first), "start_level").select("rep", "start_level", (F.col("id") - F.col("first")).alias("local_id"), F.col("id").alias("global_id"))


def differences(a: Refinement, b: Refinement) -> DataFrame:
    """``(side, rep, start_level, end_level, size)``: blocks that one of two summaries lacks; none if they are the same.

    A block is its smallest node, lifetime and size; nested partitions of the same graph
    that agree on these for all blocks are equal.
    """
    x, y = (blocks(r).select("rep", "start_level", "end_level", "size") for r in (a, b))
    return x.exceptAll(y).select(F.lit("first").alias("side"), "*").union(y.exceptAll(x).select(F.lit("second").alias("side"), "*"))


def broadcast_features(partition: DataFrame, features: DataFrame) -> DataFrame:
    """A value of each block given to each of its nodes: ``(node, value)``."""
    return partition.select("node", "block").join(features.select("block", "value"), "block").select("node", "value")
