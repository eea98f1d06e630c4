"""k-bisimulation: partitions of the nodes by what can be reached in k steps.

A partition is ``(node, block, start, size)``: ``block`` is the smallest node of the
block, ``start`` the level since which this set of nodes has been a block, ``size``
its number of nodes.  ``(block, start)`` names a set of nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut, remove, scratch, written


def universal_start(nodes: DataFrame) -> DataFrame:
    """Level 0 with all nodes in one block."""
    one = nodes.agg(F.min("node").alias("block"), F.count("*").alias("size"))
    return nodes.crossJoin(F.broadcast(one)).select("node", "block", F.lit(0).alias("start"), "size")


def typed_start(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Level 0 by the set of types of each node; nodes without a type are one block.

    ``types``: ``(node, type)``.
    """
    own = _set_hash(types.select("node", F.struct("type").alias("x")))
    keyed = nodes.select("node").join(own, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("h1", "h2", "n")])
    groups = keyed.groupBy("h1", "h2", "n").agg(F.min("node").alias("block"), F.count("*").alias("size"))
    return keyed.join(groups, ["h1", "h2", "n"]).select("node", "block", F.lit(0).alias("start"), "size")


def _set_hash(pairs: DataFrame) -> DataFrame:
    """``(node, h1, h2, n)``: 128 bits of hash and the size of each node's set of ``x``.

    The state is of fixed size and is combined before the shuffle, so a node with
    very many edges is no burden.  Two of N sets collide with a chance of about
    N**2 / 2**129; ``exact_signatures`` has none, but gathers each set in one row.
    """
    once = pairs.distinct()
    return once.groupBy("node").agg(F.bit_xor(F.xxhash64("x")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(0x5BD1E995), "x")).alias("h2"), F.count("*").alias("n"))


def signatures(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The hashed set of ``(p, block of o)`` of each node with an outgoing edge."""
    seen = edges.join(partition.select(F.col("node").alias("o"), F.col("block").alias("b")), "o")
    return _set_hash(seen.select(F.col("s").alias("node"), F.struct("p", "b").alias("x")))


def exact_signatures(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """As ``signatures``, from the whole sorted set."""
    seen = edges.join(partition.select(F.col("node").alias("o"), F.col("block").alias("b")), "o")
    sets = seen.groupBy(F.col("s").alias("node")).agg(F.sort_array(F.collect_set(F.struct("p", "b"))).alias("x"))
    return sets.select("node", F.sha2(F.to_json("x"), 256).alias("h1"), F.lit(0).alias("h2"), F.size("x").cast("bigint").alias("n"))


def refined(edges: DataFrame, partition: DataFrame, level: int, min_support: int = 1, exact: bool = False, dirty: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: ``(partition at level, new blocks)``.

    Blocks of at most ``min_support`` nodes are never split, nor are those not in ``dirty``
    ``(block)``, where that is given: no edge of theirs leads to a block that changed.  New blocks come with
    the block that they refine: ``(block, start, size, parent, parent_start)``.
    """
    stays = F.col("size") <= min_support
    whole, rest = partition.where(stays), partition.where(~stays)
    if dirty is not None:
        whole, rest = whole.union(rest.join(dirty, "block", "left_anti").select(*partition.columns)), rest.join(dirty, "block", "left_semi").select(*partition.columns)
    # Only edges of nodes whose block can still split make signatures.
    live = edges.join(rest.select(F.col("node").alias("s")), "s", "left_semi")
    sig = (exact_signatures if exact else signatures)(live, partition)
    none = F.lit("") if exact else F.lit(0)
    keyed = rest.join(sig, "node", "left").select("node", "block", "start", "size", F.coalesce("h1", none).alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2"), F.coalesce("n", F.lit(0)).alias("n"))
    keyed = cut(keyed, "signatures")
    key = ["block", "h1", "h2", "n"]
    groups = keyed.groupBy("block", "start", "size", "h1", "h2", "n").agg(F.min("node").alias("new_block"), F.count("*").alias("new_size"))
    split = F.col("new_size") < F.col("size")
    groups = cut(groups.select(*key, F.col("start").alias("parent_start"), "new_block", "new_size", F.when(split, F.lit(level)).otherwise(F.col("start")).alias("new_start"), split.alias("is_new")), "groups")
    moved = keyed.select("node", *key).join(groups, key).select("node", F.col("new_block").alias("block"), F.col("new_start").alias("start"), F.col("new_size").alias("size"))
    born = groups.where("is_new").select(F.col("new_block").alias("block"), F.col("new_start").alias("start"), F.col("new_size").alias("size"), F.col("block").alias("parent"), "parent_start")
    return moved.unionByName(whole.select("node", "block", "start", "size")), born


@dataclass
class Refinement:
    """Every level of a refinement, stored by its changes.

    ``final``: the partition at level ``k``.  ``born``: ``(block, start, size, parent,
    parent_start)`` of every block that ever was.  ``fixed``: is ``k`` the fixed point?
    Where a limit ended the run, that takes one more round, made when it is asked for.
    """

    edges: DataFrame
    final: DataFrame
    born: DataFrame
    k: int
    sizes: list[int]  # blocks at each level
    more: Callable[[], bool] | None = None  # would another round split anything?

    @cached_property
    def fixed(self) -> bool:
        return self.more is None or not self.more()


def dirty_blocks(edges: DataFrame, partition: DataFrame, level: int) -> DataFrame:
    """``(block)`` with a node that has an edge into a block born at ``level``: only these can split next."""
    changed = partition.where(F.col("start") == level).select(F.col("node").alias("o"))
    sources = edges.select("s", "o").join(changed, "o", "left_semi").select(F.col("s").alias("node"))
    return partition.select("node", "block").join(sources, "node", "left_semi").select("block").distinct()


def refinement(edges: DataFrame, start: DataFrame, max_k: int | None = None, min_support: int = 1, exact: bool = False) -> Refinement:
    """Refine until a round splits nothing, or up to level ``max_k``.

    Each level is written to the shared folder and read from there, so the plan of
    a round doesn't hold the rounds before; what a level is made from is removed when the
    level after it is there.  Once fewer than half of the nodes changed their block, a
    round only looks at blocks with an edge into one that changed.  The driver gets a few
    numbers a round.
    """
    spark = edges.sparkSession
    edges = cut(edges, "edges")
    p, path = written(start, "level-0")
    first = p.groupBy("block", "start", "size").count().drop("count")
    born = [cut(first.select("block", "start", "size", F.lit(None).cast(dict(p.dtypes)["block"]).alias("parent"), F.lit(None).cast("int").alias("parent_start")), "born-0")]
    n_blocks, n_nodes = born[0].agg(F.count("*"), F.sum("size")).first()
    sizes, k, dirty = [n_blocks], 0, None
    while max_k is None or k < max_k:
        with scratch(spark):
            p_next, new = refined(edges, p, k + 1, min_support, exact, dirty)
            new = written(new, f"born-{k + 1}", lasting=True)[0]
            n, parents, changed = new.agg(F.count("*"), F.count_distinct("parent", "parent_start"), F.sum("size")).first()
            if n:
                old, k = path, k + 1
                p, path = written(p_next, f"level-{k}", lasting=True)
        if not n:
            return Refinement(edges, p, _together(born), k, sizes)
        remove(spark, old)
        born.append(new)
        sizes.append(sizes[-1] + n - parents)
        dirty = dirty_blocks(edges, p, k) if 2 * changed < n_nodes else None
    return Refinement(edges, p, _together(born), k, sizes, lambda: bool(refined(edges, p, k + 1, min_support, exact, dirty)[1].head(1)))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return cut(out, "born")
