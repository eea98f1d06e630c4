"""Graphs made from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF
from ..operators.graphs import nodes

BASE = "http://example.org/"
#: Node ids are ``kind * KIND + key``; fixed values.
KIND = 10**12
REGION, NATION, CUSTOMER, ORDER, PART, EVENT = 1, 2, 3, 4, 5, 6
PLACED_BY, IN_NATION, IN_REGION, CONTAINS, NEXT = 1, 2, 3, 4, 5
PREDICATES = {PLACED_BY: "placedBy", IN_NATION: "inNation", IN_REGION: "inRegion", CONTAINS: "contains", NEXT: "next"}


@dataclass
class Graph:
    edges: DataFrame  # (s, p, o)
    nodes: DataFrame  # (node)
    types: DataFrame  # (node, type)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: int, key: str) -> Column:
    return F.lit(kind * KIND) + F.col(key).cast("bigint")


def _edges(df: DataFrame, s: Column, p: int, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).cast("bigint").alias("p"), o.alias("o"))


def star(spark: SparkSession, sf_dir: str, parts: bool = False) -> Graph:
    """Orders to customers to nations to regions; with ``parts`` also orders to parts."""
    orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    e = _edges(orders, _id(ORDER, "o_orderkey"), PLACED_BY, _id(CUSTOMER, "o_custkey")).union(_edges(customer, _id(CUSTOMER, "c_custkey"), IN_NATION, _id(NATION, "c_nationkey")))
    e = e.union(_edges(nation, _id(NATION, "n_nationkey"), IN_REGION, _id(REGION, "n_regionkey")))
    t = orders.select(_id(ORDER, "o_orderkey").alias("node"), F.col("o_orderstatus").alias("type")).union(customer.select(_id(CUSTOMER, "c_custkey"), "c_mktsegment"))
    t = t.union(nation.select(_id(NATION, "n_nationkey"), F.lit("Nation"))).union(region.select(_id(REGION, "r_regionkey"), "r_name"))
    if parts:
        part = read(spark, sf_dir, "part")
        e = e.union(_edges(read(spark, sf_dir, "lineitem"), _id(ORDER, "l_orderkey"), CONTAINS, _id(PART, "l_partkey")))
        t = t.union(part.select(_id(PART, "p_partkey"), "p_brand"))
    e = e.distinct()
    return Graph(e, nodes(e).union(t.select("node")).distinct(), t)


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each user's events in order, typed by event type."""
    from pyspark.sql.window import Window

    events = read(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = _edges(events.withColumn("nxt", nxt).where("nxt is not null"), _id(EVENT, "event_id"), NEXT, _id(EVENT, "nxt"))
    t = events.select(_id(EVENT, "event_id").alias("node"), F.col("event_type").alias("type"))
    return Graph(e, t.select("node").distinct(), t)


def rdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of N-Triples about customers, nations and regions, with types, literals and a list."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    iri = lambda kind, key: F.concat(F.lit(f"<{BASE}{kind}/"), F.col(key).cast("string"), F.lit(">"))
    fixed = lambda text: F.lit(f"<{text}>")
    literal = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = lambda df, s, p, o: df.select(F.concat_ws(" ", s, p, o, F.lit(".")).alias("value"))
    c, n, r = iri("customer", "c_custkey"), iri("nation", "n_nationkey"), iri("region", "r_regionkey")
    out = line(customer, c, fixed(BASE + "inNation"), iri("nation", "c_nationkey"))
    for rows, s, p, o in (
        (customer, c, BASE + "name", literal("c_name")), (customer, c, RDF + "type", F.concat(F.lit(f"<{BASE}segment/"), F.col("c_mktsegment"), F.lit(">"))),
        (nation, n, BASE + "inRegion", iri("region", "n_regionkey")), (nation, n, BASE + "name", F.concat(literal("n_name"), F.lit("@en"))), (nation, n, RDF + "type", fixed(BASE + "Nation")),
        (region, r, BASE + "name", literal("r_name")), (region, r, RDF + "first", F.concat(F.lit("_:first"), F.col("r_regionkey").cast("string"))), (region, r, RDF + "rest", fixed(RDF + "nil")),
    ):
        out = out.union(line(rows, s, fixed(p) if isinstance(p, str) else p, o))
    return out
