"""Fixed-width little-endian records, for exchange with tools that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed widths in bytes: entity, predicate, block, block or singleton, level.
WIDTHS = {"entity": 5, "predicate": 4, "block": 4, "block_or_singleton": 5, "level": 2}
_SIGNED = {"block_or_singleton"}


def _number(column: Column, width: int, signed: bool) -> Column:
    value = F.conv(F.concat(*[F.hex(F.substring(column, i, 1)) for i in range(width, 0, -1)]), 16, 10).cast("bigint")
    return F.when(value >= 1 << (8 * width - 1), value - (1 << (8 * width))).otherwise(value) if signed else value


def _bytes(value: Column, width: int) -> Column:
    plain = F.when(value < 0, value + (1 << (8 * width))).otherwise(value)
    text = F.lpad(F.hex(plain), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]))


def read_records(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """A table from files of records; ``fields`` names columns and their kinds of number."""
    size = sum(WIDTHS[k] for _, k in fields)
    raw = spark.sparkContext.binaryRecords(path, size).map(lambda b: (bytearray(b),)).toDF("r binary")
    out, at = [], 1
    for name, k in fields:
        out.append(_number(F.substring("r", at, WIDTHS[k]), WIDTHS[k], k in _SIGNED).alias(name))
        at += WIDTHS[k]
    return raw.select(*out)


def packed(rows: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """One BINARY column ``record`` from the given columns."""
    return rows.select(F.concat(*[_bytes(F.col(name), WIDTHS[k]) for name, k in fields]).alias("record"))


def read_edges(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    e = read_records(spark, path, [("s", "entity"), ("p", "predicate"), ("o", "entity")])
    return e.select(F.col("o").alias("s"), "p", F.col("s").alias("o")) if reverse else e


def checked_edges(spark: SparkSession, path: str) -> int:
    """The number of triples in files of edge records; a file that is no whole number of records is an error."""
    width = sum(WIDTHS[k] for k in ("entity", "predicate", "entity"))
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are not read
    bad = files.where(F.col("length") % width != 0).select("path").limit(5).collect()
    if bad:
        raise ValueError(f"no whole number of {width}-byte records: {[r.path for r in bad]}")
    return files.agg(F.sum(F.expr(f"length div {width}"))).first()[0] or 0
