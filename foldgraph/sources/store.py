"""Tables in Parquet, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (tests) a temporary folder, once a session."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"foldgraph-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir().rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``cut`` and ``written`` make within are removed at the end, but for lasting ones."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that owns it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, lasting: bool = False) -> tuple[DataFrame, str]:
    """Write to the shared folder and reread: a short plan, and nothing lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/foldgraph-{name}-{uuid.uuid4().hex}"
    if _scratch and not lasting:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def write_tables(tables: dict[str, DataFrame], folder: str, by: dict[str, str] | None = None) -> None:
    """Each table below ``folder``; ``by`` names a column to partition a table's files by."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by[name]) if by and name in by else w).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
