"""Helpers shared by the corpus operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker.  Texts are long, so the
#: engine default of 10,000 rows would put gigabytes in one batch.
BATCH_ROWS = 400
#: Bytes of one Arrow batch, for tables in which every text is long; one longer row is a batch by itself.
BATCH_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch for this session (never raises a limit)."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is unset (single-machine tests) a temporary folder is made
    and registered, once for a session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"foldgraph-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foldgraph-{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``written`` makes within are removed at the end, but those made with ``lasting``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and reread it.

    This cuts the lineage: a lost executor costs a reread and nothing upstream.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _scratch and not lasting:
        _scratch[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Files of a table up to which their paths are broadcast; rows of a table in more files are copied to be numbered.
BROADCAST_FILES = 100_000


def _stored(df: DataFrame) -> bool:
    """Is ``df`` nothing but the Parquet files below one path?  Then its reader tells each row's place."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in (c.lower() for c in df.columns):
        return False
    files = plan.relation()
    if files.getClass().getSimpleName() != "HadoopFsRelation" or files.location().rootPaths().size() != 1:
        return False
    return files.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a distinct BIGINT for each row, the same at every read; and that column's name.

    Rows of a Parquet table are numbered by file and place in it, and not copied; all others are written.
    """
    row, path, file, place = unused(df, "__row_number", "__file_path", "__file_number", "__file_row")
    if _stored(df):
        paths = df.select(F.col("_metadata.file_path").alias(path)).distinct()
        files, _ = written(paths.withColumn(file, F.row_number().over(Window.orderBy(path)).cast("bigint")), f"{name}-files", lasting=True)
        if files.count() <= BROADCAST_FILES:
            own = df.withColumn(path, F.col("_metadata.file_path")).withColumn(place, F.col("_metadata.row_index"))
            return own.join(F.broadcast(files), path).withColumn(row, F.shiftleft(file, 40).bitwiseOR(F.col(place))).drop(path, file, place), row
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)[0], row


#: Rows of a written table of numbers up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for broadcast if it has ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made, by the file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def smallest_hashes(key: Column, share: Column) -> Column:
    """Is the hash of ``key`` among the smallest ``share`` (0 to 1) of all hashes?

    Put before a sorted limit on hashes: with several times the wanted share it
    changes nothing of the result, but what the tasks send no longer grows with
    their number.
    """
    return F.xxhash64(key) / F.lit(2.0**64) + 0.5 <= share
