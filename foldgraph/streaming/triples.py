"""Triples that keep arriving: the file scan as a stream.

Lines that are no triples are left out, and repeated triples are appended as they come;
the batch operators take sets of triples.  The batch operators start from the table that this writes; a summary is always of
the triples that have arrived when it is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ntriples import parsed, terms


def triple_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """``(s, p, o, o_kind)`` of each line of each file that arrives in ``folder``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return terms(parsed(lines, strict=False).where("bad is null").drop("g", "bad"))


def append_triples(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table; once all files that are there now are in, the query ends."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
