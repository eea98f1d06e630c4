"""Layout-aware text of web pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .html_tree import visible_text


def extracted(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the visible text of each whole page.

    A tree builder puts in implied tags and repairs misnesting; visibility rules
    (elements without text, ``hidden``, ``display: none``, ``visibility``, closed
    ``details`` and ``dialog``, parts of drawings and formulas that aren't drawn) take
    away what a reader doesn't see; nothing else is dropped.  Blocks stand apart by line breaks, list items keep their marks and
    indents, table cells are padded to columns, ``pre`` keeps its spaces.  Null and
    empty pages have empty text.  Rows are independent: repeated rows, null keys
    and extra columns come back as they are.
    """
    small_batches(pages.sparkSession, 200)

    @F.arrow_udf("string")
    def render(h: pa.Array) -> pa.Array:
        return pa.array([visible_text(x) for x in h.to_pylist()], pa.string())

    return pages.withColumn(out, render(F.col(html)))
