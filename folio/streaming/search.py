"""Keyword search over a stream of documents. It is local to each row, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import keyword_pattern
from folio.operators.keyword import line_units


def stream_hits(documents: DataFrame, keyword: str) -> DataFrame:
    """(doc_id, unit_ord, occurrences) of the lines that hold the keyword; documents may be a stream or a table."""
    pattern = keyword_pattern(keyword, hyphenated=True)
    unit = line_units(documents).filter(F.col("text").rlike(pattern))
    return unit.select("doc_id", "unit_ord", F.regexp_count("text", F.lit(pattern)).alias("occurrences"))
