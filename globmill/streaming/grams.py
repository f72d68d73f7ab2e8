"""Incremental statistics with Structured Streaming: counts of grams and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counting import grams


def gram_counts(stream: DataFrame, column: str, n: int = 3) -> DataFrame:
    """gram, cnt over all rows so far (update or complete mode)."""
    return stream.select(F.explode(grams(F.coalesce(F.col(column), F.lit("")), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


def windowed(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and kind; late rows beyond the watermark are dropped when streaming."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return x.select(F.col("window.start").alias("start"), kind, "n")
