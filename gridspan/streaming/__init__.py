"""Array operators on streams: elementwise expressions work unchanged; windows of time need watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.operators.binning import bin_of


def windowed(stream: DataFrame, time: str, width: str, aggregates: Sequence[Column], keys: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by window of time (and keys); rows later than the watermark are left out of closed windows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = stream.withWatermark(time, late).groupBy(window.alias("_w"), *keys).agg(*aggregates)
    return found.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *(c for c in found.columns if c != "_w"))


def histogram(stream: DataFrame, time: str, column: str, low: float, high: float, bins: int, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts by window of time and bin."""
    binned = stream.withColumn("bin", bin_of(F.col(column).cast("double"), low, high, bins)).filter("bin is not null")
    return windowed(binned, time, width, [F.count("*").alias("count")], ["bin"], late)
