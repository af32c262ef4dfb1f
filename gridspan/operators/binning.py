"""Histograms, bins, counts, lookups and interpolation: grouped sums by computed bin."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions.semantics import NAN, double
from gridspan.layout import ranged
from gridspan.operators import selection


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal widths; the last includes its right edge; NULL outside and for NaN."""
    width = (high - low) / bins
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / width), F.lit(bins - 1)))


def digitize(x: Column | str, edges: Sequence[float], right: bool = False) -> Column:
    """How many edges lie below (or at) x; for falling edges counted from their end."""
    x = double(x)
    if len(edges) > 1 and edges[0] > edges[-1]:
        return F.lit(len(edges)) - digitize(x, edges[::-1], right)
    count = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: (e < x) if right else (e <= x)))
    return F.when(x.isNull(), None).when(F.isnan(x), len(edges)).otherwise(count)


def histogram_bin_edges(df: DataFrame, column: str, bins: int | str = 10, low: float | None = None, high: float | None = None) -> list[float]:
    """Equal widths over the range, their number given or by a rule of the data's count, spread or quartiles."""
    x = double(column)
    r = df.filter(~F.isnan(x)).agg(F.min(x), F.max(x), F.count(x), F.stddev_pop(x), F.skewness(x)).first()
    lo, hi = (r[0] if low is None else low), (r[1] if high is None else high)
    lo, hi = (0.0, 1.0) if lo is None else (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    n = r[2]
    if isinstance(bins, str):
        span, widths = hi - lo, {}
        if n:
            widths["sqrt"] = span / math.sqrt(n)
            widths["sturges"] = span / (math.log2(n) + 1)
            widths["rice"] = span / (2 * n ** (1 / 3))
            widths["scott"] = (24 * math.sqrt(math.pi) / n) ** (1 / 3) * r[3]
            if bins in ("fd", "auto"):
                quarters = selection.quantiles(df, [], x, {"low": (0.25, "linear"), "high": (0.75, "linear")}, skip_nan=True).first()
                widths["fd"] = 2 * (quarters.high - quarters.low) * n ** (-1 / 3)
            skew_error = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0
            widths["doane"] = span / (1 + math.log2(n) + math.log2(1 + abs(r[4] or 0) / skew_error)) if skew_error and r[3] else 0
            widths["auto"] = min(widths["fd"], widths["sturges"]) if widths.get("fd") else widths["sturges"]
        width = widths.get(bins, 0)
        bins = max(1, math.ceil(span / width)) if width else 1
    return [lo + k * (hi - lo) / bins for k in range(bins)] + [hi]


def histogram(df: DataFrame, column: str, bins: int | Sequence[float] = 10, low: float | None = None, high: float | None = None, weights: str | None = None, density: bool = False) -> DataFrame:
    """(bin, low, high, count): one grouped sum; empty bins included."""
    spark = df.sparkSession
    x = double(column)
    if isinstance(bins, int):
        edges = histogram_bin_edges(df, column, bins, low, high)
        place = bin_of(x, edges[0], edges[-1], bins)
    else:
        edges = [float(e) for e in bins]
        at = digitize(x, edges) - 1
        place = F.when(x == edges[-1], len(edges) - 2).when((at >= 0) & (at < len(edges) - 1) & ~F.isnan(x), at)
    value = F.sum(double(weights)) if weights else F.count("*").cast("double") if density else F.count("*")
    counts = df.groupBy(place.cast("long").alias("bin")).agg(value.alias("count")).filter("bin is not null")
    frame = spark.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)], "bin long, low double, high double")
    found = frame.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if density:
        total = counts.agg(F.sum("count").alias("_t"))
        found = found.crossJoin(F.broadcast(total)).withColumn("count", F.col("count") / F.col("_t") / (F.col("high") - F.col("low"))).drop("_t")
    return found


def histogramdd(df: DataFrame, columns: Sequence[str], bins: Sequence[int], ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """(b0, b1, .., count) of the cells that have rows."""
    places = [bin_of(double(c), lo, hi, n).cast("long").alias(f"b{k}") for k, (c, n, (lo, hi)) in enumerate(zip(columns, bins, ranges, strict=True))]
    found = df.select(*places).dropna()
    return found.groupBy(*found.columns).agg(F.count("*").alias("count"))


def histogram2d(df, x, y, bins=(10, 10), ranges=((0.0, 1.0), (0.0, 1.0))):
    return histogramdd(df, [x, y], bins, ranges)


def bincount(df: DataFrame, column: str, weights: str | None = None, minlength: int = 0) -> DataFrame:
    """(value, count) for 0 up to the largest value, at least minlength of them."""
    counts = df.groupBy(F.col(column).cast("long").alias("value")).agg((F.sum(double(weights)) if weights else F.count("*")).alias("count"))
    top = counts.agg(F.max("value")).first()[0]
    grid = df.sparkSession.range(max(-1 if top is None else top, minlength - 1) + 1).withColumnRenamed("id", "value")
    return grid.join(counts, "value", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def asof(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """`left` with the values of the last right row at or before `on`, within keys.

    Both sides meet in one running look-back, not in a range join. Without keys
    rows go by ranges of `on`, left rows of one value by their hash too; each
    range starts from the last right row of the ranges before it.
    """
    pick = F.struct(*(F.col(v) for v in values))
    a = left.withColumn("_v", F.lit(None)).withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(on), pick.alias("_v")).withColumn("_side", F.lit(0))
    both = a.drop("_v").join(b.limit(0).select("_v"), F.lit(False), "left").unionByName(b, allowMissingColumns=True)
    order = [F.col(on), F.col("_side")]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    else:
        spread = F.when(F.col("_side") == 1, F.xxhash64(*left.columns)).otherwise(F.lit(0).cast("long"))
        cut = ranged(both, [on, "_side", spread])
        w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        tops = cut.filter("_v is not null").groupBy("_range").agg(F.max_by("_v", on).alias("_t"))
        grid = cut.select("_range").distinct().join(tops, "_range", "left")
        before = grid.select("_range", F.last("_t", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        found = cut.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).join(F.broadcast(before), "_range").withColumn("_last", F.coalesce("_last", "_before"))
    return found.filter("_side = 1").select(*left.columns, *(F.col("_last")[v].alias(v) for v in values))


def interp(df: DataFrame, x: str, knots: DataFrame, xp: str, fp: str, out: str = "interp", left: float | None = None, right: float | None = None) -> DataFrame:
    """`df` with `out`: linear interpolation between knots, clamped outside; NaN stays NaN.

    Each knot carries its successor, the last of a range that of the next one, and rows look back to their knot.
    """
    cut = ranged(knots.select(F.col(xp).cast("double").alias("_x0"), F.col(fp).cast("double").alias("_f0")), ["_x0", "_f0"])
    knot = F.struct("_x0", "_f0")
    firsts = cut.groupBy("_range").agg(F.min(knot).alias("_first"))
    after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))  # one row a range
    led = cut.withColumn("_next", F.lead(knot).over(Window.partitionBy("_range").orderBy("_x0", "_f0"))).join(F.broadcast(after), "_range")
    then = F.coalesce("_next", "_after")
    pairs = led.select("_x0", "_f0", then["_x0"].alias("_x1"), then["_f0"].alias("_f1"))
    ends = knots.agg(F.min_by(fp, xp).cast("double").alias("_first"), F.max_by(fp, xp).cast("double").alias("_end"))
    rows = df.withColumn("_on", double(x))
    found = asof(rows, pairs.withColumn("_on", F.col("_x0")), "_on", (), ("_x0", "_f0", "_x1", "_f1")).crossJoin(F.broadcast(ends))
    on = F.col("_on")
    inside = F.col("_f0") + (F.col("_f1") - F.col("_f0")) * (on - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    low = F.col("_first") if left is None else F.lit(left)
    high = F.when(on == F.col("_x0"), F.col("_end")).otherwise(F.col("_end") if right is None else F.lit(right))
    value = F.when(F.isnan(on), NAN).when(F.col("_x0").isNull(), low).when(F.col("_x1").isNull(), high).otherwise(inside)
    return found.withColumn(out, value).drop("_on", "_x0", "_f0", "_x1", "_f1", "_first", "_end")
