"""Order and position without one giant partition.

Arrays are ordered and DataFrames are not: positions are columns. A window
without a partition key would move every row to one task, so running sums go
by blocks of positions, and ranks by ranges of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block of a running sum, and blocks in a block of blocks.
BLOCK, BLOCKS = 100_000, 10_000
#: Rows in a range of values, and the least and most ranges.
PER_RANGE, LEAST, RANGES = 100_000, 8, 1024
#: Keys drawn for each range of whole keys, and characters of them that borders keep.
SAMPLED, PREFIX = 16, 256


def running(
    df: DataFrame, value: Column, order: str, keys: Sequence[str], out: str, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], identity: Column, size: int | None = None
) -> DataFrame:
    """`df` with `out`: the fold of `value` over all rows up to this one, by integer position `order`, within `keys`.

    Each block is folded alone; the folds of whole blocks, one row a block, are
    folded in order, by blocks too where `size` positions make very many; both
    are joined. Positions are dense from 0. `fold` must skip NULL or spread it alike.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn("_v", value)
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("_in", fold(F.col("_v")).over(inner))
    totals = cut.groupBy(*keys, "_block").agg(fold(F.col("_v")).alias("_total"))
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    if size is not None and size > BLOCK * BLOCKS:  # too many blocks for one task: they are folded by blocks of their own
        up = running(totals.withColumnRenamed("_block", "_at"), F.col("_total"), "_at", keys, "_to", fold, join, identity, math.ceil(size / BLOCK))
        before = up.select(*keys, (F.col("_at") + 1).alias("_block"), F.col("_to").alias("_before"))
    else:
        before = totals.select(*keys, "_block", fold(F.col("_total")).over(outer).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in (*keys, "_block")]
    for k in (*keys, "_block"):
        before = before.withColumnRenamed(k, f"_b_{k}")
    joined = inside.join(before, on, "left")
    result = join(F.coalesce("_before", identity), F.col("_in"))
    return joined.withColumn(out, result).drop("_block", "_v", "_in", "_before", *(f"_b_{k}" for k in (*keys, "_block")))


def neighbours(df: DataFrame, order: str, keys: Sequence[str], value: str, steps: Sequence[int]) -> DataFrame:
    """(keys, order, n_<step>..) for dense integer positions: each position with the values at position + step.

    Every row is sent to the positions that look at it and meets them in one
    aggregation: no window, no block borders. Step s gives column n_p<s> or n_m<s>.
    """
    sent = F.explode(F.array(*(F.struct((F.col(order) - s).alias("at"), F.lit(s).alias("step")) for s in steps)))
    rows = df.select(*keys, value, sent.alias("_s"), order)
    names = {s: f"n_m{-s}" if s < 0 else f"n_p{s}" for s in steps}
    return rows.groupBy(*keys, F.col("_s.at").alias(order)).agg(*(F.max(F.when(F.col("_s.step") == s, F.struct(F.col(value)))).getField(value).alias(n) for s, n in names.items()))


def ordered(by: Sequence[str | Column]) -> list[Column]:
    """Sort keys, rising, NULL last."""
    return [(F.col(b) if isinstance(b, str) else b).asc_nulls_last() for b in by]


def _told(v: object) -> tuple:
    """The order of `ordered`, for values on the driver: NaN above all numbers, NULL last."""
    return (v is None, v != v, 0 if v is None or v != v else v)


def _halved(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the rising cuts lie below x; NULL and NaN are above all."""

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x <= cuts[mid], halve(low, mid)).otherwise(halve(mid + 1, high))

    return halve(0, len(cuts))


def _borders(df: DataFrame, keys: Sequence[Column], n: int, wanted: int) -> Column:
    """Ranges by whole keys of any type, the borders from a sample by hash; the driver gets SAMPLED keys a range."""
    dtypes = [t for _, t in df.select(*keys).dtypes]
    short = [F.substring(k, 1, PREFIX) if t in ("string", "binary") else k for k, t in zip(keys, dtypes, strict=True)]
    step = max(n // (SAMPLED * wanted), 1)
    drawn = df.filter(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0).select(*(k.alias(f"k{i}") for i, k in enumerate(short)))
    types = [t for _, t in drawn.dtypes]
    found = sorted((tuple(r) for r in drawn.distinct().limit(2 * SAMPLED * wanted).collect()), key=lambda r: [_told(v) for v in r])
    cuts = [found[len(found) * k // wanted] for k in range(1, wanted)] if len(found) >= wanted else found
    if not cuts:
        return F.lit(0)
    whole = lambda values: F.struct(*(c for i, v in enumerate(values) for c in (v.isNull().alias(f"n{i}"), v.alias(f"k{i}"))))
    borders = F.array(*(whole([F.lit(v).cast(t) for v, t in zip(cut, types, strict=True)]) for cut in cuts))
    own = whole([k.cast(t) for k, t in zip(keys, types, strict=True)])
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) < own, at + step).otherwise(at))


def ranges(df: DataFrame, by: Sequence[str | Column]) -> Column:
    """The number of the range that a row's keys `by` fall in, in the order of `ordered`; about equally many rows each.

    The number of ranges grows with the rows. A number that leads is cut at its
    approximate quantiles. Where it is text, or where one value of it has more
    rows than a range holds, borders are whole keys, so that equal values are
    told apart by the next ones. Every row gets a range whatever the borders are.
    """
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    if dict(df.select(keys[0].alias("k")).dtypes)["k"] not in ("double", "float", "bigint", "int", "smallint", "tinyint"):
        n = df.count()
        return _borders(df, keys, n, min(max(math.ceil(n / PER_RANGE), LEAST), RANGES))
    x = keys[0].cast("double")
    plain = F.when(~F.isnan(x), x)
    at = F.split(F.lit(",".join(str(k / RANGES) for k in range(1, RANGES))), ",").cast("array<double>")  # one literal plans sooner than a thousand
    n, numbers, marks = df.agg(F.count("*"), F.count(plain), F.percentile_approx(plain, at, 8 * RANGES)).first()
    wanted = min(max(math.ceil(n / PER_RANGE), LEAST), RANGES)
    if not numbers:
        return F.lit(0) if n == 0 else _borders(df, keys, n, wanted)
    cuts = [marks[RANGES * k // wanted - 1] for k in range(1, wanted)]
    hot = len(set(cuts)) < len(cuts) or (n - numbers) * wanted > 2 * n
    if hot and n > LEAST * len(keys) and len(keys) > 1:
        return _borders(df, keys, n, wanted)
    return _halved(x, sorted(set(cuts)))


def ranged(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """`df` with `_range`, see `ranges`."""
    return df.withColumn("_range", ranges(df, by))


def running_by_range(df: DataFrame, value: Column, by: Sequence[str | Column], out: str) -> DataFrame:
    """`df` with `out`: the sum of the whole number `value` over all rows up to this one in the order of `by`, NULL last.

    Each range of `by` is summed alone, and the sums of lower ranges, one row each, are added.
    """
    cut = ranged(df, by).withColumn("_v", value)
    sums = cut.groupBy("_range").agg(F.sum("_v").alias("_n"))
    base = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = cut.withColumn("_in", F.sum("_v").over(Window.partitionBy("_range").orderBy(*ordered(by)).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(F.broadcast(base), "_range").withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_range", "_base", "_in", "_v")


def ranked(df: DataFrame, by: Sequence[str | Column], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` with `out`: the 0-based place of each row in the order of `by`, rising, NULL last, within `keys`.

    With keys this is a window over each, without by ranges: each is ranked
    alone and the counts of lower ones are added.
    """
    if keys:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered(by))) - 1).cast("long"))
    return running_by_range(df, F.lit(1), by, out).withColumn(out, F.col(out) - 1)
