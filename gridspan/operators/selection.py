"""Order statistics of groups of any size, by counting instead of collecting.

A value's rank is found from counts: the distinct values of a group with their
counts, in order, tell which value has the rank. Groups of more than LARGE rows
are narrowed first: a group is cut by the size of its numbers, STEPS cells for
each doubling, the rows of each cell are counted, and only the cell that holds
the rank goes on, cut into CUTS equal parts, until it is small enough to be
ordered. Cells depend on the values alone, so that every scan sees the same ones.
No task holds a group and no state grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridspan.functions.semantics import NAN, ColumnOrValue, double
from gridspan.operators.aggregate import METHODS

#: Rows of a group that are ordered at once; cells of a larger one for each doubling of its numbers, and parts that a cell is cut into.
LARGE, STEPS, CUTS = 1_000_000, 256, 4096

Rank = Callable[[Column], Column]


def _plain(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values with their count `_c` and the rows up to them `_to`, within keys; NaN after all numbers, NULL not counted."""
    upto = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    values = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    return values.withColumn("_to", F.sum(F.when(F.col("_x").isNotNull(), F.col("_c"))).over(upto))


def _holds(rank: Column) -> Column:
    return (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")) & F.col("_x").isNotNull()


def _ordered(rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, Rank]) -> DataFrame:
    """Of groups that are ordered at once: one scan, no join."""
    whole = Window.partitionBy(*keys)
    counted = _counted(rows, keys)
    x = F.col("_x")
    told = counted.withColumns({"_n": F.coalesce(F.sum(F.when(_plain(x), F.col("_c"))).over(whole), F.lit(0)), "_nan": F.coalesce(F.sum(F.when(F.isnan(x), F.col("_c"))).over(whole), F.lit(0))})
    picks = (F.max(F.when(_holds(rank(F.col("_n"))), x)).alias(name) for name, rank in ranks.items())
    return told.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_nan").alias("_nan"), *picks)


def _octave(x: Column) -> Column:
    """A number that never falls as x rises, from the logarithm of its size: STEPS for each doubling."""
    size = F.abs(x)
    near = F.floor(F.log2(F.when((size > 0) & (size < math.inf), size)) * STEPS) + 1100 * STEPS
    return F.when(x == 0, 0).otherwise(F.signum(x).cast("long") * F.coalesce(near, F.lit(2200 * STEPS)))


def _share(x: Column, low: Column, high: Column) -> Column:
    """Which of CUTS equal parts of low .. high has x."""
    return F.floor((x - low) / F.when(high > low, high - low) * CUTS)


def _totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    x = F.col("_x")
    return rows.groupBy(*keys).agg(F.count(F.when(_plain(x), 1)).alias("_n"), F.count(F.when(F.isnan(x), 1)).alias("_nan"), F.count("*").alias("_rows"))


def _holders(rows: DataFrame, wants: DataFrame, path: list[str], cell: Column) -> list:
    """The cells that hold the wanted ranks, with the ranks within them: a row for each want. rows: (path, _x); wants: (.., path, _w, _r)."""
    upto = Window.partitionBy(*path).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy(*path, cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high")).withColumn("_to", F.sum("_c").over(upto))
    met = cells.join(F.broadcast(wants), path).filter((F.col("_r") < F.col("_to")) & (F.col("_r") >= F.col("_to") - F.col("_c")))
    return met.withColumn("_r", F.col("_r") - F.col("_to") + F.col("_c")).select(*wants.columns, "_c", "_low", "_high").collect()


def _narrowed(rows: DataFrame, keys: list[str], totals: DataFrame, ranks: Mapping[str, Rank]) -> DataFrame:
    """Of larger groups, of which there is one in LARGE rows at most. totals: (keys, _n, _nan).

    The driver gets the cell that holds a rank: its borders and counts, never its rows.
    """
    spark, x = rows.sparkSession, F.col("_x")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("w"), rank(F.col("_n")).cast("long").alias("r")) for k, rank in enumerate(ranks.values()))))
    wants = totals.select(*keys, "_n", "_nan", wanted.alias("_w")).select(*keys, "_n", "_nan", F.col("_w.w").alias("_w"), F.col("_w.r").alias("_r"))
    told = wants.collect()
    named, base = wants.schema, spark.createDataFrame
    few = StructType([StructField(k, named[k].dataType) for k in (*keys, "_w", "_r")])
    inner = StructType([*few.fields, StructField("_c", LongType()), StructField("_low", DoubleType()), StructField("_high", DoubleType())])
    short = lambda found: [tuple(r[k] for k in inner.names) for r in found]
    plain = [r for r in told if r["_r"] is not None and 0 <= r["_r"] < r["_n"]]
    numbers = rows.filter(_plain(x))
    open_ = short(_holders(numbers, base([tuple(r[k] for k in few.names) for r in plain], few), keys, _octave(x))) if plain else []
    at, done = {k: inner.names.index(k) for k in ("_c", "_low", "_high")}, []
    while True:
        done += [r for r in open_ if r[at["_low"]] == r[at["_high"]]]
        open_ = [r for r in open_ if r[at["_low"]] != r[at["_high"]]]
        inside = numbers.join(F.broadcast(base(open_, inner)), keys).filter((x >= F.col("_low")) & (x <= F.col("_high")))
        if not any(r[at["_c"]] > LARGE for r in open_):
            break
        cell = _share(x, F.col("_low"), F.col("_high"))
        open_ = short(_holders(inside.select(*keys, "_w", "_x", "_low", "_high"), base([r[: len(few)] for r in open_], few), [*keys, "_w"], cell))
    path = [*keys, "_w"]
    known = [(*r[: len(path)], r[at["_low"]]) for r in done]
    known += [(*(r[k] for k in path), NAN) for r in told if r["_r"] is not None and r["_n"] <= r["_r"] < r["_n"] + r["_nan"]]
    placed = [base(known, StructType([*few.fields[: len(path)], StructField("_x", DoubleType())]))]
    if open_:
        ordered = _counted(inside.select(*path, "_r", "_x"), [*path, "_r"])
        placed.append(ordered.filter(_holds(F.col("_r"))).select(*path, "_x"))
    found = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    everyone = base(told, named).join(found, path, "left")
    return everyone.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_nan").alias("_nan"), *(F.max(F.when(F.col("_w") == k, x)).alias(name) for k, name in enumerate(ranks)))


def at_ranks(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, ranks: Mapping[str, Rank]) -> DataFrame:
    """(keys, _n, _nan, one column for each of `ranks`): the values that have those 0-based ranks in their group.

    A rank is a function of the group's count of numbers, `_n`. NaN ranks after
    all numbers; NULL has no rank, and neither has a place beyond the group.
    Keys without NULL.
    """
    keys = list(keys)
    rows = df.select(*keys, double(x).alias("_x"))
    n = rows.count()
    if n <= LARGE:
        return _ordered(rows, keys, ranks)
    if not keys:
        return at_ranks(rows.withColumn("_all", F.lit(0)), ["_all"], "_x", ranks).drop("_all")
    totals = _totals(rows, keys).filter(F.col("_rows") > LARGE)
    told = totals.collect()  # one in LARGE rows at most
    if not told:
        return _ordered(rows, keys, ranks)
    large = df.sparkSession.createDataFrame(told, totals.schema)
    if sum(r["_rows"] for r in told) == n:
        return _narrowed(rows, keys, large, ranks)
    named = F.broadcast(large.select(*keys))
    return _ordered(rows.join(named, keys, "left_anti"), keys, ranks).unionByName(_narrowed(rows.join(named, keys, "left_semi"), keys, large, ranks))


def quantiles(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, wanted: Mapping[str, tuple[float, str]], skip_nan: bool = False) -> DataFrame:
    """(keys, one column for each of `wanted`): exact quantiles, name to (q, method), by any of the 13 methods.

    NaN spreads, or is skipped; of a group of NaN alone it is the result. NULL is
    masked: a group without values has NULL.
    """

    def places(q: float, method: str) -> Callable[[Column], tuple[Column, Column, Column]]:
        if q <= 0:
            return lambda n: (F.lit(0), F.lit(0), F.lit(0.0))
        if q >= 1:
            return lambda n: (n - 1, n - 1, F.lit(0.0))
        return lambda n: METHODS[method](n, q)

    ranks: dict[str, Rank] = {}
    for name, (q, method) in wanted.items():
        for end in (0, 1):
            ranks[f"_{end}_{name}"] = lambda n, q=q, method=method, end=end: places(q, method)(n)[end].cast("long")
    found, n = at_ranks(df, keys, x, ranks), F.col("_n")

    def value(name: str, q: float, method: str) -> Column:
        low, high, share = F.col(f"_0_{name}"), F.col(f"_1_{name}"), places(q, method)(n)[2]
        plain = F.when(share == 0, low).otherwise(low + share * (high - low))
        some = F.when(n > 0, plain).when(F.col("_nan") > 0, NAN)
        return (some if skip_nan else F.when(F.col("_nan") > 0, NAN).otherwise(some)).alias(name)

    return found.select(*keys, *(value(name, *how) for name, how in wanted.items()))


def quantile(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, q: float, method: str = "linear", out: str = "value") -> DataFrame:
    return quantiles(df, keys, x, {out: (q, method)})


def percentile(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, q: float, method: str = "linear", out: str = "value") -> DataFrame:
    return quantile(df, keys, x, q / 100, method, out)


def median(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, out: str = "value") -> DataFrame:
    return quantile(df, keys, x, 0.5, out=out)


def nanquantile(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, q: float, method: str = "linear", out: str = "value") -> DataFrame:
    return quantiles(df, keys, x, {out: (q, method)}, skip_nan=True)


def nanpercentile(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, q: float, method: str = "linear", out: str = "value") -> DataFrame:
    return nanquantile(df, keys, x, q / 100, method, out)


def nanmedian(df: DataFrame, keys: Sequence[str], x: ColumnOrValue, out: str = "value") -> DataFrame:
    return nanquantile(df, keys, x, 0.5, out=out)
