"""Set operations, membership and distinct values, on columns of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.layout import ranked


def _one(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("x")).distinct()


def union1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return a.select(F.col(x).alias("x")).unionAll(b.select(F.col(y).alias("x"))).distinct()


def intersect1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _one(a, x).join(_one(b, y), "x", "left_semi")


def setdiff1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _one(a, x).join(_one(b, y), "x", "left_anti")


def setxor1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """One aggregation: values that exactly one side has."""
    both = a.select(F.col(x).alias("x"), F.lit(1).alias("s")).unionAll(b.select(F.col(y).alias("x"), F.lit(2).alias("s")))
    return both.groupBy("x").agg(F.bit_or("s").alias("s")).filter("s < 3").select("x")


def isin(a: DataFrame, x: str, b: DataFrame, y: str, out: str = "isin", invert: bool = False) -> DataFrame:
    """`a` with `out`: whether its value is among b's. b's distinct values are joined once each."""
    marks = b.select(F.col(y).alias("_y")).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return a.join(marks, a[x] == marks["_y"], "left").withColumn(out, ~hit if invert else hit).drop("_y", "_hit")


in1d = isin


def unique(df: DataFrame, column: str) -> DataFrame:
    return _one(df, column)


unique_values = unique


def unique_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("count"))


def unique_all(df: DataFrame, column: str, index: str) -> DataFrame:
    """(x, first index, count) of each distinct value, and its rank."""
    found = df.groupBy(F.col(column).alias("x")).agg(F.min(index).alias("index"), F.count("*").alias("count"))
    return ranked(found, ["x"], "rank")


def unique_inverse(df: DataFrame, column: str, index: str) -> DataFrame:
    """`df` with `inverse`: the rank of its value among the distinct ones."""
    ranks = unique_all(df, column, index).select(F.col("x").alias("_x"), F.col("rank").alias("inverse"))
    return df.join(ranks, df[column].eqNullSafe(ranks["_x"])).drop("_x")


def sort_values(df: DataFrame, *by: str, descending: bool = False) -> DataFrame:
    """A distributed sort: ranges of values by task."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in by))


def lexsort(df: DataFrame, keys: tuple[str, ...], index: str, out: str = "place") -> DataFrame:
    """`df` with its place in the order of the last key, then the one before, and so on, then the index."""
    return ranked(df, [*reversed(keys), index], out)


def partition_smallest(df: DataFrame, by: str, index: str, k: int) -> DataFrame:
    """The k smallest rows, by a bounded heap in each task."""
    return df.orderBy(F.col(by).asc_nulls_last(), index).limit(k)
