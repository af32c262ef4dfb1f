"""Delimited text, by Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.array import GridArray
from gridspan.functions.semantics import NAN


def _cells(spark: SparkSession, path: str, comments: str | None, delimiter: str | None, skip: int, skip_footer: int, max_rows: int | None) -> DataFrame:
    """(row, cells): lines with content, numbered in file order.

    Only positions within a file are needed, so a line's number is its place in
    its task plus the lines of the tasks before: two light passes, no sort.
    """
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    text = F.col("value")
    if comments:
        text = F.regexp_replace(text, "\\Q" + comments + "\\E.*", "")
    text = F.trim(text) if delimiter is None else text
    cut = F.split(text, r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E", -1)
    kept = lines.select((F.col("_id") / (1 << 33)).cast("long").alias("_task"), "_id", text.alias("_t"), cut.alias("cells"), F.lit(skip).alias("_skip"))
    from pyspark.sql import Window

    every = kept.groupBy("_task").agg(F.count("*").alias("_n"))
    before = every.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    line = F.col("_b") + F.pmod(F.col("_id"), F.lit(1 << 33))
    numbered = kept.join(F.broadcast(before), "_task").withColumn("_line", line)
    content = numbered.filter((F.col("_line") >= skip) & (F.col("_line") < F.col("_all") - skip_footer) & (F.trim("_t") != ""))
    full = content.groupBy("_task").agg(F.count("*").alias("_n"))
    base = full.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_task").orderBy("_id")) - 1
    rows = content.select("_task", "cells", inner.alias("_k")).join(F.broadcast(base), "_task").select((F.col("_base") + F.col("_k")).cast("long").alias("row"), "cells")
    return rows if max_rows is None else rows.filter(F.col("row") < max_rows)


def genfromtxt(
    spark: SparkSession, path: str, delimiter: str | None = None, comments: str | None = "#", skip_header: int = 0, skip_footer: int = 0, max_rows: int | None = None,
    usecols: Sequence[int] | None = None, missing_values: Sequence[str] = (), filling_values: float = NAN,
) -> GridArray:
    """A matrix; what is no number, or listed as missing, becomes the filling value."""
    rows = _cells(spark, path, comments, delimiter, skip_header, skip_footer, max_rows)
    number = lambda c: F.when(F.trim(c).isin(list(missing_values)), None).otherwise(F.trim(c).try_cast("double")) if missing_values else F.trim(c).try_cast("double")
    return _matrix(rows, usecols, lambda c: F.coalesce(number(c), F.lit(filling_values)))


def loadtxt(
    spark: SparkSession, path: str, comments: str | None = "#", delimiter: str | None = None, skiprows: int = 0, usecols: Sequence[int] | None = None, max_rows: int | None = None, dtype: str = "double", unpack: bool = False,
) -> GridArray:
    """A matrix; what is no number is an error."""
    a = _matrix(_cells(spark, path, comments, delimiter, skiprows, 0, max_rows), usecols, lambda c: F.trim(c).cast(dtype))
    return a.T if unpack else a


def _matrix(rows: DataFrame, usecols: Sequence[int] | None, number) -> GridArray:
    if usecols is not None:
        rows = rows.withColumn("cells", F.array(*(F.element_at("cells", k + 1) for k in usecols)))
    n, wide = rows.agg(F.count("*"), F.max(F.size("cells"))).first()
    cells = rows.select(F.col("row").alias("i0"), F.posexplode("cells").alias("i1", "c"))
    return GridArray(cells.select("i0", F.col("i1").cast("long").alias("i1"), number(F.col("c")).alias("x")), [n, wide or 0])


def fromstring(spark: SparkSession, text: str, sep: str = " ") -> GridArray:
    from gridspan.array import array

    parts = text.split() if sep.strip() == "" else text.split(sep)
    return array(spark, [float(p) for p in parts if p.strip()])


def savetxt(df: DataFrame, columns: Sequence[str | Column], path: str, fmt: str = "%.18e", delimiter: str = " ", header: str = "", comments: str = "# ", order: str | None = None) -> None:
    """One line a row, in the order of `order` within the files' order. The header begins every file."""
    cells = [F.format_string(fmt, F.col(c) if isinstance(c, str) else c) for c in columns]
    rows = df.orderBy(order) if order else df
    lines = rows.select(F.concat_ws(delimiter, *cells).alias("value"))
    if header:
        lines = lines.mapInPandas(_headed(f"{comments}{header}"), "value string")
    lines.write.text(path)


def _headed(line: str):
    def run(batches):
        began = False
        for pdf in batches:
            if not began and len(pdf):
                yield pd.DataFrame({"value": [line]})
                began = True
            yield pdf

    return run


def save_table(df: DataFrame, path: str, compressed: bool = True) -> None:
    """The native sink."""
    df.write.option("compression", "zstd" if compressed else "none").parquet(path)


def savez(path: str, compressed: bool = False, **frames: DataFrame) -> None:
    """A folder with one Parquet table for each name."""
    for name, df in frames.items():
        save_table(df, f"{path}/{name}", compressed)


def savez_compressed(path: str, **frames: DataFrame) -> None:
    savez(path, True, **frames)


class NpzFile:
    """The tables of such a folder by name, read when asked for; `f` gives them as attributes."""

    def __init__(self, spark: SparkSession, path: str, names: Sequence[str]):
        self.spark, self.path, self.files = spark, path, list(names)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.files:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __iter__(self):
        return iter(self.files)

    def __len__(self) -> int:
        return len(self.files)

    def __contains__(self, name: str) -> bool:
        return name in self.files

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.__dict__.get("files", ()):
            return self[name]
        raise AttributeError(name)


BagObj = NpzFile
