"""The .npy and .npz formats: files are read whole by Spark's binaryFile source and decoded in Arrow batches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, name string, shape array<long>, flat long, x double"
#: Cells of a file handed on at a time.
CELLS = 1_000_000


def encode(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def decode(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def _arrays(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                yield name.removesuffix(".npy"), decode(z.read(name))
    else:
        yield "arr_0", decode(data)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            for name, a in _arrays(bytes(data)):
                flat = a.ravel()
                for k in range(0, max(len(flat), 1), CELLS):
                    part = flat[k : k + CELLS]
                    yield pd.DataFrame({"path": path, "name": name, "shape": [list(a.shape)] * len(part), "flat": np.arange(k, k + len(part)), "x": part.astype(float)})


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, flat, x): all cells of the .npy and .npz files of a path, by flat position."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, _SCHEMA)


def frombuffer(df: DataFrame, column: str, dtype: str = "float64", offset: int = 0, count: int = -1) -> DataFrame:
    """`df` with `values`: the numbers in a binary column."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else np.frombuffer(bytes(b), dtype, count, offset).astype(float))

    return df.withColumn("values", run(column))


def raw(column: str):
    """An array column as bytes without a header: what `frombuffer` reads."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "float64").tobytes())

    return run(column)


def fromfile(spark: SparkSession, path: str, dtype: str = "float64") -> DataFrame:
    """(path, values) of raw binary files."""
    return frombuffer(spark.read.format("binaryFile").load(path).select("path", "content"), "content", dtype).select("path", "values")


def tobytes(df: DataFrame, column: str, dtype: str = "float64") -> DataFrame:
    """`df` with `data`: an array column as .npy bytes."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else encode(np.asarray(v, dtype)))

    return df.withColumn("data", run(column))


save = tobytes
