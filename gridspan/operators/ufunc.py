"""ufunc objects, and user functions over columns, lanes and arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.array import GridArray, where
from gridspan.functions import elementwise as E
from gridspan.operators import aggregate as A


@dataclass(frozen=True)
class ufunc:  # noqa: N801
    """An elementwise function; with `fold`, an aggregate of the same law, also a reduction."""

    name: str
    f: Callable[..., Column]
    nin: int = 1
    fold: Callable[[Column], Column] | None = None
    identity: float | None = None

    def __call__(self, *args, where_: GridArray | None = None, out: GridArray | None = None):
        """Of columns a column; of arrays an array, where `where_` holds (else from `out`)."""
        arrays = [a for a in args if isinstance(a, GridArray)]
        if not arrays:
            return self.f(*args)
        first = next(k for k, a in enumerate(args) if isinstance(a, GridArray))
        rest = [a for k, a in enumerate(args) if k != first]
        found = args[first].apply(lambda x, *more: self.f(*more[:first], x, *more[first:]), *rest)
        return found if where_ is None else where(where_, found, out if out is not None else 0.0)

    def _folded(self) -> Callable[[Column], Column]:
        if self.fold is None:
            raise TypeError(f"{self.name} has no reduction by an aggregate; use GridArray.reduce with one")
        return self.fold

    def reduce(self, a: GridArray, axis=0, keepdims: bool = False, where_: GridArray | None = None) -> GridArray:
        return (a if where_ is None else a.masked_where(~where_)).reduce(self._folded(), axis, keepdims)

    def accumulate(self, a: GridArray, axis: int = 0) -> GridArray:
        fold = {"add": F.sum, "multiply": F.product, "maximum": F.max, "minimum": F.min, "logical_and": F.min, "logical_or": F.max}[self.name]
        start = {"maximum": -np.inf, "minimum": np.inf}.get(self.name, self.identity)
        return a._running(axis, fold, lambda x, y: self.f(x, y).cast("double"), float(start))

    def outer(self, a: GridArray, b: GridArray) -> GridArray:
        return self(a.reshape(*a.shape, *[1] * b.ndim), b)

    def reduceat(self, a: GridArray, bounds, axis: int = 0) -> GridArray:
        return a.reduceat(self._folded(), bounds, axis)

    def at(self, a: GridArray, positions: GridArray, values: GridArray) -> GridArray:
        """Repeated positions take effect each time."""
        pairs = positions.df.withColumnRenamed("x", "_f").join(values.df.withColumnRenamed("x", "_new"), "i0")
        total = pairs.groupBy(F.col("_f").cast("long").alias("_f")).agg(self._folded()(F.col("_new")).alias("_s"))
        joined = a.df.withColumn("_f", a._flat()).join(total, "_f", "left")
        return GridArray(joined.select(*a.axes, F.when(F.col("_s").isNotNull(), self.f(F.col("x"), F.col("_s"))).otherwise(F.col("x")).alias("x")), a.shape)


_FOLDS = {"add": (A.sum_, 0.0), "multiply": (A.prod, 1.0), "maximum": (A.max_, None), "minimum": (A.min_, None), "logical_and": (A.all_, 1.0), "logical_or": (A.any_, 0.0)}
_BINARY = (
    "add subtract multiply divide true_divide floor_divide power float_power remainder mod fmod maximum minimum fmax fmin logical_and logical_or logical_xor bitwise_and bitwise_or "
    "bitwise_xor left_shift right_shift greater less equal not_equal greater_equal less_equal arctan2 hypot copysign ldexp heaviside nextafter gcd lcm logaddexp logaddexp2 divmod_"
).split()
_UNARY = (
    "sin cos tan arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh exp exp2 expm1 log log2 log10 log1p sqrt cbrt square reciprocal negative positive absolute fabs sign floor ceil "
    "rint trunc deg2rad rad2deg signbit logical_not isnan isinf isfinite bitwise_not bitwise_count modf frexp spacing"
).split()
UFUNCS = {n: ufunc(n.rstrip("_"), getattr(E, n), 2, *_FOLDS.get(n, ())) for n in _BINARY} | {n: ufunc(n, getattr(E, n)) for n in _UNARY}


def vectorize(f: Callable, kind: str = "double") -> Callable[..., Column]:
    """A Python function of scalars, run over Arrow batches; NULL arguments give NULL."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)])

    return lambda *c: run(*(F.col(x) if isinstance(x, str) else x for x in c))


frompyfunc = vectorize


def apply_along_axis(f: Callable[[np.ndarray], np.ndarray | float], axis: int, a: GridArray, size: int | None = None) -> GridArray:
    """f on each lane, lanes in parallel: to a number, or to an array of `size`."""
    axis = a._axis(axis)
    keys, n, i = a._keys(axis), a.shape[axis], f"i{axis}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lane = np.full(n, np.nan)
        lane[pdf[i].to_numpy()] = pdf["x"].to_numpy(float)
        found = np.atleast_1d(np.asarray(f(lane), float))
        return pd.DataFrame({k: np.full(len(found), pdf[k].iloc[0]) for k in keys} | {"_at": np.arange(len(found)), "x": found})

    schema = ", ".join([*(f"{k} long" for k in keys), "_at long", "x double"])
    grouped = a.df.groupBy(*keys) if keys else a.df.groupBy(F.lit(0).alias("_g"))
    found = grouped.applyInPandas(run, schema)
    names = [k for k in a.axes if k != i or size is not None]
    shape = [(size if k == axis else m) for k, m in enumerate(a.shape) if k != axis or size is not None]
    return GridArray(found.select(*(F.col("_at" if k == i else k).alias(f"n{j}") for j, k in enumerate(names)), "x").toDF(*(f"i{j}" for j in range(len(names))), "x"), shape)


def apply_over_axes(f: Callable[[GridArray, int], GridArray], a: GridArray, axes) -> GridArray:
    """f(array, axis) for one axis after the other, kept as size one."""
    for k in axes:
        found = f(a, k)
        a = found if found.ndim == a.ndim else found.expand_dims(k)
    return a


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function of whole groups, each of which fits a task."""
    return df.groupBy(*keys).applyInPandas(f, schema)
