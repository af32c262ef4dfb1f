"""Aggregates with array semantics: plain (NaN spreads), nan* (NaN is skipped) and masked (NULL is skipped).

Every function returns an aggregate Column for `groupBy(...).agg(...)`, so any
number of them share one pass and one shuffle, with partial aggregation. NULL
is masked and skipped by all forms. Quantiles are in `selection`: they are no
sums of parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspan.functions.semantics import NAN, ColumnOrValue, double, safe_div


def _any_nan(x: Column) -> Column:
    return F.coalesce(F.max(F.isnan(x)), F.lit(False))


def _skip(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sum_(x: ColumnOrValue) -> Column:
    return F.coalesce(F.sum(double(x)), F.lit(0.0))


def prod(x: ColumnOrValue) -> Column:
    return F.coalesce(F.product(double(x)), F.lit(1.0))


def mean(x: ColumnOrValue) -> Column:
    return F.avg(double(x))


def var(x: ColumnOrValue, ddof: int = 0) -> Column:
    """Two-pass accuracy from Spark's own running moments; NaN for n <= ddof."""
    x = double(x)
    n = F.count(x)
    scaled = F.var_pop(x) * safe_div(n, n - ddof) if ddof else F.var_pop(x)
    return F.when(n > ddof, scaled).when(n > 0, NAN)


def std(x: ColumnOrValue, ddof: int = 0) -> Column:
    return F.sqrt(var(x, ddof))


def max_(x: ColumnOrValue) -> Column:
    """Spark takes NaN for the largest, which is what spreads it."""
    return F.max(double(x))


def min_(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.when(_any_nan(x), NAN).otherwise(F.min(x))


amax, amin = max_, min_


def ptp(x: ColumnOrValue) -> Column:
    return max_(x) - min_(x)


def argmax(x: ColumnOrValue, index: ColumnOrValue) -> Column:
    """The first index of the largest value; the first NaN if there is one."""
    x, i = double(x), F.col(index) if isinstance(index, str) else index
    return F.min_by(i, F.when(x.isNotNull(), F.struct((~F.isnan(x)).alias("a"), F.when(~F.isnan(x), -x).alias("b"), i.alias("c"))))


def argmin(x: ColumnOrValue, index: ColumnOrValue) -> Column:
    x, i = double(x), F.col(index) if isinstance(index, str) else index
    return F.min_by(i, F.when(x.isNotNull(), F.struct((~F.isnan(x)).alias("a"), F.when(~F.isnan(x), x).alias("b"), i.alias("c"))))


def all_(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.coalesce(F.min(F.isnan(x) | (x != 0)), F.lit(True))


def any_(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.coalesce(F.max(F.isnan(x) | (x != 0)), F.lit(False))


def count_nonzero(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.count(F.when(F.isnan(x) | (x != 0), 1))


def average(x: ColumnOrValue, weights: ColumnOrValue) -> Column:
    x, w = double(x), double(weights)
    return safe_div(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def nansum(x: ColumnOrValue) -> Column:
    return sum_(_skip(double(x)))


def nanprod(x: ColumnOrValue) -> Column:
    return prod(_skip(double(x)))


def _of_any(x: Column, found: Column) -> Column:
    """NaN where there are values but all are NaN."""
    return F.when(F.count(_skip(x)) > 0, found).when(F.count(x) > 0, NAN)


def nanmean(x: ColumnOrValue) -> Column:
    x = double(x)
    return _of_any(x, F.avg(_skip(x)))


def nanvar(x: ColumnOrValue, ddof: int = 0) -> Column:
    x = double(x)
    return _of_any(x, var(_skip(x), ddof))


def nanstd(x: ColumnOrValue, ddof: int = 0) -> Column:
    return F.sqrt(nanvar(x, ddof))


def nanmax(x: ColumnOrValue) -> Column:
    x = double(x)
    return _of_any(x, F.max(_skip(x)))


def nanmin(x: ColumnOrValue) -> Column:
    x = double(x)
    return _of_any(x, F.min(_skip(x)))


def nanargmax(x: ColumnOrValue, index: ColumnOrValue) -> Column:
    return argmax(_skip(double(x)), index)


def nanargmin(x: ColumnOrValue, index: ColumnOrValue) -> Column:
    return argmin(_skip(double(x)), index)


def cov(x: ColumnOrValue, y: ColumnOrValue, ddof: int = 1, fweights: ColumnOrValue | None = None, aweights: ColumnOrValue | None = None) -> Column:
    x, y = double(x), double(y)
    if fweights is None and aweights is None:
        return F.covar_samp(x, y) if ddof == 1 else F.covar_pop(x, y) * safe_div(F.count(x), F.count(x) - ddof)
    f = double(1.0 if fweights is None else fweights)
    w = f if aweights is None else f * double(aweights)
    total = F.sum(w)
    fact = total - (ddof * F.sum(w * (double(aweights) if aweights is not None else 1.0)) / total)
    return (F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / total) / fact


def corrcoef(x: ColumnOrValue, y: ColumnOrValue) -> Column:
    return F.corr(double(x), double(y))


#: Place of the q-quantile in n sorted values, 0-based: a pair of columns (low, high) and the share of high.
METHODS: dict[str, Callable[[Column, float], tuple[Column, Column, Column]]] = {}


def _between(h: Column, n: Column) -> tuple[Column, Column, Column]:
    h = F.least(F.greatest(h, F.lit(0.0)), n - 1.0)
    low = F.floor(h)
    return low, F.ceil(h), h - low


def _single(k: Column, n: Column) -> tuple[Column, Column, Column]:
    k = F.least(F.greatest(k, F.lit(0)), n - 1)
    return k, k, F.lit(0.0)


METHODS.update(
    linear=lambda n, q: _between(q * (n - 1), n),
    interpolated_inverted_cdf=lambda n, q: _between(q * n - 1, n),
    hazen=lambda n, q: _between(q * n - 0.5, n),
    weibull=lambda n, q: _between(q * (n + 1) - 1, n),
    median_unbiased=lambda n, q: _between(q * (n + 1 / 3) + 1 / 3 - 1, n),
    normal_unbiased=lambda n, q: _between(q * (n + 0.25) + 0.375 - 1, n),
    lower=lambda n, q: _single(F.floor(q * (n - 1)), n),
    higher=lambda n, q: _single(F.ceil(q * (n - 1)), n),
    midpoint=lambda n, q: (F.floor(q * (n - 1)), F.ceil(q * (n - 1)), F.lit(0.5)),
    nearest=lambda n, q: _single(F.rint(q * (n - 1)).cast("long"), n),
    inverted_cdf=lambda n, q: _single(F.ceil(q * n) - 1, n),
    averaged_inverted_cdf=lambda n, q: (
        F.greatest(F.ceil(q * n) - 1, F.lit(0)),
        F.least(F.floor(q * n), n - 1),
        F.when(q * n == F.floor(q * n), 0.5).otherwise(0.0),
    ),
    closest_observation=lambda n, q: _single(F.rint(q * n).cast("long") - 1, n),
)
