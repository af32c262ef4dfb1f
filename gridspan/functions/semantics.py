"""Where Spark's arithmetic and array arithmetic part: one place for the differences.

Spark raises on division by zero (ANSI mode) or gives NULL, takes NaN as the
largest and as equal to itself, and lets `min` and `least` skip it. Array
arithmetic gives inf or NaN, NaN compares unequal to everything, and spreads.
NULL always means masked and always spreads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
ColumnOrValue = Column | float | int | bool | str


def col(x: ColumnOrValue) -> Column:
    """A column: as it is, of that name, or of that constant."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def double(x: ColumnOrValue) -> Column:
    return col(x).cast("double")


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def safe_div(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    """a / b with x/0 = inf of its sign, 0/0 = NaN; the zero's sign counts."""
    a, b = double(a), double(b)
    zero = F.when((a == 0) | F.isnan(a), NAN).otherwise(F.signum(a) * negative_zero_sign(b) * INF)
    # a * (1 / b) would round twice; the guard keeps ANSI mode from raising.
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def negative_zero_sign(x: Column) -> Column:
    """-1.0 for -0.0, else 1.0. Only text tells the two zeros apart."""
    return F.when(x.cast("string").startswith("-"), -1.0).otherwise(1.0)


def floor_div(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    """floor(a / b) as a double, -1 for a negative quotient too small to tell from 0; of a zero divisor as safe_div."""
    a, b = double(a), double(b)
    found = floor_double(safe_div(a, b))
    return F.when((found == 0) & (a != 0) & ((a < 0) != (b < 0)), -1.0).otherwise(found)


def floor_double(x: Column) -> Column:
    """floor that stays a double, so that inf, NaN and values beyond 2^63 keep."""
    big = F.isnan(x) | (F.abs(x) >= 2.0**52)
    return F.when(big, x).otherwise(F.floor(F.when(~big, x)).cast("double"))


def ceil_double(x: Column) -> Column:
    return -floor_double(-x)


def floor_mod(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    """The remainder with the divisor's sign; NaN for a zero divisor."""
    a, b = double(a), double(b)
    r = F.when(b != 0, a % F.when(b != 0, b))
    r = F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
    r = F.when(F.abs(b) == INF, F.when((a == 0) | ((a < 0) == (b < 0)), a).otherwise(b)).otherwise(r)
    return F.when(a.isNull() | b.isNull(), None).when((b == 0) | (F.abs(a) == INF) | either_nan(a, b), NAN).otherwise(r)


def trunc_mod(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    """The remainder with the dividend's sign; NaN for a zero divisor."""
    a, b = double(a), double(b)
    r = F.when(F.abs(b) == INF, a).otherwise(a % F.when(b != 0, b))
    return F.when(a.isNull() | b.isNull(), None).when((b == 0) | (F.abs(a) == INF) | either_nan(a, b), NAN).otherwise(r)


def safe_log(x: ColumnOrValue, base: float | None = None) -> Column:
    """log with log(0) = -inf and NaN below: Spark gives NULL for both."""
    x = double(x)
    ok = F.when(x > 0, x)
    value = F.log(ok) if base is None else F.log2(ok) if base == 2 else F.log10(ok) if base == 10 else F.log(ok) / math.log(base)
    return F.when(x == 0, -INF).when(x < 0, NAN).when(F.isnan(x), NAN).otherwise(value)


def less_nan(a: Column, b: Column) -> Column:
    """a < b; false with NaN, where Spark takes NaN for the largest."""
    return ~either_nan(a, b) & (a < b)


def propagate(a: Column, b: Column, value: Column) -> Column:
    """`value`, or NaN where a or b is, or NULL."""
    return F.when(a.isNull() | b.isNull(), None).when(either_nan(a, b), NAN).otherwise(value)
