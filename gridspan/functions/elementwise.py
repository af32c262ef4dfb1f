"""Elementwise math, predicates, comparisons, bits and complex-safe math, as column expressions.

Every function takes columns, names or constants and returns a column. Only the
special functions at the end leave the JVM, in Arrow batches.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import (
    INF,
    NAN,
    ColumnOrValue,
    ceil_double,
    col,
    double,
    either_nan,
    floor_div,
    floor_double,
    floor_mod,
    less_nan,
    negative_zero_sign,
    propagate,
    safe_div,
    safe_log,
    trunc_mod,
)

# Arithmetic


def add(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return col(a) + col(b)


def subtract(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return col(a) - col(b)


def multiply(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return col(a) * col(b)


def divide(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return safe_div(a, b)


true_divide = divide


def floor_divide(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return floor_div(a, b)


def remainder(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return floor_mod(a, b)


mod = remainder


def divmod_(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    """struct<quotient, remainder>."""
    return F.struct(floor_div(a, b).alias("quotient"), floor_mod(a, b).alias("remainder"))


def fmod(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return trunc_mod(a, b)


def negative(x: ColumnOrValue) -> Column:
    return -col(x)


def positive(x: ColumnOrValue) -> Column:
    return col(x)


def power(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return F.when((a == 0) & (b < 0), INF).otherwise(F.pow(a, b))


float_power = power


def square(x: ColumnOrValue) -> Column:
    return col(x) * col(x)


def reciprocal(x: ColumnOrValue) -> Column:
    return safe_div(1.0, x)


def abs_(x: ColumnOrValue) -> Column:
    return F.abs(col(x))


absolute = abs_


def fabs(x: ColumnOrValue) -> Column:
    return F.abs(double(x))


def sign(x: ColumnOrValue) -> Column:
    return F.when(F.isnan(double(x)), NAN).otherwise(F.signum(double(x)))


def gcd(a: ColumnOrValue, b: ColumnOrValue, steps: int = 93) -> Column:
    """Euclid's algorithm; 93 steps reach any pair of 64-bit integers."""
    start = F.struct(F.abs(col(a).cast("long")).alias("x"), F.abs(col(b).cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] != 0, s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["x"]


def lcm(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    g = gcd(a, b)
    x, y = F.abs(col(a).cast("long")), F.abs(col(b).cast("long"))
    return F.when((x == 0) | (y == 0), F.lit(0).cast("long")).otherwise(F.expr("0L") + (x / F.when(g != 0, g)).cast("long") * y)


# Exponentials and logarithms


def sqrt(x: ColumnOrValue) -> Column:
    return F.sqrt(double(x))


def cbrt(x: ColumnOrValue) -> Column:
    return F.cbrt(double(x))


def exp(x: ColumnOrValue) -> Column:
    return F.exp(double(x))


def exp2(x: ColumnOrValue) -> Column:
    return F.pow(F.lit(2.0), double(x))


def expm1(x: ColumnOrValue) -> Column:
    return F.expm1(double(x))


def log(x: ColumnOrValue) -> Column:
    return safe_log(x)


def log2(x: ColumnOrValue) -> Column:
    return safe_log(x, 2)


def log10(x: ColumnOrValue) -> Column:
    return safe_log(x, 10)


def log1p(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.when(x == -1, -INF).when((x < -1) | F.isnan(x), NAN).otherwise(F.log1p(F.when(x > -1, x)))


def logaddexp(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    high, low = F.greatest(a, b), F.least(a, b)
    return propagate(a, b, F.when(F.abs(high) == INF, high).otherwise(high + F.log1p(F.exp(low - high))))


def logaddexp2(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    high, low = F.greatest(a, b), F.least(a, b)
    return propagate(a, b, F.when(F.abs(high) == INF, high).otherwise(high + F.log1p(F.pow(F.lit(2.0), low - high)) / math.log(2)))


# Trigonometry


def sin(x: ColumnOrValue) -> Column:
    return F.sin(double(x))


def cos(x: ColumnOrValue) -> Column:
    return F.cos(double(x))


def tan(x: ColumnOrValue) -> Column:
    return F.tan(double(x))


def arcsin(x: ColumnOrValue) -> Column:
    return F.asin(double(x))


def arccos(x: ColumnOrValue) -> Column:
    return F.acos(double(x))


def arctan(x: ColumnOrValue) -> Column:
    return F.atan(double(x))


def arctan2(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return F.atan2(double(a), double(b))


def sinh(x: ColumnOrValue) -> Column:
    return F.sinh(double(x))


def cosh(x: ColumnOrValue) -> Column:
    return F.cosh(double(x))


def tanh(x: ColumnOrValue) -> Column:
    return F.tanh(double(x))


def arcsinh(x: ColumnOrValue) -> Column:
    return F.asinh(double(x))


def arccosh(x: ColumnOrValue) -> Column:
    return F.acosh(double(x))


def arctanh(x: ColumnOrValue) -> Column:
    return F.atanh(double(x))


def hypot(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return F.hypot(double(a), double(b))


def deg2rad(x: ColumnOrValue) -> Column:
    return double(x) * (math.pi / 180)


radians = deg2rad


def rad2deg(x: ColumnOrValue) -> Column:
    return double(x) * (180 / math.pi)


degrees = rad2deg


def sinc(x: ColumnOrValue) -> Column:
    y = double(x) * math.pi
    return F.when(y == 0, 1.0).otherwise(F.sin(y) / F.when(y != 0, y))


# Rounding and parts


def floor(x: ColumnOrValue) -> Column:
    return floor_double(double(x))


def ceil(x: ColumnOrValue) -> Column:
    return ceil_double(double(x))


def trunc(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.when(x < 0, ceil_double(x)).otherwise(floor_double(x))


fix = trunc


def rint(x: ColumnOrValue) -> Column:
    return F.rint(double(x))


def around(x: ColumnOrValue, decimals: int = 0) -> Column:
    """Half to even at the given decimal, by scaling, as the array contract has it."""
    if not decimals:
        return F.rint(double(x))
    scale = 10.0 ** abs(decimals)
    return F.rint(double(x) * scale) / scale if decimals > 0 else F.rint(double(x) / scale) * scale


round_ = around


def modf(x: ColumnOrValue) -> Column:
    """struct<fraction, whole>."""
    x = double(x)
    return F.struct(F.when(F.abs(x) == INF, F.lit(0.0)).otherwise(x - trunc(x)).alias("fraction"), trunc(x).alias("whole"))


def frexp(x: ColumnOrValue) -> Column:
    """struct<mantissa, exponent>: x = mantissa * 2^exponent, 0.5 <= |mantissa| < 1."""
    x = double(x)
    plain = (x == 0) | F.isnan(x) | (F.abs(x) == INF)
    guess = F.floor(F.log2(F.when(~plain, F.abs(x)))).cast("int") + 1
    m = F.abs(x) / F.pow(F.lit(2.0), guess)
    e = F.when(m >= 1, guess + 1).when(m < 0.5, guess - 1).otherwise(guess)
    half = F.floor(e / 2).cast("int")
    mantissa = x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half)
    return F.struct(F.when(plain, x).otherwise(mantissa).alias("mantissa"), F.when(plain, 0).otherwise(e).alias("exponent"))


def ldexp(x: ColumnOrValue, e: ColumnOrValue) -> Column:
    half = F.floor(col(e) / 2).cast("int")
    return double(x) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), col(e) - half)


def copysign(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return F.abs(double(a)) * F.when(signbit(b), -1.0).otherwise(1.0)


def signbit(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.when(F.isnan(x), False).otherwise((x < 0) | ((x == 0) & (negative_zero_sign(x) < 0)))


def heaviside(x: ColumnOrValue, at_zero: ColumnOrValue) -> Column:
    x = double(x)
    return F.when(F.isnan(x), NAN).when(x < 0, 0.0).when(x > 0, 1.0).otherwise(F.when(x == 0, double(at_zero)))


def clip(x: ColumnOrValue, low: ColumnOrValue | None = None, high: ColumnOrValue | None = None) -> Column:
    x = col(x)
    found = x
    if low is not None:
        found = F.greatest(found, col(low))
    if high is not None:
        found = F.least(found, col(high))
    return F.when(x.isNull(), None).when(F.isnan(x.cast("double")), x).otherwise(found)


def nan_to_num(x: ColumnOrValue, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    x, most = double(x), float(np.finfo(np.float64).max)
    return F.when(F.isnan(x), nan).when(x == INF, most if posinf is None else posinf).when(x == -INF, -most if neginf is None else neginf).otherwise(x)


def maximum(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return propagate(a, b, F.greatest(a, b))


def minimum(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return propagate(a, b, F.least(a, b))


def fmax(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return F.when(a.isNull() | b.isNull(), None).when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.least(a, b))


# Complex numbers: struct<re, im>


def complex_(re: ColumnOrValue, im: ColumnOrValue = 0.0) -> Column:
    return F.struct(double(re).alias("re"), double(im).alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


conjugate = conj


def angle(z: Column, deg: bool = False) -> Column:
    found = F.atan2(z["im"], z["re"])
    return found * (180 / math.pi) if deg else found


def complex_abs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_subtract(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_divide(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_(safe_div(a["re"] * b["re"] + a["im"] * b["im"], n), safe_div(a["im"] * b["re"] - a["re"] * b["im"], n))


def complex_exp(z: Column) -> Column:
    return complex_(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def complex_log(z: Column) -> Column:
    return complex_(safe_log(complex_abs(z)), angle(z))


def complex_sqrt(z: Column) -> Column:
    r = complex_abs(z)
    im = F.sqrt(F.greatest((r - z["re"]) / 2, F.lit(0.0)))
    return complex_(F.sqrt(F.greatest((r + z["re"]) / 2, F.lit(0.0))), F.when(z["im"] < 0, -im).otherwise(im))


def real_if_close(z: Column, tol: float = 100.0) -> Column:
    """The struct with its imaginary part dropped (0) if that is within tol machine epsilons."""
    return F.when(F.abs(z["im"]) < tol * float(np.finfo(np.float64).eps), complex_(z["re"])).otherwise(z)


# scimath: results leave the real line where the plain function is undefined


def scimath_sqrt(x: ColumnOrValue) -> Column:
    x = double(x)
    return F.when(x < 0, complex_(0.0, F.sqrt(F.abs(x)))).otherwise(complex_(F.sqrt(F.abs(x)), 0.0))


def scimath_log(x: ColumnOrValue) -> Column:
    x = double(x)
    return complex_(safe_log(F.abs(x)), F.when(x < 0, math.pi).otherwise(0.0))


def scimath_log2(x: ColumnOrValue) -> Column:
    z = scimath_log(x)
    return complex_(safe_log(F.abs(double(x)), 2), z["im"] / math.log(2))


def scimath_log10(x: ColumnOrValue) -> Column:
    z = scimath_log(x)
    return complex_(safe_log(F.abs(double(x)), 10), z["im"] / math.log(10))


def scimath_power(x: ColumnOrValue, p: ColumnOrValue) -> Column:
    x, p = double(x), double(p)
    r, t = F.pow(F.abs(x), p), F.when(x < 0, math.pi).otherwise(0.0) * p
    whole = p == floor_double(p)
    return F.when(whole, complex_(power(x, p), 0.0)).otherwise(complex_(r * F.cos(t), r * F.sin(t)))


def scimath_arccos(x: ColumnOrValue) -> Column:
    x = double(x)
    out = F.acosh(F.abs(F.when(F.abs(x) > 1, x)))
    return F.when(x > 1, complex_(0.0, out)).when(x < -1, complex_(math.pi, -out)).otherwise(complex_(F.acos(x), 0.0))


def scimath_arcsin(x: ColumnOrValue) -> Column:
    z = scimath_arccos(x)
    return complex_(math.pi / 2 - z["re"], -z["im"])


# Predicates and comparisons


def isnan(x: ColumnOrValue) -> Column:
    return F.isnan(double(x))


def isinf(x: ColumnOrValue) -> Column:
    return F.abs(double(x)) == INF


def isfinite(x: ColumnOrValue) -> Column:
    x = double(x)
    return ~F.isnan(x) & (F.abs(x) != INF)


def isposinf(x: ColumnOrValue) -> Column:
    return double(x) == INF


def isneginf(x: ColumnOrValue) -> Column:
    return double(x) == -INF


def isreal(z: Column) -> Column:
    return z["im"] == 0


def iscomplex(z: Column) -> Column:
    return z["im"] != 0


def equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return ~either_nan(a, b) & (a == b)


def not_equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return ~equal(a, b)


def less(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return less_nan(double(a), double(b))


def greater(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return less_nan(double(b), double(a))


def less_equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    a, b = double(a), double(b)
    return ~either_nan(a, b) & (a <= b)


def greater_equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return less_equal(b, a)


def isclose(a: ColumnOrValue, b: ColumnOrValue, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = double(a), double(b)
    near = F.when(isfinite(a) & isfinite(b), F.abs(a - b) <= atol + rtol * F.abs(b)).otherwise(equal(a, b))
    return near | (F.isnan(a) & F.isnan(b)) if equal_nan else near


# Bits and logic


def bitwise_and(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return col(a).bitwiseAND(col(b))


def bitwise_or(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return col(a).bitwiseXOR(col(b))


def bitwise_not(x: ColumnOrValue) -> Column:
    return F.bitwise_not(col(x))


invert = bitwise_not


def bitwise_count(x: ColumnOrValue) -> Column:
    """Ones of the absolute value, as the array contract counts negative numbers."""
    return F.bit_count(F.abs(col(x)))


def left_shift(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    """Zero from 64 places on, where Spark would wrap the count."""
    n = col(b).cast("int")
    return F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", col(a).cast("long"), n))


def right_shift(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return F.call_function("shiftright", col(a).cast("long"), F.least(col(b).cast("int"), F.lit(63)))


def truth(x: ColumnOrValue) -> Column:
    """Non-zero; NaN counts as true."""
    x = double(x)
    return F.isnan(x) | (x != 0)


def logical_and(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return truth(a) & truth(b)


def logical_or(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return truth(a) | truth(b)


def logical_xor(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return truth(a) != truth(b)


def logical_not(x: ColumnOrValue) -> Column:
    return ~truth(x)


def binary_repr(x: ColumnOrValue, width: int | None = None) -> Column:
    """Binary digits: two's complement if a width is given and x is negative, else with a sign."""
    n = col(x).cast("long")
    plain = F.bin(F.abs(n))
    if width is None:
        return F.when(n < 0, F.concat(F.lit("-"), plain)).otherwise(plain)
    wide = F.when(F.length(plain) < width, F.lpad(plain, width, "0")).otherwise(plain)
    return F.when(n < 0, F.substring(F.bin(n), 64 - width + 1, width)).otherwise(wide)


def base_repr(x: ColumnOrValue, base: int = 2, padding: int = 0) -> Column:
    n = col(x).cast("long")
    digits = F.conv(F.abs(n).cast("string"), 10, base)
    padded = F.concat(F.lit("0" * padding), digits)
    return F.when(n < 0, F.concat(F.lit("-"), padded)).otherwise(F.when(n == 0, F.lit("0" * max(padding, 1))).otherwise(padded))


def packbits(bits: Column) -> Column:
    """array of 0/1 to array of bytes (as ints), most significant bit first, the last padded with zeros."""
    n = F.ceil(F.size(bits) / 8).cast("int")
    one = lambda k: F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda acc, j: acc * 2 + F.coalesce((F.try_element_at(bits, k * 8 + j) != 0).cast("int"), F.lit(0))
    )
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k < n), one)


def unpackbits(data: Column) -> Column:
    """array of bytes (as ints) to array of 0/1, most significant bit first."""
    each = lambda x: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda j: F.floor(x / F.pow(F.lit(2.0), j)).cast("int") % 2)
    return F.flatten(F.transform(data, each))


# Special functions: numpy over Arrow batches


def _special(f):
    def run(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(f(x.to_numpy(float)))

    def apply(x: ColumnOrValue) -> Column:
        # Arrow turns pandas' NaN into NULL; NULL goes in as NaN and comes out as NULL.
        return F.when(double(x).isNotNull(), F.coalesce(F.pandas_udf(run, "double")(F.coalesce(double(x), F.lit(NAN))), F.lit(NAN)))

    return apply


_vector = lambda f: lambda x: np.fromiter((f(v) for v in x), float, len(x))


def _guarded(f, invalid=NAN, over=INF):
    def run(v: float) -> float:
        if v != v:
            return NAN
        try:
            return f(v)
        except OverflowError:
            return over
        except ValueError:
            return invalid

    return run


gamma = _special(_vector(_guarded(math.gamma)))
lgamma = _special(_vector(_guarded(math.lgamma, INF)))
erf = _special(_vector(math.erf))
erfc = _special(_vector(math.erfc))
i0 = _special(np.i0)


_gauss = functools.cache(np.polynomial.legendre.leggauss)
#: Arguments whose integrands stand in memory at a time.
_AT_ONCE = 64


def bessel(kind: str, order: int, x: np.ndarray, points: int = 2000) -> np.ndarray:
    """J or Y of order 0 or 1 from their integral representations.

    J by the periodic midpoint rule, exact to rounding for |x| < points; Y by
    its first integral in the same way and its second on a fixed grid. A few
    arguments at a time, so that memory doesn't follow the length of x.
    """
    t = (np.arange(points) + 0.5) * (math.pi / points)
    x = np.asarray(x, float)
    if x.size > _AT_ONCE:
        return np.concatenate([bessel(kind, order, x[k : k + _AT_ONCE], points) for k in range(0, x.size, _AT_ONCE)])
    if kind == "j":
        return np.cos(order * t[:, None] - np.abs(x) * np.sin(t)[:, None]).mean(0) * np.where((x < 0) & (order == 1), -1, 1)
    nodes, weights = _gauss(400)
    a, wa = (nodes + 1) * (math.pi / 2), weights * (math.pi / 2)
    ok = np.where(x > 0, x, 1.0)
    first = (np.sin(ok * np.sin(a)[:, None] - order * a[:, None]) * wa[:, None]).sum(0) / math.pi
    # The second integrand falls as exp(-x sinh t): in s = x sinh t it is smooth up to a logarithmic end.
    top = np.arcsinh(40.0 / ok)
    s = (nodes[:, None] + 1) / 2 * top
    growth = np.exp(order * s) + (-1) ** order * np.exp(-order * s)
    second = (growth * np.exp(-ok * np.sinh(s)) * weights[:, None] / 2 * top).sum(0) / math.pi
    return np.where(x > 0, first - second, np.where(x == 0, -INF, NAN))


j0 = _special(lambda x: bessel("j", 0, x))
j1 = _special(lambda x: bessel("j", 1, x))
y0 = _special(lambda x: bessel("y", 0, x))
y1 = _special(lambda x: bessel("y", 1, x))
spacing = _special(np.spacing)


def nextafter(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))

    a, b = double(a), double(b)
    none = F.lit(NAN)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.pandas_udf(run, "double")(F.coalesce(a, none), F.coalesce(b, none)), none))
