"""Masked arrays: a NULL cell is masked. Aggregates skip NULL and expressions spread it, so most operations are the plain ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan import array as G
from gridspan.array import GridArray
from gridspan.functions import elementwise as E
from gridspan.functions.semantics import NAN
from gridspan.operators import aggregate as A
from gridspan.operators import linalg

MaskedArray = masked_array = GridArray


def masked() -> Column:
    """The masked constant."""
    return F.lit(None)


#: What fills masked cells by default, by type (fixed values of the array contract).
FILL = {"boolean": True, "tinyint": 63, "smallint": 999999, "int": 999999, "bigint": 999999, "float": 1e20, "double": 1e20, "string": "N/A"}


def default_fill_value(a: GridArray):
    return FILL.get(a.dtype)


def maximum_fill_value(a: GridArray):
    """Never the least: what fills before a minimum's search for the largest."""
    return float("-inf") if a.dtype in ("float", "double") else -(1 << 63)


def minimum_fill_value(a: GridArray):
    return float("inf") if a.dtype in ("float", "double") else (1 << 63) - 1


def common_fill_value(a: GridArray, b: GridArray):
    return default_fill_value(a) if default_fill_value(a) == default_fill_value(b) else None


def array(a: GridArray, mask: GridArray | None = None) -> GridArray:
    return a if mask is None else a.masked_where(mask)


def masked_where(condition: GridArray, a: GridArray) -> GridArray:
    return a.masked_where(condition)


def _mask_if(test: Callable[[Column], Column]) -> Callable[[GridArray], GridArray]:
    return lambda a: a.apply(lambda x: F.when(~test(x), x))


def masked_equal(a, v):
    return _mask_if(lambda x: E.equal(x, v))(a)


def masked_not_equal(a, v):
    return _mask_if(lambda x: E.not_equal(x, v))(a)


def masked_greater(a, v):
    return _mask_if(lambda x: E.greater(x, v))(a)


def masked_greater_equal(a, v):
    return _mask_if(lambda x: E.greater_equal(x, v))(a)


def masked_less(a, v):
    return _mask_if(lambda x: E.less(x, v))(a)


def masked_less_equal(a, v):
    return _mask_if(lambda x: E.less_equal(x, v))(a)


def masked_inside(a, low, high):
    low, high = min(low, high), max(low, high)
    return _mask_if(lambda x: E.greater_equal(x, low) & E.less_equal(x, high))(a)


def masked_outside(a, low, high):
    low, high = min(low, high), max(low, high)
    return _mask_if(lambda x: E.less(x, low) | E.greater(x, high))(a)


def masked_invalid(a):
    return _mask_if(lambda x: ~E.isfinite(x))(a)


fix_invalid = masked_invalid


def masked_values(a, v, rtol: float = 1e-5, atol: float = 1e-8):
    return _mask_if(lambda x: E.isclose(x, v, rtol, atol))(a)


def masked_object(a, v):
    return _mask_if(lambda x: x == v)(a)


def masked_all(spark, shape) -> GridArray:
    return G.fromfunction(spark, lambda *_: F.lit(None).cast("double"), shape)


def masked_all_like(a: GridArray) -> GridArray:
    return GridArray(a.df.withColumn("x", F.lit(None).cast(a.dtype)), a.shape)


def is_masked(a: GridArray) -> bool:
    return a.df.filter("x is null").limit(1).count() > 0


def getmask(a: GridArray) -> GridArray:
    return a.mask()


getmaskarray = make_mask = getmask


def make_mask_none(spark, shape) -> GridArray:
    return G.full(spark, shape, False)


def mask_or(a: GridArray, b: GridArray) -> GridArray:
    return a.apply(E.logical_or, b) if a.dtype != "boolean" else a.apply(lambda x, y: x | y, b)


def getdata(a: GridArray) -> GridArray:
    """Masked cells keep no data here; they come back as the default fill."""
    return a.filled(default_fill_value(a))


def filled(a: GridArray, value=None) -> GridArray:
    return a.filled(getattr(a, "fill_value", default_fill_value(a)) if value is None else value)


def compressed(a: GridArray) -> GridArray:
    return a.compressed()


def count(a: GridArray, axis=None) -> GridArray:
    return a.count(axis)


def count_masked(a: GridArray, axis=None) -> GridArray:
    return a.reduce(lambda x: F.count(F.when(x.isNull(), 1)), axis)


def _domain(f: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Callable[[GridArray], GridArray]:
    return lambda a: a.apply(lambda x: F.when(ok(x.cast("double")), f(x)))


# Outside its domain a function masks.
log = _domain(E.log, lambda x: x > 0)
log2 = _domain(E.log2, lambda x: x > 0)
log10 = _domain(E.log10, lambda x: x > 0)
sqrt = _domain(E.sqrt, lambda x: x >= 0)
arcsin = _domain(E.arcsin, lambda x: F.abs(x) <= 1)
arccos = _domain(E.arccos, lambda x: F.abs(x) <= 1)
arccosh = _domain(E.arccosh, lambda x: x >= 1)
arctanh = _domain(E.arctanh, lambda x: F.abs(x) < 1)
tan = _domain(E.tan, lambda x: F.abs(F.cos(x)) > 1e-35)


def _plain(f: Callable[..., Column]) -> Callable[..., GridArray]:
    return lambda a, *b: a.apply(f, *b)


exp, absolute, fabs, negative, sin, cos, arctan, sinh, cosh, tanh, arcsinh, floor, ceil, logical_not = map(
    _plain, (E.exp, E.abs_, E.fabs, E.negative, E.sin, E.cos, E.arctan, E.sinh, E.cosh, E.tanh, E.arcsinh, E.floor, E.ceil, E.logical_not)
)
add, subtract, multiply, hypot, arctan2, maximum, minimum = map(_plain, (E.add, E.subtract, E.multiply, E.hypot, E.arctan2, E.maximum, E.minimum))
equal, not_equal, greater, greater_equal, less, less_equal = map(_plain, (E.equal, E.not_equal, E.greater, E.greater_equal, E.less, E.less_equal))
logical_and, logical_or, logical_xor, bitwise_and, bitwise_or, bitwise_xor = map(_plain, (E.logical_and, E.logical_or, E.logical_xor, E.bitwise_and, E.bitwise_or, E.bitwise_xor))
left_shift, right_shift = _plain(E.left_shift), _plain(E.right_shift)


def _by_zero(f: Callable[[Column, Column], Column]) -> Callable[..., GridArray]:
    """Division by zero masks."""
    return lambda a, b: a.apply(lambda x, y: F.when(y.cast("double") != 0, f(x, y)), b)


divide, true_divide, floor_divide, remainder, mod, fmod = map(_by_zero, (E.divide, E.divide, E.floor_divide, E.remainder, E.remainder, E.fmod))


def power(a, b):
    """What is not finite masks."""
    return a.apply(lambda x, y: F.when(E.isfinite(E.power(x, y)), E.power(x, y)), b)


def around(a, decimals: int = 0):
    return a.round(decimals)


round_ = around


def _over(name: str) -> Callable[..., GridArray]:
    return lambda a, axis=None, **k: getattr(a, name)(axis, **k)


sum_, prod, mean, var, std, min_, max_, ptp, all_, any_, median, argmin, argmax = map(_over, ("sum", "prod", "mean", "var", "std", "min", "max", "ptp", "all", "any", "median", "argmin", "argmax"))
cumsum, cumprod, anom, sort, argsort = map(_over, ("cumsum", "cumprod", "anom", "sort", "argsort"))


def average(a: GridArray, weights: GridArray | None = None, axis=None) -> GridArray:
    if weights is None:
        return a.mean(axis)
    return (a * weights).sum(axis) / weights.apply(lambda w, x: F.when(x.isNotNull(), w), a).sum(axis)


def allequal(a: GridArray, b: GridArray, fill_value: bool = True) -> bool:
    """Masked cells count as equal, or not."""
    bad = a.apply(lambda x, y: F.coalesce(E.not_equal(x, y), F.lit(not fill_value)), b)
    return not bad.df.filter("x").limit(1).count()


def allclose(a: GridArray, b: GridArray, masked_equal: bool = True, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    bad = a.apply(lambda x, y: F.coalesce(~E.isclose(x, y, rtol, atol), F.lit(not masked_equal)), b)
    return not bad.df.filter("x").limit(1).count()


def _rowcol(a: GridArray, axis: int | None) -> tuple[DataFrame, DataFrame]:
    gone = a.df.filter("x is null")
    return gone.select("i0").distinct() if axis in (None, 0) else gone.select("i0").limit(0), gone.select("i1").distinct() if axis in (None, 1) else gone.select("i1").limit(0)


def mask_rowcols(a: GridArray, axis: int | None = None) -> GridArray:
    """Rows (axis 0), columns (1) or both with a masked cell, masked whole."""
    rows, cols = _rowcol(a, axis)
    df = a.df.join(rows.withColumn("_r", F.lit(True)), "i0", "left").join(cols.withColumn("_c", F.lit(True)), "i1", "left")
    return GridArray(df.select("i0", "i1", F.when(F.col("_r").isNull() & F.col("_c").isNull(), F.col("x")).alias("x")), a.shape)


def mask_rows(a):
    return mask_rowcols(a, 0)


def mask_cols(a):
    return mask_rowcols(a, 1)


def compress_rowcols(a: GridArray, axis: int | None = None) -> GridArray:
    """Without rows, columns or both that have a masked cell."""
    for k in (0, 1) if axis is None else (axis,):
        gone = a.df.groupBy(f"i{k}").agg(F.max(F.col("x").isNull()).alias("_m"))
        keep = GridArray(gone.select(F.col(f"i{k}").alias("i0"), (~F.col("_m")).cast("double").alias("x")), [a.shape[k]])
        if axis is None and k == 0:
            cols = a.df.groupBy("i1").agg(F.max(F.col("x").isNull()).alias("_m"))
            keep_cols = GridArray(cols.select(F.col("i1").alias("i0"), (~F.col("_m")).cast("double").alias("x")), [a.shape[1]])
            a = a.compress(keep, 0).compress(keep_cols, 1)
            break
        a = a.compress(keep, k)
    return a


def compress_rows(a):
    return compress_rowcols(a, 0)


def compress_cols(a):
    return compress_rowcols(a, 1)


compress_nd = compress_rowcols


def _clumps(a: GridArray, masked_ones: bool) -> DataFrame:
    """(start, stop) of runs: cells in order minus their rank among equals are constant over a run."""
    from gridspan.layout import ranked

    kept = a.ravel().df.filter(F.col("x").isNull() if masked_ones else F.col("x").isNotNull())
    runs = ranked(kept, ["i0"], "_k").groupBy((F.col("i0") - F.col("_k")).alias("_g"))
    return runs.agg(F.min("i0").alias("start"), (F.max("i0") + 1).alias("stop")).select("start", "stop")


def clump_masked(a):
    return _clumps(a, True)


def clump_unmasked(a):
    return _clumps(a, False)


flatnotmasked_contiguous = clump_unmasked


def flatnotmasked_edges(a: GridArray) -> DataFrame:
    return a.ravel().df.filter("x is not null").agg(F.min("i0").alias("first"), F.max("i0").alias("last"))


def notmasked_edges(a: GridArray, axis: int | None = None) -> DataFrame:
    if axis is None:
        return flatnotmasked_edges(a)
    axis = a._axis(axis)
    return a.df.filter("x is not null").groupBy(*a._keys(axis)).agg(F.min(f"i{axis}").alias("first"), F.max(f"i{axis}").alias("last"))


def notmasked_contiguous(a: GridArray, axis: int | None = None) -> DataFrame:
    if axis is None:
        return clump_unmasked(a)
    axis = a._axis(axis)
    from gridspan.layout import ranked

    keys = a._keys(axis)
    runs = ranked(a.df.filter("x is not null"), [f"i{axis}"], "_k", keys).groupBy(*keys, (F.col(f"i{axis}") - F.col("_k")).alias("_g"))
    return runs.agg(F.min(f"i{axis}").alias("start"), (F.max(f"i{axis}") + 1).alias("stop")).drop("_g")


def dot(a: GridArray, b: GridArray, strict: bool = False) -> GridArray:
    """Masked cells count as zero; strict: what meets one is masked."""
    found = linalg.dot(a.filled(0.0), b.filled(0.0))
    if not strict:
        return found
    hit = linalg.dot(a.mask().apply(lambda m: m.cast("double")), G.ones_like(b.filled(0.0))) + linalg.dot(G.ones_like(a.filled(0.0)), b.mask().apply(lambda m: m.cast("double")))
    return found.masked_where(hit)


def inner(a, b):
    return linalg.inner(a.filled(0.0), b.filled(0.0))


def outer(a, b):
    return linalg.outer(a, b)


def cov(df: DataFrame, x: str, y: str, ddof: int = 1) -> Column:
    """Of rows where neither is masked."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return A.cov(F.when(both, F.col(x)), F.when(both, F.col(y)), ddof)


def corrcoef(df: DataFrame, x: str, y: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return A.corrcoef(F.when(both, F.col(x)), F.when(both, F.col(y)))


def angle(a: GridArray) -> GridArray:
    """0 for real cells from zero on, pi below, NaN for NaN."""
    return a.apply(lambda x: F.when(F.isnan(x.cast("double")), NAN).when(x < 0, 3.141592653589793).otherwise(F.when(x >= 0, 0.0)))


# The rest are the plain operations: NULL goes where its cell goes.
concatenate, stack, vstack, hstack, dstack, column_stack, append = G.concatenate, G.stack, G.vstack, G.hstack, G.dstack, G.column_stack, G.append
hsplit, where, choose, diag, diagflat, vander = G.hsplit, G.where, G.choose, G.diag, G.diagflat, G.vander
atleast_1d, atleast_2d, atleast_3d, zeros, ones, empty, arange, identity, indices, fromfunction = G.atleast_1d, G.atleast_2d, G.atleast_3d, G.zeros, G.ones, G.empty, G.arange, G.identity, G.indices, G.fromfunction
zeros_like, ones_like, empty_like = G.zeros_like, G.ones_like, G.empty_like


# Masks and fills as options


def asarray(a: GridArray, mask: GridArray | None = None) -> GridArray:
    return array(a, mask)


asanyarray = asarray


def copy(a: GridArray) -> GridArray:
    """Arrays are plans and never change, so a copy is the array."""
    return a


#: Whether writing to a masked cell unmasks it has no meaning where arrays never change.
harden_mask = soften_mask = copy


def set_fill_value(a: GridArray, value) -> GridArray:
    """The array with a fill value of its own, which `filled` takes where it is given none."""
    found = GridArray(a.df, a.shape)
    found.fill_value = value
    return found


def isMaskedArray(a) -> bool:  # noqa: N802
    return isinstance(a, GridArray)


isMA = isarray = isMaskedArray


def is_mask(a) -> bool:
    return isinstance(a, GridArray) and a.dtype == "boolean"


def flatten_mask(a: GridArray) -> GridArray:
    return getmask(a).ravel()


def ndenumerate(a: GridArray) -> DataFrame:
    """Coordinates and values of the cells that are not masked."""
    return a.df.filter("x is not null")


class MAError(Exception):
    """Of masked arrays."""


class MaskError(MAError):
    """Of masks."""


# Sets: all masked cells are one more value, equal to itself


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("x")).distinct()


def union1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return a.select(F.col(x).alias("x")).unionAll(b.select(F.col(y).alias("x"))).distinct()


def _sides(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """(x, s): each value of either side once, masked too, with 1 for a, 2 for b and 3 for both: one aggregation, no row meets another in a join."""
    both = a.select(F.col(x).alias("x"), F.lit(1).alias("s")).unionAll(b.select(F.col(y).alias("x"), F.lit(2).alias("s")))
    return both.groupBy("x").agg(F.bit_or("s").alias("s"))


def intersect1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _sides(a, x, b, y).filter("s = 3").select("x")


def setdiff1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _sides(a, x, b, y).filter("s = 1").select("x")


def setxor1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """Values that exactly one side has."""
    return _sides(a, x, b, y).filter("s < 3").select("x")


def isin(a: DataFrame, x: str, b: DataFrame, y: str, out: str = "isin", invert: bool = False) -> DataFrame:
    """`a` with `out`: whether b has its value, or a masked one where it is masked."""
    marks = b.select(F.col(y).alias("_y")).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return a.join(marks, a[x].eqNullSafe(marks["_y"]), "left").withColumn(out, ~hit if invert else hit).drop("_y", "_hit")


in1d = isin


# Sums along the array, fits and functions of lanes


def _spread(f: Callable[..., GridArray]) -> Callable[..., GridArray]:
    """A result that a masked cell takes part in is masked."""

    def run(a: GridArray, kernel, mode: str | None = None) -> GridArray:
        more = () if mode is None else (mode,)
        hit = f(a.mask().apply(lambda m: m.cast("double")), [1.0] * len(kernel), *more)
        return f(a.filled(0.0), kernel, *more).masked_where(hit)

    return run


def convolve(a: GridArray, kernel, mode: str = "full") -> GridArray:
    from gridspan.operators import spectral

    return _spread(spectral.convolve)(a, kernel, mode)


def correlate(a: GridArray, kernel, mode: str = "valid") -> GridArray:
    from gridspan.operators import spectral

    return _spread(spectral.correlate)(a, kernel, mode)


def polyfit(df: DataFrame, x: str, y: str, degree: int, weights: str | None = None) -> DataFrame:
    """The fit over rows where neither is masked."""
    from gridspan.functions import polynomials

    return polynomials.polyfit(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, degree, weights)


def apply_along_axis(f: Callable, axis: int, a: GridArray, size: int | None = None) -> GridArray:
    """f of what is not masked of each lane."""
    from gridspan.operators import ufunc

    return ufunc.apply_along_axis(lambda v: f(v[v == v]), axis, a.filled(NAN), size)


def apply_over_axes(f: Callable[[GridArray, int], GridArray], a: GridArray, axes) -> GridArray:
    for axis in axes:
        a = f(a, axis)
    return a
