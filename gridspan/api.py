"""One namespace with the familiar names: functions take arrays, columns, names or constants.

    from gridspan import api as gs
    gs.sin(a), gs.sum(a, axis=0), gs.linalg.inv(a), gs.char.upper("name")
"""

from __future__ import annotations


from collections.abc import Callable
from types import SimpleNamespace

from gridspan import array as _array
from gridspan.array import *  # noqa: F403
from gridspan.array import GridArray
from gridspan.functions import dates, elementwise, polynomials, random, types
from gridspan.functions import strings as char
from gridspan.functions.dates import busday_count, busday_offset, busdaycalendar, datetime64, datetime_as_string, datetime_data, is_busday, isnat, timedelta64
from gridspan.functions.polynomials import poly, poly1d, polyadd, polyder, polydiv, polyfit, polyint, polymul, polysub, polyval
from gridspan.functions.types import can_cast, common_type, find_common_type, finfo, iinfo, isdtype, issubdtype, min_scalar_type, mintypecode, promote_types, result_type
from gridspan.operators import aggregate, binning, linalg, selection, sets, spectral, ufunc
from gridspan.operators import masked as ma
from gridspan.operators.binning import bincount, digitize, histogram, histogram2d, histogram_bin_edges, histogramdd, interp
from gridspan.operators.linalg import cross, dot, einsum, einsum_path, inner, kron, matmul, outer, tensordot, vdot
from gridspan.operators.sets import in1d, intersect1d, isin, lexsort, setdiff1d, setxor1d, union1d, unique, unique_all, unique_counts, unique_inverse, unique_values
from gridspan.operators.spectral import bartlett, blackman, convolve, correlate, hamming, hanning, kaiser
from gridspan.operators.ufunc import apply_along_axis, apply_over_axes, frompyfunc, vectorize
from gridspan.sources.npy import frombuffer, fromfile, load, save
from gridspan.sources.text import fromstring, genfromtxt, loadtxt, savetxt, savez, savez_compressed

pi, e, euler_gamma, inf, nan, newaxis = 3.141592653589793, 2.718281828459045, 0.5772156649015329, float("inf"), float("nan"), None


def _elementwise(f: Callable) -> Callable:
    """f of columns, or of the first array and what goes with it."""

    def run(*args, **options):
        at = [k for k, a in enumerate(args) if isinstance(a, GridArray)]
        if not at:
            return f(*args, **options)

        def of_cells(*cells):
            given = dict(zip(at, cells, strict=True))
            return f(*(given.get(k, a) for k, a in enumerate(args)), **options)

        return args[at[0]].apply(of_cells, *(args[k] for k in at[1:]))

    run.__name__, run.__doc__ = f.__name__.rstrip("_"), f.__doc__
    return run


for _name, _f in list(vars(elementwise).items()):
    if callable(_f) and not _name.startswith("_") and getattr(_f, "__module__", "") in (elementwise.__name__,) and _name not in ("col", "double"):
        globals()[_name.rstrip("_") if _name not in ("round_",) else "round"] = _elementwise(_f)
for _name in ("gamma", "lgamma", "erf", "erfc", "i0", "j0", "j1", "y0", "y1", "spacing"):
    _one = getattr(elementwise, _name)
    globals()[_name] = (lambda g: lambda x: x.apply(g) if isinstance(x, GridArray) else g(x))(_one)


def _method(name: str) -> Callable:
    """The array's method; of columns the aggregate of that name."""

    def run(a, *args, **options):
        if isinstance(a, GridArray):
            return getattr(a, name)(*args, **options)
        return getattr(aggregate, name if hasattr(aggregate, name) else name + "_")(a, *args, **options)

    run.__name__ = name
    return run


_METHODS = (
    "sum prod mean var std max min ptp all any count_nonzero argmax argmin average cumsum cumprod diff ediff1d gradient trapezoid cumulative_trapezoid sort argsort partition argpartition "
    "searchsorted nonzero argwhere flatnonzero reshape ravel transpose swapaxes moveaxis rollaxis squeeze expand_dims flip rot90 broadcast_to repeat tile resize roll pad sliding_window_view as_strided take "
    "take_along_axis compress extract delete insert put putmask place diagonal trace tril triu trim_zeros clip astype"
).split()
for _name in _METHODS:
    globals()[_name] = _method(_name)
for _name in ("nansum", "nanprod", "nanmean", "nanvar", "nanstd", "nanmax", "nanmin"):
    _agg = getattr(aggregate, _name)
    globals()[_name] = (lambda g: lambda a, *args, axis=None, **o: a.reduce(lambda x: g(x, *args, **o), axis) if isinstance(a, GridArray) else g(a, *args, **o))(_agg)


def _of_rank(name: str, share: Callable[[float], float]) -> Callable:
    """Of an array along its axes, or of a DataFrame by keys: f(df, keys, column, q, ...)."""

    def run(a, *args, **options):
        if not isinstance(a, GridArray):
            return getattr(selection, name)(a, *args, **options)
        q, *rest = (0.5, *args) if name.endswith("median") else args
        return (a.nanquantile if name.startswith("nan") else a.quantile)(share(q), *rest, **options)

    run.__name__ = name
    return run


for _name in ("median", "nanmedian", "quantile", "nanquantile", "percentile", "nanpercentile"):
    globals()[_name] = _of_rank(_name, (lambda q: q / 100) if _name.endswith("percentile") else (lambda q: q))


def nancumsum(a: GridArray, axis: int | None = None) -> GridArray:
    return a.apply(lambda x: elementwise.nan_to_num(x, 0.0)).cumsum(axis)


def nancumprod(a: GridArray, axis: int | None = None) -> GridArray:
    return a.apply(lambda x: elementwise.nan_to_num(x, 1.0)).cumprod(axis)


def flipud(a: GridArray) -> GridArray:
    return a.flip(0)


def fliplr(a: GridArray) -> GridArray:
    return a.flip(1)


def ndim(a: GridArray) -> int:
    return a.ndim


def shape(a: GridArray) -> tuple[int, ...]:
    return a.shape


def size(a: GridArray, axis: int | None = None) -> int:
    return a.size if axis is None else a.shape[axis]


def copy(a: GridArray) -> GridArray:
    return a


def asarray_chkfinite(a: GridArray) -> GridArray:
    """Raises where it is computed."""
    from pyspark.sql import functions as F

    return a.apply(lambda x: F.when(elementwise.isfinite(x), x).otherwise(F.raise_error(F.lit("the array has infs or NaNs")).cast("double")))


def fill_diagonal(a: GridArray, value: float) -> GridArray:
    from pyspark.sql import functions as F

    return GridArray(a.df.withColumn("x", F.when(F.col("i0") == F.col("i1"), value).otherwise(F.col("x"))), a.shape)


def unravel_index(flat, dims):
    """A column of flat positions as one column for each axis."""
    from pyspark.sql import functions as F

    out, step = [], 1
    for n in reversed(dims):
        out.append((F.floor(flat / step) % n).cast("long"))
        step *= n
    return tuple(reversed(out))


def ravel_multi_index(columns, dims):
    total = None
    for c, n in zip(columns, dims, strict=True):
        total = c if total is None else total * n + c
    return total


def _pairs(spark, n: int, m: int, keep) -> list[GridArray]:
    from gridspan.layout import ranked

    grid = _array.indices_frame(spark, [n, m]).filter(keep)
    placed = ranked(grid.selectExpr("i0 as r", "i1 as c", f"i0 * {m} + i1 as f"), ["f"], "i0")
    count = placed.count()
    return [GridArray(placed.selectExpr("i0", f"{c} as x"), [count]) for c in ("r", "c")]


def tril_indices(spark, n: int, k: int = 0, m: int | None = None) -> list[GridArray]:
    return _pairs(spark, n, m or n, f"i1 - i0 <= {k}")


def triu_indices(spark, n: int, k: int = 0, m: int | None = None) -> list[GridArray]:
    return _pairs(spark, n, m or n, f"i1 - i0 >= {k}")


def diag_indices(spark, n: int, ndim: int = 2) -> list[GridArray]:  # noqa: A002
    return [_array.arange(spark, n)] * ndim


def ix_(*arrays: GridArray) -> list[GridArray]:
    n = len(arrays)
    return [a.reshape(*(a.shape[0] if j == k else 1 for j in range(n))) for k, a in enumerate(arrays)]


trapz, cumulative_sum, cumulative_prod, flatten, amax, amin = globals()["trapezoid"], globals()["cumsum"], globals()["cumprod"], globals()["ravel"], globals()["max"], globals()["min"]
linalg_norm = linalg.norm
fft = SimpleNamespace(**{n: getattr(spectral, n) for n in dir(spectral) if "fft" in n and not n.startswith("_")})
lib = SimpleNamespace(scimath=SimpleNamespace(**{n.removeprefix("scimath_"): getattr(elementwise, n) for n in dir(elementwise) if n.startswith("scimath_")}))
polynomial = polynomials


# Aliases and shapes

cumulative_prod, product, alltrue, sometrue = globals()["cumprod"], globals()["prod"], globals()["all"], globals()["any"]
row_stack = _array.vstack


def asarray(a: GridArray) -> GridArray:
    return a


#: Memory layout has no meaning here, so what is required of it always holds.
require = asarray


def isscalar(x) -> bool:
    return isinstance(x, (int, float, complex, str, bytes, bool))


def isrealobj(a: GridArray) -> bool:
    return not iscomplexobj(a)


def iscomplexobj(a: GridArray) -> bool:
    """Complex cells are structs of re and im."""
    return a.dtype.startswith("struct<re:")


def matrix_transpose(a: GridArray) -> GridArray:
    return a.swapaxes(-1, -2)


def broadcast_arrays(*arrays: GridArray) -> list[GridArray]:
    wide = _array.broadcast_shapes(*(a.shape for a in arrays))
    return [a.broadcast_to(wide) for a in arrays]


def repmat(a: GridArray, m: int, n: int) -> GridArray:
    return _array.atleast_2d(a).tile(m, n)


def fromiter(spark, values) -> GridArray:
    """From the driver: for small arrays."""
    return _array.array(spark, [float(v) for v in values])


def ndenumerate(a: GridArray):
    """Coordinates and values, as a DataFrame."""
    return a.df


def ndindex(spark, *shape: int):
    return _array.indices_frame(spark, shape)


# Cells by position


def put_along_axis(a: GridArray, index: GridArray, values: GridArray | float, axis: int) -> GridArray:
    """A copy with the cells that `index` names along the axis, lane by lane, replaced; of repeated places the last wins."""
    from pyspark.sql import functions as F

    axis = a._axis(axis)
    at, n = f"i{axis}", a.shape[axis]
    marks = index.apply(lambda k, v: F.struct(F.pmod(k.cast("long"), F.lit(n)).alias("at"), v.alias("new")), values)
    told = marks.df.select(*a._keys(axis), F.col(at).alias("_turn"), F.col("x.at").alias(at), F.struct(F.col("x.new").alias("_new")).alias("_new")).groupBy(*a.axes).agg(F.max_by("_new", "_turn").alias("_s"))
    joined = a.df.join(told, a.axes, "left")
    return GridArray(joined.select(*a.axes, F.when(F.col("_s").isNotNull(), F.col("_s._new")).otherwise(F.col("x")).alias("x")), a.shape)


def _named(a: GridArray, index: tuple[GridArray, ...]):
    """(place axes, _t: an index tuple's place in a, by axis): index arrays broadcast against each other."""
    from pyspark.sql import functions as F

    def place(*k):
        return F.struct(*(F.pmod(c.cast("long"), F.lit(n)).alias(f"i{j}") for j, (c, n) in enumerate(zip(k, a.shape, strict=True))))

    return index[0].apply(place, *index[1:])


def fancy_get(a: GridArray, *index: GridArray) -> GridArray:
    """a[i, j, ..] of one index array for each axis: a join on places."""
    from pyspark.sql import functions as F

    places = _named(a, index)
    asked = places.df.select(*(F.col(c).alias(f"_q{k}") for k, c in enumerate(places.axes)), *(F.col(f"x.{c}").alias(c) for c in a.axes))
    found = asked.join(a.df, a.axes)
    return GridArray(found.select(*(F.col(f"_q{k}").alias(c) for k, c in enumerate(places.axes)), "x"), places.shape)


def fancy_set(a: GridArray, index: tuple[GridArray, ...], value: float) -> GridArray:
    from pyspark.sql import functions as F

    marks = _named(a, index).df.select("x.*").distinct().withColumn("_hit", F.lit(True))
    return GridArray(a.df.join(marks, a.axes, "left").select(*a.axes, F.when(F.col("_hit"), value).otherwise(F.col("x")).alias("x")), a.shape)


def copyto(a: GridArray, source: GridArray | float, where: GridArray | None = None) -> GridArray:  # noqa: A002
    """The array with `source` where the condition holds: arrays never change, so the new one is returned."""
    from pyspark.sql import functions as F

    if where is None:
        return a.apply(lambda x, y: y + F.lit(0), source)
    return a.apply(lambda x, y, c: F.when(c.cast("boolean"), y).otherwise(x), source, where)


def tril_indices_from(a: GridArray, k: int = 0) -> list[GridArray]:
    return tril_indices(a.df.sparkSession, a.shape[0], k, a.shape[1])


def triu_indices_from(a: GridArray, k: int = 0) -> list[GridArray]:
    return triu_indices(a.df.sparkSession, a.shape[0], k, a.shape[1])


def diag_indices_from(a: GridArray) -> list[GridArray]:
    if len(set(a.shape)) != 1:
        raise ValueError("all extents must be equal")
    return diag_indices(a.df.sparkSession, a.shape[0], a.ndim)


def mask_indices(mask: GridArray) -> list[GridArray]:
    """The coordinates of true cells, in order, one array for each axis."""
    found = mask.nonzero()
    n = found.count()
    return [GridArray(found.selectExpr("place as i0", f"{c} as x"), [n]) for c in mask.axes]


class _Grid:
    """mgrid(spark)[0:2, 0:3]: the coordinates as dense arrays, or open ones that broadcast to them."""

    def __init__(self, spark, sparse: bool):
        self.spark, self.sparse = spark, sparse

    def __getitem__(self, key) -> list[GridArray]:
        cuts = key if isinstance(key, tuple) else (key,)
        lines = [_array.arange(self.spark, c.start or 0, c.stop, c.step or 1) for c in cuts]
        if len(lines) == 1:
            return lines
        open_ones = ix_(*lines)
        return open_ones if self.sparse else broadcast_arrays(*open_ones)


def mgrid(spark) -> _Grid:
    return _Grid(spark, False)


def ogrid(spark) -> _Grid:
    return _Grid(spark, True)


class _IndexExpression:
    def __getitem__(self, key):
        return key


index_exp = s_ = _IndexExpression()


# Order, phases, records


def sort_complex(df, column: str, index: str, out: str = "place"):
    """`df` with the place of its complex column, by real part, then imaginary, then the index."""
    from pyspark.sql import functions as F

    from gridspan.layout import ranked

    led = df.withColumns({"_re": F.col(f"{column}.re").cast("double"), "_im": F.col(f"{column}.im").cast("double")})
    return ranked(led, ["_re", "_im", index], out).drop("_re", "_im")


def unwrap(a: GridArray, period: float = 2 * pi) -> GridArray:
    """Jumps of half a period or more become those below it, by whole periods: a running sum of corrections."""
    from pyspark.sql import functions as F

    half = period / 2

    def correction(d):
        turned = F.pmod(d + half, F.lit(period)) - half
        turned = F.when((turned == -half) & (d > 0), half).otherwise(turned)
        return F.when(F.abs(d) < half, 0.0).otherwise(turned - d)

    steps = a.diff().apply(correction)
    return a + _array.concatenate([_array.zeros(a.df.sparkSession, [1]), steps]).cumsum()


def append_fields(df, record: str, **fields):
    """A struct column, here a record array, with further fields."""
    from pyspark.sql import functions as F

    old = df.schema[record].dataType.fieldNames()
    return df.withColumn(record, F.struct(*(F.col(record)[n].alias(n) for n in old), *(c.alias(n) for n, c in fields.items())))


class LinAlgError(ValueError):
    """Of a matrix that an operation has no result for."""


def normalize_axis_index(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise IndexError(f"axis {axis} is out of bounds for {ndim} dimensions")
    return axis % ndim


def normalize_axis_tuple(axis, ndim: int) -> tuple[int, ...]:
    found = tuple(normalize_axis_index(k, ndim) for k in ((axis,) if isinstance(axis, int) else axis))
    if len(set(found)) != len(found):
        raise ValueError("repeated axis")
    return found
