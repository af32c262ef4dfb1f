"""GridArray: an n-dimensional array as a DataFrame of coordinates and values.

One row holds one cell: coordinates `i0`, `i1`, .. (bigint, from 0) and `x`.
A NULL value is masked. Every operation builds a plan; nothing runs until the
DataFrame is used. The shape is known to the driver, so shape operations are
arithmetic on coordinates and need no pass over the data.
"""

from __future__ import annotations

import builtins
import functools
import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspan.functions import elementwise as E
from gridspan.layout import BLOCK, neighbours, ranked, running, running_by_range
from gridspan.operators import aggregate as A
from gridspan.operators import selection

Index = int | slice

#: Positions, or intervals of positions, that one interval of the next level covers; levels of one block.
FANOUT, LEVELS = 16, 2
#: Cells of an array that every task may hold.
FEW = 100_000


def _axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def _each(n: int) -> Column:
    """Each row once for 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _blocks(cells: DataFrame, keys: Sequence[str], fold: Callable[[Column], Column]) -> DataFrame:
    """(keys, _block, _l0, _l1, ..): cells (keys, _at, x) by blocks of FANOUT ** LEVELS positions; _l0 has the values in order, _l1 the folds of FANOUT of them, and so on."""
    span = FANOUT**LEVELS
    block = F.floor(F.col("_at") / span)
    rows = cells.select(*keys, block.alias("_block"), (F.col("_at") - block * span).cast("int").alias("_o"), "x").repartition(*keys, "_block")
    if rows.agg(fold(F.col("x")).alias("x")).dtypes != rows.select("x").dtypes:  # values and folds share arrays
        rows = rows.groupBy(*keys, "_block", "_o").agg(fold(F.col("x")).alias("x"))
    held: list[str] = []
    for level in range(LEVELS):
        up = [F.expr(f"_o div {FANOUT}").cast("int").alias("_o")] if level + 1 < LEVELS else []
        own = F.collect_list(F.struct("_o", "x")).alias(f"_l{level}")
        rows = rows.groupBy(*keys, "_block", *up).agg(fold(F.col("x")).alias("x"), own, *(F.flatten(F.collect_list(c)).alias(c) for c in held))
        held.append(f"_l{level}")

    def dense(c: str) -> Column:
        inside = F.sort_array(c)
        values, top = F.transform(inside, lambda v: v["x"]), F.element_at(inside, -1)["_o"]
        gaps = F.transform(F.sequence(F.lit(0), top), lambda k: F.map_from_entries(c)[k])
        return F.when(top + 1 == F.size(c), values).otherwise(gaps).alias(c)

    return rows.select(*keys, "_block", *(dense(c) for c in held))


def _within(low: Column, high: Column) -> Column:
    """What low .. high - 1 of a block is folded from: the largest aligned intervals that fit."""
    whole = lambda x, size: x if size == 1 else (x / size).cast("int")
    taken = []
    for level in range(LEVELS):
        own, size = F.col(f"_l{level}"), FANOUT**level
        a = whole(low + (size - 1), size)
        b = F.greatest(a, whole(high, size)) if level else high
        if level + 1 == LEVELS:
            taken.append(F.slice(own, a + 1, b - a))
            break
        mid = F.least(whole(low + (size * FANOUT - 1), size * FANOUT) * FANOUT, b)
        rest = F.greatest(whole(high, size * FANOUT) * FANOUT, mid)
        taken += [F.slice(own, a + 1, mid - a), F.slice(own, rest + 1, b - rest)]
    return F.concat(*taken)


class GridArray:
    """`df` has columns i0.. and x; `shape` their extents."""

    #: (table, row, vector) where the array was made of a column of vectors, see `from_rows`.
    packed: tuple[DataFrame, str, str] | None = None

    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.df, self.shape = df, tuple(int(n) for n in shape)

    # Properties

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return _axes(self.ndim)

    @property
    def T(self) -> GridArray:  # noqa: N802
        return self.transpose()

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)["x"]

    def __len__(self) -> int:
        return self.shape[0]

    def _axis(self, axis: int) -> int:
        if not -self.ndim <= axis < self.ndim:
            raise IndexError(f"axis {axis} is out of bounds for {self.ndim} dimensions")
        return axis % self.ndim

    def _move(self, columns: dict[str, Column], shape: Sequence[int], keep: Column | None = None) -> GridArray:
        """New coordinates from old ones."""
        df = self.df if keep is None else self.df.filter(keep)
        return GridArray(df.select(*(columns[a].cast("long").alias(a) for a in _axes(len(shape))), "x"), shape)

    def tolist(self) -> list | float | None:
        """Nested lists on the driver: for small results."""
        cells = {tuple(r[:-1]): r[-1] for r in self.df.select(*self.axes, "x").collect()}

        def build(at: tuple[int, ...]):
            if len(at) == self.ndim:
                return cells.get(at)
            return [build((*at, k)) for k in range(self.shape[len(at)])]

        return build(())

    # Elementwise

    def apply(self, f: Callable[..., Column], *others: GridArray | float | int | None) -> GridArray:
        """f over the values of self and others, broadcast against each other."""
        columns = []
        df = self.df.withColumnRenamed("x", "x0")
        shape = self.shape
        for k, other in enumerate(others, 1):
            if isinstance(other, GridArray):
                wide = broadcast_shapes(shape, other.shape)
                df = _met(df, shape, [f"x{j}" for j in range(k) if f"x{j}" in df.columns], other.df.withColumnRenamed("x", f"x{k}"), other.shape, f"x{k}", wide)
                shape = wide
                columns.append(F.col(f"x{k}"))
            else:
                columns.append(F.lit(other))
        value = f(F.col("x0"), *columns)
        return GridArray(df.select(*_axes(len(shape)), value.alias("x")), shape)

    def __add__(self, o):
        return self.apply(E.add, o)

    __radd__ = __add__

    def __sub__(self, o):
        return self.apply(E.subtract, o)

    def __rsub__(self, o):
        return self.apply(lambda a, b: E.subtract(b, a), o)

    def __mul__(self, o):
        return self.apply(E.multiply, o)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self.apply(E.divide, o)

    def __rtruediv__(self, o):
        return self.apply(lambda a, b: E.divide(b, a), o)

    def __floordiv__(self, o):
        return self.apply(E.floor_divide, o)

    def __mod__(self, o):
        return self.apply(E.remainder, o)

    def __pow__(self, o):
        return self.apply(E.power, o)

    def __neg__(self):
        return self.apply(E.negative)

    def __abs__(self):
        return self.apply(E.abs_)

    def __and__(self, o):
        return self.apply(lambda a, b: a & b if self.dtype == "boolean" else E.bitwise_and(a, b), o)

    def __or__(self, o):
        return self.apply(lambda a, b: a | b if self.dtype == "boolean" else E.bitwise_or(a, b), o)

    def __invert__(self):
        return self.apply(lambda a: ~a if self.dtype == "boolean" else E.bitwise_not(a))

    def __lt__(self, o):
        return self.apply(E.less, o)

    def __le__(self, o):
        return self.apply(E.less_equal, o)

    def __gt__(self, o):
        return self.apply(E.greater, o)

    def __ge__(self, o):
        return self.apply(E.greater_equal, o)

    def equal(self, o) -> GridArray:
        return self.apply(E.equal, o)

    def __matmul__(self, o):
        return self.matmul(o)

    def astype(self, dtype: str) -> GridArray:
        return self.apply(lambda a: a.cast(dtype))

    def clip(self, low=None, high=None) -> GridArray:
        return self.apply(lambda a: E.clip(a, low, high))

    def round(self, decimals: int = 0) -> GridArray:
        return self.apply(lambda a: E.around(a, decimals))

    def where(self, condition: GridArray, other) -> GridArray:
        """self where the condition holds, else other."""
        return self.apply(lambda a, c, b: F.when(c, a).otherwise(b), condition, other)

    # Reductions

    def reduce(self, f: Callable[[Column], Column], axis: int | Sequence[int] | None = None, keepdims: bool = False) -> GridArray:
        """f aggregates x over the axes (all if None), by one grouped aggregation."""
        return self._reduced(lambda keys: self.df.groupBy(*keys).agg(f(F.col("x")).alias("x")), axis, keepdims)

    def _reduced(self, f: Callable[[list[str]], DataFrame], axis: int | Sequence[int] | None, keepdims: bool) -> GridArray:
        """f gives (keys, x) for the axes that stay."""
        gone = set(range(self.ndim)) if axis is None else {self._axis(a) for a in ([axis] if isinstance(axis, int) else axis)}
        left = [k for k in range(self.ndim) if k not in gone]
        found = f([f"i{k}" for k in left])
        if keepdims:
            at = {f"i{k}": F.col(f"i{k}") if k in left else F.lit(0) for k in range(self.ndim)}
            return GridArray(found, ())._move(at, [self.shape[k] if k in left else 1 for k in range(self.ndim)])
        named = found.select(*(F.col(f"i{k}").alias(f"j{n}") for n, k in enumerate(left)), "x")
        return GridArray(named.toDF(*_axes(len(left)), "x"), [self.shape[k] for k in left])

    def sum(self, axis=None, keepdims=False):
        return self.reduce(A.sum_, axis, keepdims)

    def prod(self, axis=None, keepdims=False):
        return self.reduce(A.prod, axis, keepdims)

    def mean(self, axis=None, keepdims=False):
        return self.reduce(A.mean, axis, keepdims)

    def var(self, axis=None, ddof=0, keepdims=False):
        return self.reduce(lambda x: A.var(x, ddof), axis, keepdims)

    def std(self, axis=None, ddof=0, keepdims=False):
        return self.reduce(lambda x: A.std(x, ddof), axis, keepdims)

    def max(self, axis=None, keepdims=False):
        return self.reduce(A.max_, axis, keepdims)

    def min(self, axis=None, keepdims=False):
        return self.reduce(A.min_, axis, keepdims)

    def ptp(self, axis=None, keepdims=False):
        return self.reduce(A.ptp, axis, keepdims)

    def all(self, axis=None, keepdims=False):
        return self.reduce(A.all_, axis, keepdims)

    def any(self, axis=None, keepdims=False):
        return self.reduce(A.any_, axis, keepdims)

    def count_nonzero(self, axis=None, keepdims=False):
        return self.reduce(A.count_nonzero, axis, keepdims)

    def count(self, axis=None, keepdims=False):
        """Cells that are not masked."""
        return self.reduce(F.count, axis, keepdims)

    def median(self, axis=None, keepdims=False):
        return self.quantile(0.5, axis, keepdims=keepdims)

    def quantile(self, q: float, axis=None, method: str = "linear", keepdims=False):
        return self._reduced(lambda keys: selection.quantile(self.df, keys, "x", q, method, "x"), axis, keepdims)

    def nanquantile(self, q: float, axis=None, method: str = "linear", keepdims=False):
        return self._reduced(lambda keys: selection.nanquantile(self.df, keys, "x", q, method, "x"), axis, keepdims)

    def argmax(self, axis: int | None = None):
        return self.reduce(lambda x: A.argmax(x, self._flat() if axis is None else f"i{self._axis(axis)}"), axis)

    def argmin(self, axis: int | None = None):
        return self.reduce(lambda x: A.argmin(x, self._flat() if axis is None else f"i{self._axis(axis)}"), axis)

    def average(self, weights: GridArray, axis=None):
        return (self * weights).sum(axis) / weights.sum(axis)

    # Ordered operations

    def _keys(self, axis: int) -> list[str]:
        return [a for k, a in enumerate(self.axes) if k != axis]

    def _running(self, axis: int | None, fold, join, identity: float) -> GridArray:
        a = self if axis is not None else self.ravel()
        axis = a._axis(axis or 0)
        df = running(a.df, F.col("x").cast("double"), f"i{axis}", a._keys(axis), "_out", fold, join, F.lit(identity), a.shape[axis])
        masked = F.when(F.col("x").isNotNull(), F.col("_out"))
        return GridArray(df.select(*a.axes, masked.alias("x")), a.shape)

    def cumsum(self, axis: int | None = None) -> GridArray:
        return self._running(axis, F.sum, lambda a, b: a + b, 0.0)

    def cumprod(self, axis: int | None = None) -> GridArray:
        return self._running(axis, F.product, lambda a, b: a * b, 1.0)

    def maximum_accumulate(self, axis: int | None = None) -> GridArray:
        return self._running(axis, F.max, E.maximum, -math.inf)

    def _near(self, axis: int, steps: Sequence[int]) -> DataFrame:
        return neighbours(self.df, f"i{axis}", self._keys(axis), "x", steps)

    def diff(self, n: int = 1, axis: int = -1) -> GridArray:
        """n-th difference: one aggregation whatever n is, by binomial weights."""
        axis = self._axis(axis)
        length = max(self.shape[axis] - n, 0)
        near = self._near(axis, range(n + 1)).filter((F.col(f"i{axis}") >= 0) & (F.col(f"i{axis}") < length))
        value = sum(((-1) ** (n - k) * math.comb(n, k) * F.col(f"n_p{k}").cast("double") for k in range(n + 1)), F.lit(0.0))
        shape = [length if k == axis else m for k, m in enumerate(self.shape)]
        return GridArray(near.select(*self.axes, value.alias("x")), shape)

    def ediff1d(self, to_begin: Sequence[float] = (), to_end: Sequence[float] = ()) -> GridArray:
        inner = self.ravel().diff()
        spark = self.df.sparkSession
        parts = [array(spark, list(to_begin))] if to_begin else []
        parts += [inner, *([array(spark, list(to_end))] if to_end else [])]
        return concatenate(parts) if len(parts) > 1 else inner

    def gradient(self, spacing: float = 1.0, axis: int = -1, edge_order: int = 1) -> GridArray:
        axis = self._axis(axis)
        n, i, h = self.shape[axis], F.col(f"i{axis}"), spacing
        if n < edge_order + 1:
            raise ValueError("the array is too short for a gradient")
        near = self._near(axis, (-2, -1, 0, 1, 2)).filter((i >= 0) & (i < n))
        at = lambda k: F.col(f"n_m{-k}" if k < 0 else f"n_p{k}").cast("double")
        if edge_order == 1:
            left, right = (at(1) - at(0)) / h, (at(0) - at(-1)) / h
        else:
            left, right = (-3 * at(0) + 4 * at(1) - at(2)) / (2 * h), (3 * at(0) - 4 * at(-1) + at(-2)) / (2 * h)
        value = F.when(i == 0, left).when(i == n - 1, right).otherwise((at(1) - at(-1)) / (2 * h))
        return GridArray(near.select(*self.axes, value.alias("x")), self.shape)

    def trapezoid(self, dx: float = 1.0, axis: int = -1) -> GridArray:
        """Every cell counts once, the two at the ends half."""
        axis = self._axis(axis)
        i, n = F.col(f"i{axis}"), self.shape[axis]
        weight = F.when((i == 0) | (i == n - 1), 0.5).otherwise(1.0) if n > 1 else F.lit(0.0)
        return GridArray(self.df.withColumn("x", F.col("x") * weight * dx), self.shape).sum(axis)

    def cumulative_trapezoid(self, dx: float = 1.0, axis: int = -1) -> GridArray:
        axis = self._axis(axis)
        shape = [max(m - 1, 0) if k == axis else m for k, m in enumerate(self.shape)]
        near = self._near(axis, (0, 1)).filter((F.col(f"i{axis}") >= 0) & (F.col(f"i{axis}") < shape[axis]))
        halves = GridArray(near.select(*self.axes, ((F.col("n_p0") + F.col("n_p1")) * (dx / 2)).alias("x")), shape)
        return halves.cumsum(axis)

    def sort(self, axis: int | None = -1, descending: bool = False) -> GridArray:
        """NaN and masked cells come last."""
        order = self.argsort(axis, descending, value=True)
        return order

    def argsort(self, axis: int | None = -1, descending: bool = False, value: bool = False) -> GridArray:
        a = self if axis is not None else self.ravel()
        axis = a._axis(-1 if axis is None else axis)
        i = f"i{axis}"
        # Falling order is the rising one of the opposite values; NaN, larger than all, is last in both.
        led = a.df.withColumn("_key", -F.col("x") if descending else F.col("x"))
        found = ranked(led, ["_key", i], "_at", a._keys(axis))
        out = F.col("x") if value else F.col(i)
        return GridArray(found.select(*(F.col("_at").alias(c) if c == i else F.col(c) for c in a.axes), out.alias("_x")).withColumnRenamed("_x", "x"), a.shape)

    def partition(self, kth: int, axis: int | None = -1, ordered: bool = False) -> GridArray:
        """The cell of rank `kth` in its sorted place, smaller ones before it and larger ones after; each part as it was in order, or `ordered` as well.

        The cell is found by selection, the places by counting: nothing is sorted, unless the parts are wanted in order.
        """
        if ordered:
            return self.sort(axis)
        return self._partition(kth, axis, F.col("x"))

    def argpartition(self, kth: int, axis: int | None = -1) -> GridArray:
        a = self if axis is not None else self.ravel()
        return a._partition(kth, axis, F.col(f"i{a._axis(-1 if axis is None else axis)}").cast("double"))

    def _partition(self, kth: int, axis: int | None, out: Column) -> GridArray:
        a = self if axis is not None else self.ravel()
        axis = a._axis(-1 if axis is None else axis)
        i, keys, n = f"i{axis}", a._keys(axis), a.shape[axis]
        kth = kth + n if kth < 0 else kth
        chosen = selection.at_ranks(a.df, keys, "x", {"_v": lambda _: F.lit(kth)}).select(*keys, "_v")
        met = a.df.join(chosen, keys) if keys else a.df.crossJoin(F.broadcast(chosen))  # one row
        x, v = F.col("x").cast("double"), F.col("_v")
        side = F.when(x.isNull(), F.when(v.isNull(), 1).otherwise(2)).when(v.isNull() | (x < v), 0).when(x == v, 1).otherwise(2)  # NULL is last
        split = met.select(*a.axes, out.alias("_x"), side.alias("_side"))
        # The cells of each part up to this one: those of earlier blocks, and within the block.
        parts, block = [F.col("_side") == k for k in range(3)], [*keys, "_block"]
        split = split.withColumn("_block", F.floor(F.col(i) / BLOCK))
        per = split.groupBy(*block).agg(*(F.count(F.when(p, 1)).alias(f"_c{k}") for k, p in enumerate(parts)))
        earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(f"_c{k}").over(earlier), F.lit(0)) for k in range(3)]
        smaller = [F.sum("_c0").over(Window.partitionBy(*keys)), F.sum(F.col("_c0") + F.col("_c1")).over(Window.partitionBy(*keys))]
        base = per.select(*block, F.array(sums[0], sums[1] + smaller[0], sums[2] + smaller[1]).alias("_base"))
        inside = Window.partitionBy(*block).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
        own = F.array(*(F.count(F.when(p, 1)).over(inside) for p in parts))
        split = split.withColumn("_own", own).join(base, block)
        at = F.get("_base", F.col("_side")) + F.get("_own", F.col("_side")) - 1
        return GridArray(split.select(*(at.cast("long").alias(c) if c == i else F.col(c) for c in a.axes), F.col("_x").alias("x")), a.shape)

    def searchsorted(self, values: GridArray, side: str = "left") -> GridArray:
        """Where each value would go into this 1-D array once sorted: its count of smaller (or equal) cells, so the array itself need not be in order.

        Equal cells are counted first; counts and values meet in one running sum over ranges of values, not in a join.
        """
        mark = 1 if side == "left" else -1
        cells = self.df.groupBy(F.col("x").cast("double").alias("v")).agg(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"), F.count("*").alias("n"))
        asked = values.ravel().df.select(F.col("x").cast("double").alias("v"), F.lit(-mark).alias("kind"), F.col("i0").alias("at"), F.lit(0).cast("long").alias("n"))
        wide = running_by_range(cells.unionByName(asked), F.col("n"), ["v", "kind", "at"], "_n")
        found = wide.filter(F.col("kind") != 0).select(F.col("at").alias("i0"), F.col("_n").cast("long").alias("x"))
        return GridArray(found, [values.size]).reshape(values.shape)

    def nonzero(self) -> DataFrame:
        """(place, i0..): coordinates of non-zero cells, in order."""
        found = self.df.filter(E.truth("x"))
        return ranked(found.withColumn("_f", self._flat()), ["_f"], "place").select("place", *self.axes)

    argwhere = nonzero

    def flatnonzero(self) -> GridArray:
        found = self.df.filter(E.truth("x")).select(self._flat().alias("f"))
        n = found.count()
        return GridArray(ranked(found, ["f"], "i0").select("i0", F.col("f").alias("x")), [n])

    # Shape

    def _flat(self) -> Column:
        out = F.lit(0).cast("long")
        for a, n in zip(self.axes, self.shape, strict=True):
            out = out * n + F.col(a)
        return out

    def reshape(self, *shape: int | Sequence[int]) -> GridArray:
        want = list(shape[0] if len(shape) == 1 and not isinstance(shape[0], int) else shape)
        if -1 in want:
            known = math.prod(n for n in want if n != -1)
            want[want.index(-1)] = self.size // known if known else 0
        if math.prod(want) != self.size:
            raise ValueError(f"cannot reshape {self.shape} into {tuple(want)}")
        flat, at, step = self._flat(), {}, 1
        for k in reversed(range(len(want))):
            at[f"i{k}"] = F.floor(flat / step) % want[k] if want[k] else flat
            step *= want[k]
        return self._move(at, want)

    def ravel(self) -> GridArray:
        return self if self.ndim == 1 else self.reshape(self.size)

    flatten = ravel

    def transpose(self, *axes: int) -> GridArray:
        order = [self._axis(a) for a in axes] or list(reversed(range(self.ndim)))
        return self._move({f"i{k}": F.col(f"i{a}") for k, a in enumerate(order)}, [self.shape[a] for a in order])

    def swapaxes(self, a: int, b: int) -> GridArray:
        order = list(range(self.ndim))
        a, b = self._axis(a), self._axis(b)
        order[a], order[b] = b, a
        return self.transpose(*order)

    def moveaxis(self, source: int, target: int) -> GridArray:
        order = [k for k in range(self.ndim) if k != self._axis(source)]
        order.insert(target % self.ndim, self._axis(source))
        return self.transpose(*order)

    def rollaxis(self, axis: int, start: int = 0) -> GridArray:
        axis = self._axis(axis)
        start += self.ndim if start < 0 else 0
        return self.moveaxis(axis, start - (axis < start))

    def squeeze(self, axis: int | None = None) -> GridArray:
        gone = [k for k, n in enumerate(self.shape) if n == 1] if axis is None else [self._axis(axis)]
        if any(self.shape[k] != 1 for k in gone):
            raise ValueError("cannot drop an axis whose size is not one")
        left = [k for k in range(self.ndim) if k not in gone]
        return self._move({f"i{n}": F.col(f"i{k}") for n, k in enumerate(left)}, [self.shape[k] for k in left])

    def expand_dims(self, axis: int) -> GridArray:
        axis %= self.ndim + 1
        at = {f"i{k if k < axis else k + 1}": F.col(f"i{k}") for k in range(self.ndim)}
        return self._move(at | {f"i{axis}": F.lit(0)}, [*self.shape[:axis], 1, *self.shape[axis:]])

    def flip(self, axis: int | Sequence[int] | None = None) -> GridArray:
        turned = set(range(self.ndim)) if axis is None else {self._axis(a) for a in ([axis] if isinstance(axis, int) else axis)}
        return self._move({f"i{k}": self.shape[k] - 1 - F.col(f"i{k}") if k in turned else F.col(f"i{k}") for k in range(self.ndim)}, self.shape)

    def rot90(self, k: int = 1, axes: tuple[int, int] = (0, 1)) -> GridArray:
        k %= 4
        if k == 0:
            return self
        if k == 2:
            return self.flip(axes)
        return self.flip(axes[1]).swapaxes(*axes) if k == 1 else self.swapaxes(*axes).flip(axes[1])

    def broadcast_to(self, shape: Sequence[int]) -> GridArray:
        if broadcast_shapes(self.shape, shape) != tuple(shape):
            raise ValueError(f"cannot broadcast {self.shape} to {tuple(shape)}")
        return GridArray(_stretch(self.df, self.shape, tuple(shape), ["x"]), shape)

    def repeat(self, n: int, axis: int | None = None) -> GridArray:
        a = self if axis is not None else self.ravel()
        axis = a._axis(axis or 0)
        df = a.df.withColumn("_k", _each(n)) if n else a.df.limit(0).withColumn("_k", F.lit(0))
        df = df.withColumn(f"i{axis}", F.col(f"i{axis}") * n + F.col("_k")).drop("_k")
        return GridArray(df, [m * n if k == axis else m for k, m in enumerate(a.shape)])

    def tile(self, *times: int) -> GridArray:
        a = self
        while a.ndim < len(times):
            a = a.expand_dims(0)
        times = (*[1] * (a.ndim - len(times)), *times)
        df = a.df
        for k, n in enumerate(times):
            if n != 1:
                df = df.withColumn("_k", _each(n)).withColumn(f"i{k}", F.col(f"i{k}") + F.col("_k") * a.shape[k]).drop("_k")
        return GridArray(df.select(*a.axes, "x"), [m * n for m, n in zip(a.shape, times, strict=True)])

    def resize(self, *shape: int) -> GridArray:
        """Cells repeat, or are cut, to fill the new shape."""
        size = math.prod(shape)
        times = -(-size // max(self.size, 1))
        return self.ravel().tile(max(times, 1))[:size].reshape(*shape)

    def roll(self, shift: int, axis: int | None = None) -> GridArray:
        if axis is None:
            return self.ravel().roll(shift, 0).reshape(self.shape)
        axis = self._axis(axis)
        return self._move({a: F.pmod(F.col(a) + shift, F.lit(self.shape[axis])) if k == axis else F.col(a) for k, a in enumerate(self.axes)}, self.shape)

    def pad(self, before: int, after: int, axis: int = 0, mode: str = "constant", value: float = 0.0) -> GridArray:
        """One axis padded. Modes: constant, edge, wrap, reflect, symmetric, maximum, minimum, mean, median, linear_ramp, empty."""
        axis = self._axis(axis)
        n, i = self.shape[axis], f"i{axis}"
        spark = self.df.sparkSession
        shape = [m + before + after if k == axis else m for k, m in enumerate(self.shape)]
        inner = self.df.withColumn(i, F.col(i) + before)
        outside = spark.range(before + after).select(F.when(F.col("id") < before, F.col("id")).otherwise(F.col("id") + n).alias("_t"))
        t = F.col("_t") - before
        maps = {
            "edge": F.greatest(F.lit(0), F.least(t, F.lit(n - 1))),
            "wrap": F.pmod(t, F.lit(n)),
            "symmetric": F.when(F.pmod(t, F.lit(2 * n)) < n, F.pmod(t, F.lit(2 * n))).otherwise(2 * n - 1 - F.pmod(t, F.lit(2 * n))),
            "reflect": F.when(F.pmod(t, F.lit(max(2 * (n - 1), 1))) < n, F.pmod(t, F.lit(max(2 * (n - 1), 1)))).otherwise(2 * (n - 1) - F.pmod(t, F.lit(max(2 * (n - 1), 1)))),
        }
        others = self._keys(axis)
        if mode in maps:
            source = F.broadcast(outside.withColumn("_src", maps[mode].cast("long")))
            new = self.df.join(source, F.col(i) == F.col("_src")).select(*(F.col("_t").alias(a) if a == i else F.col(a) for a in self.axes), "x")
        else:
            stats = {"maximum": A.max_, "minimum": A.min_, "mean": A.mean}
            if mode in ("constant", "empty"):
                lanes = self.df.filter(F.col(i) == 0).select(*others).withColumn("x", F.lit(value if mode == "constant" else None).cast("double"))
            elif mode in stats:
                lanes = self.df.groupBy(*others).agg(stats[mode](F.col("x")).alias("x"))
            elif mode == "median":
                lanes = selection.median(self.df, others, "x", "x")
            elif mode == "linear_ramp":
                lanes = self.df.groupBy(*others).agg(F.max(F.when(F.col(i) == 0, F.col("x"))).alias("_l"), F.max(F.when(F.col(i) == n - 1, F.col("x"))).alias("_r"))
            else:
                raise ValueError(f"unknown mode {mode}")
            new = lanes.crossJoin(F.broadcast(outside))  # before + after positions for each lane: the result itself
            if mode == "linear_ramp":
                left = value + (F.col("_l") - value) * F.col("_t") / max(before, 1)
                right = value + (F.col("_r") - value) * (shape[axis] - 1 - F.col("_t")) / max(after, 1)
                new = new.withColumn("x", F.when(F.col("_t") < before, left).otherwise(right))
            new = new.select(*(F.col("_t").alias(a) if a == i else F.col(a) for a in self.axes), "x")
        return GridArray(inner.unionByName(new), shape)

    def sliding_window_view(self, width: int, axis: int = -1) -> GridArray:
        """A last axis with the `width` cells from each place on."""
        axis = self._axis(axis)
        n = self.shape[axis] - width + 1
        df = self.df.withColumn(f"i{self.ndim}", _each(width))
        df = df.withColumn(f"i{axis}", F.col(f"i{axis}") - F.col(f"i{self.ndim}")).filter((F.col(f"i{axis}") >= 0) & (F.col(f"i{axis}") < n))
        shape = [*(n if k == axis else m for k, m in enumerate(self.shape)), width]
        return GridArray(df.select(*_axes(len(shape)), "x"), shape)

    def as_strided(self, shape: Sequence[int], strides: Sequence[int]) -> GridArray:
        """Cell (j0, j1, ..) is the flat cell sum(j * stride); strides count cells."""
        flat = self.ravel().df.withColumnRenamed("i0", "_f")
        grid = indices_frame(self.df.sparkSession, shape)
        place = sum((F.col(f"i{k}") * s for k, s in enumerate(strides)), F.lit(0).cast("long"))
        return GridArray(grid.withColumn("_f", place).join(flat, "_f").select(*_axes(len(shape)), "x"), shape)

    # Selection

    def __getitem__(self, key) -> GridArray:
        if isinstance(key, GridArray):
            return self.compress(key)
        keys = list(key) if isinstance(key, tuple) else [key]
        if Ellipsis in keys:
            at = keys.index(Ellipsis)
            keys[at : at + 1] = [slice(None)] * (self.ndim - sum(k is not None for k in keys) + 1)
        keys += [slice(None)] * (self.ndim - sum(k is not None for k in keys))
        keep, new, shape, axis = F.lit(True), [], [], 0
        for k in keys:
            if k is None:
                new.append(F.lit(0))
                shape.append(1)
                continue
            i, n = F.col(f"i{axis}"), self.shape[axis]
            if isinstance(k, slice):
                start, stop, step = k.indices(n)
                length = len(range(start, stop, step))
                offset = (i - start) * (1 if step > 0 else -1)
                if (start, step, length) != (0, 1, n):
                    keep = keep & (offset >= 0) & (offset % abs(step) == 0) & (offset < abs(step) * length)
                new.append(F.floor(offset / abs(step)))
                shape.append(length)
            else:
                if not -n <= k < n:
                    raise IndexError(f"index {k} is out of bounds for size {n}")
                keep = keep & (i == k % n)
            axis += 1
        return self._move({f"i{j}": c for j, c in enumerate(new)}, shape, keep)

    def set(self, key, value: GridArray | float) -> GridArray:
        """A copy with the cells that `key` selects replaced: a join of updates, or a condition for a constant."""
        marks = GridArray(self.df.select(*self.axes, self._flat().alias("x")), self.shape)[key]
        wide = value.broadcast_to(marks.shape).df.withColumnRenamed("x", "_new") if isinstance(value, GridArray) else None
        updates = marks.df.withColumnRenamed("x", "_f")
        updates = updates.join(wide, _axes(marks.ndim)) if wide is not None and marks.ndim else updates.crossJoin(wide) if wide is not None else updates.withColumn("_new", F.lit(value))
        updates = updates.select("_f", "_new", F.lit(True).alias("_hit"))
        joined = self.df.withColumn("_f", self._flat()).join(updates, "_f", "left")
        return GridArray(joined.select(*self.axes, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("x")).alias("x")), self.shape)

    def take(self, index: GridArray, axis: int | None = None, mode: str = "raise") -> GridArray:
        """Cells by position along an axis (flat if None): a join on the position."""
        a = self if axis is not None else self.ravel()
        axis = a._axis(axis or 0)
        n = a.shape[axis]
        at = F.col("x").cast("long")
        at = {"wrap": F.pmod(at, F.lit(n)), "clip": F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))}.get(mode, F.when(at < 0, at + n).otherwise(at))
        asked = index.df.select(*(F.col(c).alias(f"_q{k}") for k, c in enumerate(index.axes)), at.alias("_at"))
        joined = a.df.join(asked, F.col(f"i{axis}") == F.col("_at"))
        new = [F.col(f"i{k}") for k in range(axis)] + [F.col(f"_q{k}") for k in range(index.ndim)] + [F.col(f"i{k}") for k in range(axis + 1, a.ndim)]
        shape = [*a.shape[:axis], *index.shape, *a.shape[axis + 1 :]]
        return GridArray(joined.select(*(c.alias(f"_n{k}") for k, c in enumerate(new)), "x").toDF(*_axes(len(shape)), "x"), shape)

    def take_along_axis(self, index: GridArray, axis: int) -> GridArray:
        axis = self._axis(axis)
        keys = self._keys(axis)
        asked = index.df.withColumnRenamed("x", "_at").withColumnRenamed(f"i{axis}", "_q")
        joined = self.df.withColumnRenamed(f"i{axis}", "_at").join(asked, [*keys, "_at"])
        return GridArray(joined.select(*(F.col("_q").alias(a) if a == f"i{axis}" else F.col(a) for a in self.axes), "x"), index.shape)

    def compress(self, condition: GridArray, axis: int | None = None) -> GridArray:
        """Cells (or slices along an axis) where the 1-D condition holds, renumbered."""
        a = self.ravel() if axis is None else self
        axis = a._axis(axis or 0)
        kept = condition.ravel().df.filter(E.truth(F.col("x").cast("double"))).select(F.col("i0").alias("_old")).filter(F.col("_old") < a.shape[axis])
        n = kept.count()
        numbered = ranked(kept, ["_old"], "_new")
        df = a.df.join(numbered, F.col(f"i{axis}") == F.col("_old"))
        shape = [n if k == axis else m for k, m in enumerate(a.shape)]
        return GridArray(df.select(*(F.col("_new").alias(c) if c == f"i{axis}" else F.col(c) for c in a.axes), "x"), shape)

    def extract(self, condition: GridArray) -> GridArray:
        return self.compress(condition)

    def delete(self, positions: Sequence[int], axis: int | None = None) -> GridArray:
        a = self if axis is not None else self.ravel()
        axis = a._axis(axis or 0)
        n, i = a.shape[axis], f"i{axis}"
        gone = sorted({p % n for p in positions})
        shift = sum(((F.col(i) > p).cast("int") for p in gone), F.lit(0))
        df = a.df.filter(~F.col(i).isin(gone)) if gone else a.df
        return GridArray(df.withColumn(i, F.col(i) - shift), [m - len(gone) if k == axis else m for k, m in enumerate(a.shape)])

    def insert(self, position: int, values: GridArray, axis: int | None = None) -> GridArray:
        a = self if axis is not None else self.ravel()
        axis = a._axis(axis or 0)
        cut = [slice(None)] * axis
        return concatenate([a[(*cut, slice(None, position))], values, a[(*cut, slice(position, None))]], axis)

    def put(self, positions: GridArray, values: GridArray) -> GridArray:
        """Flat positions replaced; of repeated positions the last wins."""
        pairs = positions.ravel().df.withColumnRenamed("x", "_f").join(values.ravel().df.withColumnRenamed("x", "_new"), "i0")
        last = pairs.groupBy(F.pmod(F.col("_f").cast("long"), F.lit(self.size)).alias("_f")).agg(F.max_by(F.struct("_new"), "i0").alias("_s"))
        joined = self.df.withColumn("_f", self._flat()).join(last, "_f", "left")
        return GridArray(joined.select(*self.axes, F.when(F.col("_s").isNotNull(), F.col("_s._new")).otherwise(F.col("x")).alias("x")), self.shape)

    def putmask(self, mask: GridArray, values: GridArray | float) -> GridArray:
        return self.apply(lambda a, m, v: F.when(E.truth(m.cast("double")), v).otherwise(a), mask, values)

    def place(self, mask: GridArray, values: GridArray) -> GridArray:
        """Where the mask holds, the values one after the other in order of cells, from the first again when they run out; raises ValueError without any value."""
        if not values.size:
            raise ValueError("no values to place")
        held = mask.df.filter(E.truth(F.col("x").cast("double"))).select(mask._flat().alias("_f"))
        turns = ranked(held, ["_f"], "_turn").select("_f", (F.col("_turn") % values.size).alias("_turn"))
        new = turns.join(values.ravel().df.select(F.col("i0").alias("_turn"), F.struct(F.col("x").alias("_new")).alias("_s")), "_turn").drop("_turn")
        joined = self.df.withColumn("_f", self._flat()).join(new, "_f", "left")
        return GridArray(joined.select(*self.axes, F.when(F.col("_s").isNotNull(), F.col("_s._new")).otherwise(F.col("x")).alias("x")), self.shape)

    def add_at(self, positions: GridArray, values: GridArray) -> GridArray:
        """Flat positions increased, repeated ones each time: ufunc.at for addition."""
        pairs = positions.ravel().df.withColumnRenamed("x", "_f").join(values.ravel().df.withColumnRenamed("x", "_new"), "i0")
        total = pairs.groupBy(F.col("_f").cast("long").alias("_f")).agg(F.sum("_new").alias("_s"))
        joined = self.df.withColumn("_f", self._flat()).join(total, "_f", "left")
        return GridArray(joined.select(*self.axes, (F.col("x") + F.coalesce("_s", F.lit(0.0))).alias("x")), self.shape)

    def add_reduceat(self, bounds: Sequence[int] | GridArray) -> GridArray:
        """Sums of the segments between bounds; of a bound not below the next, the one cell."""
        return self.reduceat(F.sum, bounds)

    def reduceat(self, fold: Callable[[Column], Column], bounds: Sequence[int] | GridArray, axis: int = 0) -> GridArray:
        """The fold of each segment from a bound up to the next, the last to the end of the axis; of a bound not below the next, the one cell.

        Bounds may be the cells of a 1-D array of any size, rising or not, so that
        segments may overlap. Cells are held in blocks, with the folds of FANOUT
        positions, of FANOUT of these and so on as arrays. A segment asks the two
        blocks where it begins and ends; the whole blocks between are a segment of
        the folds of blocks, which goes the same way. So a segment is at most two
        rows for each tier of blocks, a long one is never folded by one task and
        none is compared with all cells. `fold` must give the same when folds are
        folded; it skips masked cells.
        """
        axis = self._axis(axis)
        n, i, keys = self.shape[axis], f"i{axis}", self._keys(axis)
        spark = self.df.sparkSession
        if isinstance(bounds, GridArray):
            given, count = bounds.df.select("i0", F.col("x").cast("long").alias("x")), bounds.shape[0]
        else:
            count = len(bounds)
            given = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bounds)], "i0 long, x long")
        met = neighbours(given, "i0", [], "x", [0, 1]).filter(F.col("i0") >= 0)
        end = F.when(F.col("i0") == count - 1, F.lit(n)).when(F.col("n_p1") > F.col("n_p0"), F.col("n_p1")).otherwise(F.col("n_p0") + 1)
        segments = met.select(F.col("i0").alias("_k"), F.col("n_p0").cast("long").alias("_a"), F.greatest(end, F.col("n_p0") + 1).cast("long").alias("_b"))
        span, lanes = FANOUT**LEVELS, self.size // max(n, 1)
        cells, pieces = self.df.select(*keys, F.col(i).cast("long").alias("_at"), "x"), []
        while True:
            blocks = _blocks(cells, keys, fold)
            a, b = F.col("_a"), F.col("_b")
            first, last = F.floor(a / span), F.floor((b - 1) / span)
            part = lambda block, low, high: F.struct(block.alias("block"), low.cast("int").alias("low"), high.cast("int").alias("high"))
            ends = F.array(part(first, a - first * span, F.lit(span)), part(last, F.lit(0), b - last * span))
            asked = segments.select("_k", F.explode(F.when(first == last, F.array(part(first, a - first * span, b - first * span))).otherwise(ends)).alias("_s"))
            found = asked.select("_k", F.col("_s.block").alias("_block"), F.col("_s.low").alias("_low"), F.col("_s.high").alias("_high")).join(F.broadcast(blocks) if n * lanes <= FEW else blocks, "_block")
            pieces.append(found.select("_k", *keys, _within(F.col("_low"), F.col("_high")).alias("_x")).select("_k", *keys, F.explode("_x").alias("x")))
            if n <= span:
                break
            segments = segments.filter(last - first > 1).select("_k", (first + 1).alias("_a"), last.alias("_b"))
            cells = blocks.select(*keys, F.col("_block").alias("_at"), F.explode(f"_l{LEVELS - 1}").alias("x")).groupBy(*keys, "_at").agg(fold(F.col("x")).alias("x"))
            n = math.ceil(n / span)
        folded = functools.reduce(DataFrame.unionAll, pieces).groupBy("_k", *keys).agg(fold(F.col("x")).alias("x"))
        return GridArray(folded.select(*(F.col("_k" if c == i else c).alias(c) for c in self.axes), "x"), [count if k == axis else m for k, m in enumerate(self.shape)])

    def diagonal(self, offset: int = 0) -> GridArray:
        n = max(0, min(self.shape[0] - max(-offset, 0), self.shape[1] - max(offset, 0)))
        return self._move({"i0": F.col("i0") if offset >= 0 else F.col("i1")}, [n], F.col("i1") - F.col("i0") == offset)

    def trace(self, offset: int = 0) -> GridArray:
        return self.diagonal(offset).sum()

    def tril(self, k: int = 0) -> GridArray:
        return GridArray(self.df.withColumn("x", F.when(F.col(f"i{self.ndim - 1}") - F.col(f"i{self.ndim - 2}") <= k, F.col("x")).otherwise(F.lit(0))), self.shape)

    def triu(self, k: int = 0) -> GridArray:
        return GridArray(self.df.withColumn("x", F.when(F.col(f"i{self.ndim - 1}") - F.col(f"i{self.ndim - 2}") >= k, F.col("x")).otherwise(F.lit(0))), self.shape)

    def trim_zeros(self, trim: str = "fb") -> GridArray:
        """The 1-D array without leading and trailing zeros. Their extent is one aggregation."""
        row = self.df.filter(E.truth("x")).agg(F.min("i0"), F.max("i0")).first()
        if row[0] is None:
            return self[0:0]
        return self[(row[0] if "f" in trim else 0) : (row[1] + 1 if "b" in trim else None)]

    # Linear algebra

    def dot(self, o: GridArray) -> GridArray:
        from gridspan.operators.linalg import dot

        return dot(self, o)

    def matmul(self, o: GridArray) -> GridArray:
        from gridspan.operators.linalg import matmul

        return matmul(self, o)

    # Masks: NULL is masked

    def filled(self, value: float) -> GridArray:
        return self.apply(lambda a: F.coalesce(a, F.lit(value)))

    def compressed(self) -> GridArray:
        kept = self.df.filter("x is not null").select(self._flat().alias("_f"), "x")
        n = kept.count()
        return GridArray(ranked(kept, ["_f"], "i0").select("i0", "x"), [n])

    def mask(self) -> GridArray:
        return self.apply(lambda a: a.isNull())

    def masked_where(self, condition: GridArray) -> GridArray:
        return self.apply(lambda a, c: F.when(~E.truth(c.cast("double")), a), condition)

    def anom(self, axis: int | None = None) -> GridArray:
        return self - self.mean(axis, keepdims=True)


# Building arrays


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    out: list[int] = []
    for sizes in itertools.zip_longest(*(reversed(tuple(s)) for s in shapes), fillvalue=1):
        wide = {n for n in sizes if n != 1}
        if len(wide) > 1:
            raise ValueError(f"shapes {shapes} do not fit each other")
        out.append(wide.pop() if wide else 1)
    return tuple(reversed(out))


def _stretch(df: DataFrame, shape: Sequence[int], wide: Sequence[int], values: Sequence[str]) -> DataFrame:
    """Coordinates of a narrower shape repeated over a wider one."""
    shift, at = len(wide) - len(shape), {}
    for k, n in enumerate(wide):
        own = shape[k - shift] if k >= shift else 1
        at[k] = F.col(f"i{k - shift}") if own == n and k >= shift else None
    out = df.select(*(c.alias(f"_a{k}") for k, c in at.items() if c is not None), *values)
    for k, n in enumerate(wide):
        if at[k] is None:
            out = out.withColumn(f"_a{k}", _each(n) if n > 1 else F.lit(0).cast("long")) if n else out.limit(0).withColumn(f"_a{k}", F.lit(0).cast("long"))
    return out.select(*(F.col(f"_a{k}").cast("long").alias(f"i{k}") for k in range(len(wide))), *values)


def _met(left: DataFrame, shape: Sequence[int], values: Sequence[str], right: DataFrame, other: Sequence[int], value: str, wide: Sequence[int]) -> DataFrame:
    """Cells of two arrays that meet in the wider shape, by the axes that both have; a cell is never repeated before it meets the other side."""

    def own(s: Sequence[int]) -> set[int]:
        return {k for k, n in enumerate(wide) if k >= len(wide) - len(s) and s[k - len(wide) + len(s)] == n != 1}

    here, there = own(shape), own(other)
    a = left.select(*(F.col(f"i{k - len(wide) + len(shape)}").cast("long").alias(f"_a{k}") for k in sorted(here)), *values)
    b = right.select(*(F.col(f"i{k - len(wide) + len(other)}").cast("long").alias(f"_a{k}") for k in sorted(there)), value)
    if math.prod(other) <= FEW:
        b = F.broadcast(b)
    elif math.prod(shape) <= FEW:
        a = F.broadcast(a)
    else:  # the planner's estimate of what a task makes may be far too low for a broadcast
        b = b.hint("merge")
    met = a.join(b, [f"_a{k}" for k in sorted(here & there)]) if here & there else a.crossJoin(b)
    return met.select(*((F.col(f"_a{k}") if k in here | there else F.lit(0).cast("long")).alias(f"i{k}") for k in range(len(wide))), *values, value)


def indices_frame(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All coordinates of a shape, made where they are used."""
    size, df, step = math.prod(shape), None, 1
    columns = {}
    for k in reversed(range(len(shape))):
        columns[k] = (F.floor(F.col("id") / step) % max(shape[k], 1)).cast("long")
        step *= max(shape[k], 1)
    df = spark.range(size)
    return df.select(*(columns[k].alias(f"i{k}") for k in range(len(shape)))) if shape else df.select()


def fromfunction(spark: SparkSession, f: Callable[..., Column], shape: Sequence[int]) -> GridArray:
    grid = spark.range(1).select() if not shape else indices_frame(spark, shape)
    return GridArray(grid.withColumn("x", f(*(F.col(a) for a in _axes(len(shape))))), shape)


def full(spark: SparkSession, shape: int | Sequence[int], value: float) -> GridArray:
    return fromfunction(spark, lambda *_: F.lit(value), [shape] if isinstance(shape, int) else shape)


def zeros(spark, shape):
    return full(spark, shape, 0.0)


def ones(spark, shape):
    return full(spark, shape, 1.0)


empty = zeros


def full_like(a: GridArray, value: float) -> GridArray:
    return GridArray(a.df.withColumn("x", F.lit(value)), a.shape)


def zeros_like(a):
    return full_like(a, 0.0)


def ones_like(a):
    return full_like(a, 1.0)


empty_like = zeros_like


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> GridArray:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return fromfunction(spark, lambda i: F.lit(start) + i * step, [n])


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> GridArray:
    parts = max(num - endpoint, 1)
    last = lambda i: (i == num - 1) & F.lit(endpoint and num > 1)
    return fromfunction(spark, lambda i: F.when(last(i), float(stop)).otherwise(start + i * ((stop - start) / parts)), [num])


def logspace(spark, start, stop, num=50, endpoint=True, base=10.0) -> GridArray:
    return linspace(spark, start, stop, num, endpoint).apply(lambda x: F.pow(F.lit(base), x))


def geomspace(spark, start, stop, num=50, endpoint=True) -> GridArray:
    sign = -1.0 if start < 0 else 1.0
    return linspace(spark, math.log(abs(start)), math.log(abs(stop)), num, endpoint).apply(lambda x: sign * F.exp(x))


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> GridArray:
    return fromfunction(spark, lambda i, j: F.when(j - i == k, 1.0).otherwise(0.0), [n, m or n])


def identity(spark, n):
    return eye(spark, n)


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> GridArray:
    return fromfunction(spark, lambda i, j: F.when(j - i <= k, 1.0).otherwise(0.0), [n, m or n])


def indices(spark: SparkSession, shape: Sequence[int]) -> list[GridArray]:
    return [fromfunction(spark, lambda *at, k=k: at[k], shape) for k in range(len(shape))]


def meshgrid(*arrays: GridArray, indexing: str = "xy") -> list[GridArray]:
    n = len(arrays)
    order = list(range(n))
    if indexing == "xy" and n > 1:
        order[0], order[1] = 1, 0
    shape = [arrays[k].shape[0] for k in sorted(range(n), key=lambda k: order[k])]
    return [a.reshape(*(a.shape[0] if order[k] == j else 1 for j in range(n))).broadcast_to(shape) for k, a in enumerate(arrays)]


def array(spark: SparkSession, values) -> GridArray:
    """A small nested list; None is masked."""
    shape, level = [], values
    while isinstance(level, (list, tuple)):
        shape.append(len(level))
        level = level[0] if level else None
    cells: list[tuple] = []

    def walk(x, at):
        if len(at) == len(shape):
            cells.append((*at, x))
            return
        if len(x) != shape[len(at)]:
            raise ValueError("the nested lists have different lengths")
        for k, y in enumerate(x):
            walk(y, (*at, k))

    if 0 not in shape:
        walk(values, ())
    kind = "boolean" if cells and all(isinstance(c[-1], (bool, type(None))) for c in cells) else "long" if cells and all(isinstance(c[-1], (int, type(None))) for c in cells) else "double"
    if cells and all(isinstance(c[-1], (str, type(None))) for c in cells) and any(isinstance(c[-1], str) for c in cells):
        kind = "string"
    elif kind == "double":
        cells = [(*c[:-1], None if c[-1] is None else float(c[-1])) for c in cells]
    schema = ", ".join([*(f"{a} long" for a in _axes(len(shape))), f"x {kind}"])
    return GridArray(spark.createDataFrame(cells, schema), shape)


def from_column(df: DataFrame, value: str | Column, index: str, n: int | None = None) -> GridArray:
    """A table's column as a 1-D array; `index` holds dense positions from 0."""
    return GridArray(df.select(F.col(index).cast("long").alias("i0"), (F.col(value) if isinstance(value, str) else value).alias("x")), [df.count() if n is None else n])


def from_rows(df: DataFrame, vector: str, row: str, rows: int | None = None, width: int | None = None) -> GridArray:
    """An array column as a matrix: row positions and elements."""
    if width is None:
        width = df.select(F.max(F.size(vector))).first()[0] or 0
    cells = df.select(F.col(row).cast("long").alias("i0"), F.posexplode(vector).alias("i1", "x"))
    found = GridArray(cells.select("i0", F.col("i1").cast("long").alias("i1"), F.col("x").cast("double").alias("x")), [df.count() if rows is None else rows, width])
    found.packed = df, row, vector
    return found


def diag(a: GridArray, k: int = 0) -> GridArray:
    if a.ndim == 2:
        return a.diagonal(k)
    n = a.shape[0] + abs(k)
    grid = indices_frame(a.df.sparkSession, [n, n])
    at = F.when(F.col("i1") - F.col("i0") == k, F.least("i0", "i1"))
    joined = grid.withColumn("_at", at).join(a.df.select(F.col("i0").alias("_at"), "x"), "_at", "left")
    return GridArray(joined.select("i0", "i1", F.when(F.col("_at").isNull(), 0.0).otherwise(F.col("x")).alias("x")), [n, n])


def diagflat(a: GridArray, k: int = 0) -> GridArray:
    return diag(a.ravel(), k)


def vander(a: GridArray, n: int | None = None, increasing: bool = False) -> GridArray:
    n = a.shape[0] if n is None else n
    df = a.df.withColumn("i1", _each(n))
    power = F.col("i1") if increasing else n - 1 - F.col("i1")
    return GridArray(df.select("i0", "i1", F.pow(F.col("x").cast("double"), power).alias("x")), [a.shape[0], n])


# Joining and splitting


def concatenate(arrays: Sequence[GridArray], axis: int | None = 0) -> GridArray:
    """One after the other: coordinates move by the sizes before."""
    if axis is None:
        arrays, axis = [a.ravel() for a in arrays], 0
    axis = arrays[0]._axis(axis)
    df, at = None, 0
    for a in arrays:
        if [*a.shape[:axis], *a.shape[axis + 1 :]] != [*arrays[0].shape[:axis], *arrays[0].shape[axis + 1 :]]:
            raise ValueError("the arrays differ in another axis")
        part = a.df.select(*((F.col(c) + at).alias(c) if c == f"i{axis}" else F.col(c) for c in a.axes), "x")
        df = part if df is None else df.unionByName(part)
        at += a.shape[axis]
    return GridArray(df, [at if k == axis else n for k, n in enumerate(arrays[0].shape)])


def stack(arrays: Sequence[GridArray], axis: int = 0) -> GridArray:
    return concatenate([a.expand_dims(axis) for a in arrays], axis)


def atleast_1d(a: GridArray) -> GridArray:
    return a if a.ndim else a.expand_dims(0)


def atleast_2d(a: GridArray) -> GridArray:
    a = atleast_1d(a)
    return a if a.ndim > 1 else a.expand_dims(0)


def atleast_3d(a: GridArray) -> GridArray:
    a = atleast_2d(a) if a.ndim != 1 else a.expand_dims(0)
    return a if a.ndim > 2 else a.expand_dims(2)


def vstack(arrays: Sequence[GridArray]) -> GridArray:
    return concatenate([atleast_2d(a) for a in arrays], 0)


row_stack = vstack


def hstack(arrays: Sequence[GridArray]) -> GridArray:
    arrays = [atleast_1d(a) for a in arrays]
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def dstack(arrays: Sequence[GridArray]) -> GridArray:
    return concatenate([atleast_3d(a) for a in arrays], 2)


def column_stack(arrays: Sequence[GridArray]) -> GridArray:
    return concatenate([a.expand_dims(1) if a.ndim == 1 else a for a in arrays], 1)


def block(rows: Sequence[Sequence[GridArray]]) -> GridArray:
    return concatenate([concatenate(r, -1) for r in rows], -2)


def unstack(a: GridArray, axis: int = 0) -> list[GridArray]:
    axis = a._axis(axis)
    return [a[(*[slice(None)] * axis, k)] for k in range(a.shape[axis])]


def append(a: GridArray, b: GridArray, axis: int | None = None) -> GridArray:
    return concatenate([a, b], axis)


def array_split(a: GridArray, parts: int | Sequence[int], axis: int = 0) -> list[GridArray]:
    axis = a._axis(axis)
    n = a.shape[axis]
    if isinstance(parts, int):
        sizes = [n // parts + (k < n % parts) for k in range(parts)]
        cuts = [0, *itertools.accumulate(sizes)]
    else:
        cuts = [0, *parts, n]
    return [a[(*[slice(None)] * axis, slice(p, q))] for p, q in itertools.pairwise(cuts)]


def split(a: GridArray, parts: int | Sequence[int], axis: int = 0) -> list[GridArray]:
    if isinstance(parts, int) and a.shape[a._axis(axis)] % parts:
        raise ValueError("the axis does not divide evenly")
    return array_split(a, parts, axis)


def vsplit(a, parts):
    return split(a, parts, 0)


def hsplit(a, parts):
    return split(a, parts, 0 if a.ndim == 1 else 1)


def dsplit(a, parts):
    return split(a, parts, 2)


# Choices


def where(condition: GridArray, a: GridArray | float, b: GridArray | float) -> GridArray:
    return condition.apply(lambda c, x, y: F.when(E.truth(c.cast("double")), x).otherwise(y), a, b)


def select(conditions: Sequence[GridArray], choices: Sequence[GridArray | float], default: float = 0.0) -> GridArray:
    """The choice of the first condition that holds."""
    n = len(conditions)

    def pick(*x: Column) -> Column:
        out = F.lit(default)
        for c, v in reversed(list(zip(x[:n], x[n:], strict=True))):
            out = F.when(E.truth(c.cast("double")), v).otherwise(out)
        return out

    return conditions[0].apply(pick, *conditions[1:], *choices)


def choose(index: GridArray, choices: Sequence[GridArray | float], mode: str = "raise") -> GridArray:
    n = len(choices)

    def pick(i: Column, *x: Column) -> Column:
        i = {"wrap": F.pmod(i, F.lit(n)), "clip": F.greatest(F.lit(0), F.least(i, F.lit(n - 1)))}.get(mode, i)
        out = F.lit(None)
        for k, v in reversed(list(enumerate(x))):
            out = F.when(i == k, v).otherwise(out)
        return out

    return index.apply(pick, *choices)


def piecewise(a: GridArray, conditions: Sequence[GridArray], functions: Sequence[Callable[[Column], Column] | float], default: float = 0.0) -> GridArray:
    """The function of the last condition that holds; one more function is the default."""

    def pick(x: Column, *c: Column) -> Column:
        value = lambda f: f(x) if builtins.callable(f) else F.lit(f)
        out = value(functions[len(conditions)]) if len(functions) > len(conditions) else F.lit(default)
        for on, f in zip(c, functions, strict=False):
            out = F.when(E.truth(on.cast("double")), value(f)).otherwise(out)
        return out

    return a.apply(pick, *conditions)


def array_equal(a: GridArray, b: GridArray) -> bool:
    """Of equal shape and cells: one aggregation."""
    return a.shape == b.shape and not a.apply(lambda x, y: ~F.coalesce(E.equal(x, y), F.lit(False)), b).df.filter("x").limit(1).count()


def array_equiv(a: GridArray, b: GridArray) -> bool:
    try:
        wide = broadcast_shapes(a.shape, b.shape)
    except ValueError:
        return False
    return array_equal(a.broadcast_to(wide), b.broadcast_to(wide))


def allclose(a: GridArray, b: GridArray, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> bool:
    return not a.apply(lambda x, y: ~E.isclose(x, y, rtol, atol, equal_nan), b).df.filter("x").limit(1).count()
