"""Fourier transforms, convolution, and tapers.

A lane is what lies along the transformed axis. Lanes of up to LANE cells are
transformed many at a time in tasks, straight from an array column where the
array was made of one. A longer lane of n = p q cells takes four steps: q short
lanes of p cells, a turn of each result, p short lanes of q cells, and places
that follow from the two; so no group is larger than about the root of n. Where
n has no factors near its root, it is turned into a convolution of a length that
has them (Bluestein). Several axes are transformed one after the other. A
complex array has a last axis of two: real and imaginary parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.array import FEW, GridArray, array, fromfunction

#: Cells of a lane that is transformed at once, cells made at a time, and cells of an operand that every block of the other meets.
LANE, MADE, KERNEL = 4_096, 1 << 20, 1_024


def _fields(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, places, real and imaginary parts of the last column's lanes."""
    lanes = batch.column(batch.num_columns - 1)
    flat = lanes.flatten()
    return np.asarray(lanes.offsets) - lanes.offsets[0].as_py(), *(np.asarray(flat.field(k)) for k in range(3))


def _cells(batch: pa.RecordBatch, keys: int, first: int, found: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows (keys, place, re, im) of the lanes from `first` on."""
    lanes, n = found.shape
    held = [pa.array(np.repeat(np.asarray(batch.column(k))[first : first + lanes], n)) for k in range(keys)]
    flat = found.ravel()
    return pa.RecordBatch.from_arrays([*held, pa.array(np.tile(np.arange(n), lanes)), pa.array(flat.real.copy()), pa.array(flat.imag.copy())], names)


def _turned(n: int, sign: int, keep: int, whole: int | None):
    """numpy's transform of rows, unscaled, its first `keep` results; with `whole`, each turned by its place times the lane's own."""

    def run(block: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        found = (np.fft.fft(block, n) if sign < 0 else np.fft.ifft(block, n, norm="forward"))[:, :keep]
        if whole is not None:
            found = found * np.exp(sign * 2j * math.pi * (own[:, None] * np.arange(keep) % whole) / whole)
        return found

    return run


def _lanes(df: DataFrame, keys: Sequence[str], axis: str, n: int, sign: int, keep: int | None = None, whole: int | None = None) -> DataFrame:
    """(keys, axis, re, im): the transform of each lane of n cells at most. The last key is the lane's own place where `whole` is given."""
    keep = n if keep is None else keep
    turned, names = _turned(n, sign, keep, whole), [*keys, axis, "re", "im"]
    grouped = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).cast("long").alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("_lane"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, at, re, im = _fields(batch)
            some = max(1, MADE // n)
            for first in range(0, batch.num_rows, some):
                last = min(first + some, batch.num_rows)
                part = slice(offsets[first], offsets[last])
                block = np.zeros((last - first, n), complex)
                # Halves of a cell are added.
                np.add.at(block, (np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1])), at[part]), re[part] + 1j * im[part])
                yield _cells(batch, len(keys), first, turned(block, np.asarray(batch.column(len(keys) - 1))[first:last] if whole is not None else None), names)

    return grouped.mapInArrow(run, ", ".join(f"{c} {'double' if c in ('re', 'im') else 'long'}" for c in names))


def _rows(packed: DataFrame, row: str, vector: str, n: int, keep: int) -> DataFrame:
    """(i0, i1, re, im): the transform of each array of a column; no shuffle."""
    turned, names = _turned(n, -1, keep, None), ["i0", "i1", "re", "im"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = batch.column(1)
            offsets = np.asarray(lanes.offsets) - lanes.offsets[0].as_py()
            flat = np.asarray(lanes.flatten().fill_null(0.0)).astype(float)
            some = max(1, MADE // n)
            for first in range(0, batch.num_rows, some):
                last = min(first + some, batch.num_rows)
                block, at = np.zeros((last - first, n)), np.arange(offsets[first], offsets[last])
                lane = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
                place = at - offsets[first:last][lane]
                fit = place < n
                block[lane[fit], place[fit]] = flat[at[fit]]
                yield _cells(batch, 1, first, turned(block, None), names)

    return packed.filter(F.col(vector).isNotNull()).select(F.col(row).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "i0 long, i1 long, re double, im double")


def _near_root(n: int) -> int:
    """The largest divisor of n that is not above its root."""
    return next(p for p in range(math.isqrt(n), 0, -1) if n % p == 0)


def _fourier(df: DataFrame, keys: Sequence[str], axis: str, n: int, sign: int, keep: int | None = None) -> DataFrame:
    """(keys, axis, re, im): the unscaled transform of length n; cells from n on are left out. df has such columns too."""
    keys, at = list(keys), F.col(axis)
    df = df.filter(at < n)
    if n <= LANE:
        return _lanes(df, keys, axis, n, sign, keep)
    p = _near_root(n)
    if p * 8 < math.isqrt(n):
        return _chirped(df, keys, axis, n, sign, keep)
    q = n // p
    apart = df.select(*keys, F.expr(f"{axis} div {q}").alias("_a"), (at % q).alias("_b"), "re", "im")
    first = _lanes(apart, [*keys, "_b"], "_a", p, sign, whole=n)
    second = _lanes(first, [*keys, "_a"], "_b", q, sign)
    found = second.select(*keys, (F.col("_a") + p * F.col("_b")).alias(axis), "re", "im")
    return found if keep is None else found.filter(at < keep)


def _other(df: DataFrame, m: int) -> DataFrame:
    """A transform of m cells as one side of a join; the planner's estimate, made from what it is of, is far too low."""
    return F.broadcast(df) if m <= FEW else df.hint("merge")


def _times(re: Column, im: Column, c: Column, s: Column) -> list[Column]:
    """(re + i im) (c + i s)."""
    return [(re * c - im * s).alias("re"), (re * s + im * c).alias("im")]


def _chirped(df: DataFrame, keys: Sequence[str], axis: str, n: int, sign: int, keep: int | None) -> DataFrame:
    """A transform of any length by a circular convolution whose length is a power of two."""
    m, at = 1 << (2 * n - 1).bit_length(), F.col(axis)
    angle = lambda k: F.pmod(k * k, F.lit(2 * n)) * (math.pi / n)
    led = df.select(*keys, axis, *_times(F.col("re"), F.col("im"), F.cos(angle(at)), sign * F.sin(angle(at))))
    # The counter-chirp lies around place 0: the last n - 1 places are the negative ones.
    k = F.when(F.col("id") < n, F.col("id")).when(F.col("id") > m - n, m - F.col("id"))
    chirp = df.sparkSession.range(m).select(F.col("id").alias(axis), k.alias("_k")).filter("_k is not null").select(axis, F.cos(angle(F.col("_k"))).alias("re"), (-sign * F.sin(angle(F.col("_k")))).alias("im"))
    other = _other(_fourier(chirp, [], axis, m, -1).toDF(axis, "_c", "_s"), m)
    product = _fourier(led, keys, axis, m, -1).join(other, axis).select(*keys, axis, *_times(F.col("re"), F.col("im"), F.col("_c"), F.col("_s")))
    back = _fourier(product, keys, axis, m, 1, n if keep is None else keep)
    return back.select(*keys, axis, *_times(F.col("re") / m, F.col("im") / m, F.cos(angle(at)), sign * F.sin(angle(at))))


def _frame(a: GridArray, complex_in: bool) -> DataFrame:
    """(i0.., re, im); the halves of a complex cell are two rows, which sums join."""
    nd = a.ndim - complex_in
    x, axes = F.col("x").cast("double"), [F.col(f"i{k}").cast("long").alias(f"i{k}") for k in range(nd)]
    x = F.coalesce(x, F.lit(0.0))
    if not complex_in:
        return a.df.select(*axes, x.alias("re"), F.lit(0.0).alias("im"))
    half = F.col(f"i{nd}")
    return a.df.select(*axes, F.when(half == 0, x).otherwise(0.0).alias("re"), F.when(half == 1, x).otherwise(0.0).alias("im"))


def _complex(df: DataFrame, shape: Sequence[int], scale: float = 1.0) -> GridArray:
    axes = [f"i{k}" for k in range(len(shape))]
    halves = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("p"), (F.col(c) * scale).alias("x")) for k, c in enumerate(("re", "im"))))).alias("_h")
    return GridArray(df.select(*axes, halves).select(*axes, F.col("_h.p").alias(f"i{len(shape)}"), F.col("_h.x").alias("x")), [*shape, 2])


def _real(df: DataFrame, shape: Sequence[int], scale: float = 1.0) -> GridArray:
    return GridArray(df.select(*(f"i{k}" for k in range(len(shape))), (F.col("re") * scale).alias("x")), shape)


def _scale(n: int, inverse: bool, norm: str | None) -> float:
    return {None: 1 / n if inverse else 1.0, "backward": 1 / n if inverse else 1.0, "forward": 1.0 if inverse else 1 / n, "ortho": 1 / math.sqrt(n)}[norm]


def _along(df: DataFrame, shape: list[int], axis: int, n: int, sign: int, keep: int | None = None) -> DataFrame:
    """One axis of a frame; shape follows."""
    found = _fourier(df, [f"i{k}" for k in range(len(shape)) if k != axis], f"i{axis}", n, sign, keep)
    shape[axis] = n if keep is None else keep
    return found.select(*(f"i{k}" for k in range(len(shape))), "re", "im")


def _forward(a: GridArray, n: int | None, axis: int, complex_in: bool, keep: Callable[[int], int]) -> tuple[DataFrame, list[int], int]:
    nd = a.ndim - complex_in
    axis, shape = axis % nd, list(a.shape[:nd])
    n = n or shape[axis]
    if a.packed is not None and not complex_in and axis == 1 and n <= LANE:
        shape[1] = keep(n)
        return _rows(*a.packed, n, shape[1]), shape, n
    return _along(_frame(a, complex_in), shape, axis, n, -1, keep(n)), shape, n


def _mirrored(df: DataFrame, axis: str, n: int) -> DataFrame:
    """The whole spectrum of a real lane of n cells from its first half."""
    k, rest = F.col(axis), [c for c in df.columns if c not in (axis, "re", "im")]
    own = F.struct(k.alias("k"), F.col("re"), F.when((k == 0) | (2 * k == n), 0.0).otherwise(F.col("im")).alias("im"))
    other = F.struct((n - k).alias("k"), F.col("re"), (-F.col("im")).alias("im"))
    both = F.explode(F.when((k > 0) & (2 * k < n), F.array(own, other)).otherwise(F.array(own))).alias("_m")
    return df.filter(2 * k <= n).select(*rest, both).select(*rest, F.col("_m.k").alias(axis), "_m.re", "_m.im")


def _back_to_real(df: DataFrame, shape: list[int], axis: int, n: int, conjugate: bool = False) -> DataFrame:
    whole = _mirrored(df.withColumn("im", -F.col("im")) if conjugate else df, f"i{axis}", n)
    return _along(whole, shape, axis, n, 1)


def fft(a: GridArray, n: int | None = None, axis: int = -1, complex_in: bool = False, norm: str | None = None) -> GridArray:
    found, shape, n = _forward(a, n, axis, complex_in, lambda n: n)
    return _complex(found, shape, _scale(n, False, norm))


def ifft(a: GridArray, n: int | None = None, axis: int = -1, complex_in: bool = True, norm: str | None = None) -> GridArray:
    shape = list(a.shape[: a.ndim - complex_in])
    axis %= len(shape)
    n = n or shape[axis]
    return _complex(_along(_frame(a, complex_in), shape, axis, n, 1), shape, _scale(n, True, norm))


def rfft(a: GridArray, n: int | None = None, axis: int = -1, norm: str | None = None) -> GridArray:
    found, shape, n = _forward(a, n, axis, False, lambda n: n // 2 + 1)
    return _complex(found, shape, _scale(n, False, norm))


def irfft(a: GridArray, n: int | None = None, axis: int = -1, norm: str | None = None) -> GridArray:
    shape = list(a.shape[:-1])
    axis %= len(shape)
    n = n or 2 * (shape[axis] - 1)
    return _real(_back_to_real(_frame(a, True), shape, axis, n), shape, _scale(n, True, norm))


def hfft(a: GridArray, n: int | None = None, axis: int = -1) -> GridArray:
    shape = list(a.shape[:-1])
    axis %= len(shape)
    n = n or 2 * (shape[axis] - 1)
    return _real(_back_to_real(_frame(a, True), shape, axis, n, conjugate=True), shape)


def ihfft(a: GridArray, n: int | None = None, axis: int = -1) -> GridArray:
    found, shape, n = _forward(a, n, axis, False, lambda n: n // 2 + 1)
    return _complex(found.withColumn("im", -F.col("im")), shape, 1 / n)


def fftn(a: GridArray, axes: Sequence[int] | None = None, complex_in: bool = False) -> GridArray:
    return _each(a, axes, complex_in, -1)


def ifftn(a: GridArray, axes: Sequence[int] | None = None, complex_in: bool = True) -> GridArray:
    return _each(a, axes, complex_in, 1)


def _each(a: GridArray, axes: Sequence[int] | None, complex_in: bool, sign: int) -> GridArray:
    df, shape = _frame(a, complex_in), list(a.shape[: a.ndim - complex_in])
    axes = [k % len(shape) for k in (range(len(shape)) if axes is None else axes)]
    for k in axes:
        df = _along(df, shape, k, shape[k], sign)
    return _complex(df, shape, 1 / math.prod(shape[k] for k in axes) if sign > 0 else 1.0)


def fft2(a, complex_in: bool = False):
    return fftn(a, (-2, -1), complex_in)


def ifft2(a, complex_in: bool = True):
    return ifftn(a, (-2, -1), complex_in)


def rfftn(a: GridArray, axes: Sequence[int] | None = None) -> GridArray:
    axes = [k % a.ndim for k in (range(a.ndim) if axes is None else axes)]
    df, shape, _ = _forward(a, None, axes[-1], False, lambda n: n // 2 + 1)
    for k in axes[:-1]:
        df = _along(df, shape, k, shape[k], -1)
    return _complex(df, shape)


def irfftn(a: GridArray, axes: Sequence[int] | None = None) -> GridArray:
    df, shape = _frame(a, True), list(a.shape[:-1])
    axes = [k % len(shape) for k in (range(len(shape)) if axes is None else axes)]
    for k in axes[:-1]:
        df = _along(df, shape, k, shape[k], 1)
    n = 2 * (shape[axes[-1]] - 1)
    scale = 1 / (math.prod(shape[k] for k in axes[:-1]) * n)
    return _real(_back_to_real(df, shape, axes[-1], n), shape, scale)


def rfft2(a):
    return rfftn(a, (-2, -1))


def irfft2(a):
    return irfftn(a, (-2, -1))


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> GridArray:
    return fromfunction(spark, lambda i: F.when(i < (n + 1) // 2, i).otherwise(i - n) / (n * d), [n])


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> GridArray:
    return fromfunction(spark, lambda i: i / (n * d), [n // 2 + 1])


def fftshift(a: GridArray, axes: Sequence[int] | None = None) -> GridArray:
    for k in range(a.ndim) if axes is None else axes:
        a = a.roll(a.shape[k] // 2, k)
    return a


def ifftshift(a: GridArray, axes: Sequence[int] | None = None) -> GridArray:
    for k in range(a.ndim) if axes is None else axes:
        a = a.roll(-(a.shape[k] // 2), k)
    return a


def _spread(a: GridArray, kernel: Sequence[float]) -> DataFrame:
    """Each cell goes to as many places as the kernel has weights and meets the others in one sum."""
    weights = F.array(*(F.struct(F.lit(k).cast("long").alias("p"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)))
    spread = a.df.withColumn("_k", F.explode(weights))
    return spread.groupBy((F.col("i0") + F.col("_k.p")).alias("i0")).agg(F.sum(F.col("x") * F.col("_k.w")).alias("x"))


def _saved(a: GridArray, b: GridArray) -> DataFrame:
    """Overlap-save: blocks of a, each with the end of the one before, meet all of b, which has KERNEL cells at most."""
    n, m = a.shape[0], b.shape[0]
    size = max(LANE, 1 << (4 * m - 1).bit_length())
    step = size - m + 1
    at, q = F.col("i0"), F.expr(f"i0 div {step}")
    later = F.when(at % step > step - m, F.array(q, q + 1)).otherwise(F.array(q))  # the next block needs the last m - 1 cells
    cells = a.df.select(at, F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.explode(later).alias("_q"))
    blocks = cells.groupBy("_q").agg(F.collect_list(F.struct((at - F.col("_q") * step + (m - 1)).alias("at"), F.col("x"))).alias("_a"))
    kernel = b.df.agg(F.collect_list(F.struct(F.col("i0").alias("at"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))).alias("_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q = batch.column(0)[k].as_py()
                block, weights = np.zeros(size), np.zeros(size)
                for held, column in ((block, 1), (weights, 2)):
                    cells = batch.column(column)[k].values
                    held[np.asarray(cells.field(0))] = np.asarray(cells.field(1))
                found = np.fft.irfft(np.fft.rfft(block) * np.fft.rfft(weights), size)[m - 1 :]
                keep = max(0, min(step, n + m - 1 - q * step))
                yield pa.RecordBatch.from_arrays([pa.array(q * step + np.arange(keep)), pa.array(found[:keep].copy())], ["i0", "x"])

    return blocks.crossJoin(F.broadcast(kernel)).mapInArrow(run, "i0 long, x double")  # one row, KERNEL cells


def _multiplied(a: GridArray, b: GridArray) -> DataFrame:
    """Two long operands: the transform of their convolution is the product of their transforms."""
    size = a.shape[0] + b.shape[0] - 1
    m = 1 << (size - 1).bit_length()
    other = _other(_fourier(_frame(b, False), [], "i0", m, -1).toDF("i0", "_c", "_s"), m)
    product = _fourier(_frame(a, False), [], "i0", m, -1).join(other, "i0").select("i0", *_times(F.col("re"), F.col("im"), F.col("_c"), F.col("_s")))
    return _fourier(product, [], "i0", m, 1, size).select("i0", (F.col("re") / m).alias("x"))


def convolve(a: GridArray, kernel: Sequence[float] | GridArray, mode: str = "full") -> GridArray:
    """Of a 1-D array and weights or another array; either may be long. A masked cell counts as zero where the other has over 64 cells."""
    n, m = a.shape[0], kernel.shape[0] if isinstance(kernel, GridArray) else len(kernel)
    if not isinstance(kernel, GridArray) and m <= 64:
        found = _spread(a, kernel)
    else:
        b = kernel if isinstance(kernel, GridArray) else array(a.df.sparkSession, list(kernel))
        long, short = (a, b) if n >= m else (b, a)
        found = _saved(long, short) if min(n, m) <= KERNEL else _multiplied(long, short)
    whole = GridArray(found, [n + m - 1])
    if mode == "full":
        return whole
    length = max(n, m) if mode == "same" else max(n, m) - min(n, m) + 1
    start = (n + m - 1 - length) // 2
    return whole[start : start + length]


def correlate(a: GridArray, kernel: Sequence[float] | GridArray, mode: str = "valid") -> GridArray:
    return convolve(a, kernel.flip() if isinstance(kernel, GridArray) else list(kernel)[::-1], mode)


def _taper(f: Callable) -> Callable[[SparkSession, int], GridArray]:
    return lambda spark, n: fromfunction(spark, (lambda i: F.lit(1.0)) if n == 1 else (lambda i: f(i, n)), [max(n, 0)])


_turn = lambda i, n, k=1: F.cos(i * (2 * math.pi * k / (n - 1)))
hanning = _taper(lambda i, n: 0.5 - 0.5 * _turn(i, n))
hamming = _taper(lambda i, n: 0.54 - 0.46 * _turn(i, n))
blackman = _taper(lambda i, n: 0.42 - 0.5 * _turn(i, n) + 0.08 * _turn(i, n, 2))
bartlett = _taper(lambda i, n: 1 - F.abs(i * 2.0 / (n - 1) - 1))


def kaiser(spark: SparkSession, n: int, beta: float) -> GridArray:
    from gridspan.functions.elementwise import i0

    if n == 1:
        return fromfunction(spark, lambda i: F.lit(1.0), [1])
    centre = (n - 1) / 2
    scale = float(np.i0(beta))
    return fromfunction(spark, lambda i: i0(beta * F.sqrt(F.greatest(1 - F.pow((i - centre) / centre, 2), F.lit(0.0)))) / scale, [n])
