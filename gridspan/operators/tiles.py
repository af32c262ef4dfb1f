"""Matrices as dense tiles: products of matrices without a row for each product of cells.

A tiled matrix is a table (bi, bj, tile): tile (bi, bj) holds up to SIDE x SIDE
cells in order of rows. A product sends the tiles of one side to the columns of
tiles of the other, BLOCK of them at a time; a task multiplies the pairs that it
meets as they come and holds BLOCK x BLOCK tiles of the result at most. A long inner axis is split over tasks, whose sums
are added level by level. A product over the rows of two array columns of one
table needs no tiles: each task sums its own rows. A masked or missing cell counts
as zero, and a cell whose products are all masked is masked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile, pairs of tiles or sums that a task adds up for one tile of a result, tiles of a side of the part of a product that a task makes, and cells that a task takes apart at once.
SIDE, PAIRS, BLOCK, HELD = 256, 64, 8, 1 << 20


class Tiled(NamedTuple):
    df: DataFrame
    rows: int
    columns: int

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.rows // SIDE), -(-self.columns // SIDE)

    def extent(self, bi: int, bj: int) -> tuple[int, int]:
        return min(SIDE, self.rows - bi * SIDE), min(SIDE, self.columns - bj * SIDE)


_TILES = "bi long, bj long, tile array<double>"


#: Cells, and which of them count; None where all do.
Tile = tuple[np.ndarray, np.ndarray | None]


def _list(values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """One list of cells, NULL where they don't count."""
    mask = None if valid is None else ~valid.ravel()
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel().astype(float), mask=mask))


def _tile(column: pa.Array, k: int) -> Tile:
    """The k-th list, flat, with zero for NULL."""
    values = column[k].values
    if not values.null_count:
        return np.asarray(values), None
    return values.fill_null(0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)


def _sum(a: Tile, b: Tile) -> Tile:
    return a[0] + b[0], None if a[1] is None or b[1] is None else a[1] | b[1]


def _product(a: Tile, b: Tile) -> Tile:
    if a[1] is None and b[1] is None:
        return a[0] @ b[0], None
    one = [np.ones(x.shape) if valid is None else valid.astype(float) for x, valid in (a, b)]
    return a[0] @ b[0], one[0] @ one[1] > 0


def _pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(k, at, x): the cells (k, at, x) of each key as one row."""
    k, at, x = (column.to_numpy() for column in pa.Table.from_batches(batches).columns)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    ends = pa.array(np.append(first, len(k)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(k[first]), *(pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (at, x))], ["k", "at", "x"])


def gathered(df: DataFrame, key: Column, at: Column, x: Column, make: Callable[[int, list[tuple[np.ndarray, np.ndarray]]], pa.RecordBatch], schema: str, every: int = 0) -> DataFrame:
    """What `make` makes of each key with the places and values of its cells, in pieces; of the keys below `every` also without a cell.

    A task takes HELD cells at a time apart by key; the pieces meet in a shuffle,
    one key after the other. No row for a cell is held, sorted or shuffled.
    """
    held = HELD

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = [], 0
        for batch in batches:
            now.append(batch)
            size += batch.num_rows
            if size >= held:
                yield _pieces(now)
                now, size = [], 0
        if size:
            yield _pieces(now)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                k = batch.column(0)[row].as_py()
                if k != now and parts:
                    yield make(now, parts)
                    parts = []
                now = k
                parts.append((np.asarray(batch.column(1)[row].values), np.asarray(batch.column(2)[row].values)))
        if parts:
            yield make(now, parts)

    rows = df.select(key.cast("long").alias("k"), at.cast("int").alias("at"), x.cast("double").alias("x"))
    pieces = rows.mapInArrow(cut, "k long, at array<int>, x array<double>")
    if every:
        none = df.sparkSession.range(every).select(F.col("id").alias("k"), F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("x"))
        pieces = pieces.unionByName(none)
    return pieces.repartition("k").sortWithinPartitions("k").mapInArrow(run, schema)


def tiled(df: DataFrame, rows: int, columns: int, whole: bool = False) -> Tiled:
    """Of cells (i0, i1, x). whole: with the tiles in which no cell counts."""
    side, shape = SIDE, Tiled(df, rows, columns)
    wide = shape.grid[1]

    def tile(k: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bi, bj = divmod(k, wide)
        block = np.zeros((min(side, rows - bi * side), min(side, columns - bj * side)))
        valid = np.zeros(block.shape, bool)
        for at, x in parts:
            r, c = np.divmod(at, side)
            block[r, c], valid[r, c] = x, True
        return pa.RecordBatch.from_arrays([pa.array([bi]), pa.array([bj]), _list(block, None if valid.all() else valid)], ["bi", "bj", "tile"])

    key, at = F.expr(f"i0 div {side} * {wide} + i1 div {side}"), F.col("i0") % side * side + F.col("i1") % side
    return shape._replace(df=gathered(df.filter("x is not null"), key, at, F.col("x"), tile, _TILES, shape.grid[0] * wide if whole else 0))


def cells(t: Tiled) -> DataFrame:
    """(i0, i1, x)."""
    side, columns = SIDE, t.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj, tile = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                at = np.arange(len(tile))
                wide = min(side, columns - bj * side)
                yield pa.RecordBatch.from_arrays([pa.array(bi * side + at // wide), pa.array(bj * side + at % wide), tile], ["i0", "i1", "x"])

    return t.df.mapInArrow(run, "i0 long, i1 long, x double")


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _added(parts: DataFrame, most: int) -> DataFrame:
    """(bi, bj, tile): sums of tiles. parts: (bi, bj, s, tile), s from 0 to most - 1, a bounded number of them for a task at each level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key, tile = tuple(batch.column(c)[k].as_py() for c in range(3)), _tile(batch.column(3), k)
                if key != now:
                    if now is not None:
                        yield _part(now, total)
                    now, total = key, tile
                else:
                    total = _sum(total, tile)
        if now is not None:
            yield _part(now, total)

    while True:
        level = parts.withColumn("s", F.expr(f"s div {PAIRS}")).repartition("bi", "bj", "s").sortWithinPartitions("bi", "bj", "s")
        parts, most = level.mapInArrow(run, "bi long, bj long, s long, tile array<double>"), -(-most // PAIRS)
        if most <= 1:
            return parts.drop("s")


def _part(key: tuple[int, int, int], tile: Tile) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), _list(*tile)], ["bi", "bj", "s", "tile"])


def _square(high: int, wide: int, tasks: int) -> int:
    """Rows and columns of tiles of the result that a task makes together: as many, BLOCK at most, as leave work for all."""
    return max((p for p in range(1, BLOCK + 1) if -(-high // p) * -(-wide // p) >= tasks), default=1)


def multiply(a: Tiled, b: Tiled) -> Tiled:
    """a @ b."""
    splits = -(-a.grid[1] // PAIRS)
    (high, _), (_, wide) = a.grid, b.grid
    p = _square(high, wide, 2 * a.df.sparkSession.sparkContext.defaultParallelism)
    s = lambda column: F.expr(f"{column} div {PAIRS}").alias("s")
    left = a.df.select(F.expr(f"bi div {p}").alias("i"), _numbers(-(-wide // p)).alias("j"), s("bj"), F.col("bj").alias("k"), F.lit(0).alias("side"), F.col("bi").alias("at"), "tile")
    right = b.df.select(_numbers(-(-high // p)).alias("i"), F.expr(f"bj div {p}").alias("j"), s("bi"), F.col("bi").alias("k"), F.lit(1).alias("side"), F.col("bj").alias("at"), "tile")
    met = left.unionByName(right).repartition("i", "j", "s").sortWithinPartitions("i", "j", "s", "k", "side", "at")
    inner, side = a.columns, SIDE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, level, totals = None, {}, None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                i, j, split, k, which, at = (batch.column(c)[row].as_py() for c in range(6))
                if (i, j, split) != now:
                    for (bi, bj), total in totals.items():
                        yield _part((bi, bj, now[2]), total)
                    now, level, totals = (i, j, split), None, {}
                if k != level:
                    held, level = {}, k
                depth = min(side, inner - k * side)
                rows_of = (-1, depth) if which == 0 else (depth, -1)
                tile = tuple(None if part is None else part.reshape(rows_of) for part in _tile(batch.column(6), row))
                if which == 0:
                    held[at] = tile
                    continue
                for bi, one in held.items():
                    product = _product(one, tile)
                    totals[bi, at] = _sum(totals[bi, at], product) if (bi, at) in totals else product
        for (bi, bj), total in totals.items():
            yield _part((bi, bj, now[2]), total)

    parts = met.mapInArrow(run, "bi long, bj long, s long, tile array<double>")
    return Tiled(_added(parts, splits) if splits > 1 else parts.drop("s"), a.rows, b.columns)


def over_rows(df: DataFrame, left: str, right: str, rows: int, columns: int) -> Tiled:
    """The sum over all rows of the outer products of two array columns; each task sends one matrix of rows x columns."""
    side = SIDE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                a, b = (padded(batch.column(k), n) for k, n in ((0, rows), (1, columns)))
                total += a.T @ b
        task = TaskContext.get().partitionId()
        for bi in range(-(-rows // side)):
            for bj in range(-(-columns // side)):
                yield _part((bi, bj, task), (total[bi * side : (bi + 1) * side, bj * side : (bj + 1) * side], None))

    doubles = df.select(F.col(left).cast("array<double>").alias("l"), F.col(right).cast("array<double>").alias("r"))
    return Tiled(_added(doubles.mapInArrow(run, "bi long, bj long, s long, tile array<double>"), df.rdd.getNumPartitions()), rows, columns)


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; what is missing or null is zero."""
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = np.nan_to_num(np.asarray(column.flatten().fill_null(0.0)), nan=np.nan)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out, row = np.zeros((len(size), width)), np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    fit = place < width
    out[row[fit], place[fit]] = flat[fit]
    return out


