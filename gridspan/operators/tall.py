"""Orthogonal factors of tall matrices by a tree of small ones.

Rows are taken in strips; each strip is factored by itself, and the triangles
go up a tree, FAN at a time, until one is left: R. Q comes back down: the piece
of each strip is its own factor times that of its triangle, level by level. A
task holds one strip or the triangles of one node. The diagonal of R is not
negative, so factors of full rank don't depend on the strips. A masked cell
counts as zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.operators import tiles

#: Rows of a strip; cells of the triangles that one node takes, and at most so many triangles.
STRIP, CELLS, FAN = 1024, 1 << 23, 64


def _factor(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(block)
    signs = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return q * signs, signs[:, None] * r


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))


_NODE = "s long, g long, q array<double>, r array<double>"


def _node(s: int, g: int, q: np.ndarray, r: np.ndarray | None) -> pa.RecordBatch:
    triangle = pa.array([None], pa.list_(pa.float64())) if r is None else _list(r)
    return pa.RecordBatch.from_arrays([pa.array([s]), pa.array([g]), _list(q), triangle], ["s", "g", "q", "r"])


def _strips(df: DataFrame, rows: int, columns: int, height: int) -> DataFrame:
    """(s, g, q, r): the factors of each strip of cells (i0, i1, x); g = s."""

    def strip(s: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block = np.zeros(max(columns, min(height, rows - s * height)) * columns)  # the last strip may be shorter than wide
        for at, x in parts:
            block[at] = x
        return _node(s, s, *_factor(block.reshape(-1, columns)))

    at = F.col("i0") % height * columns + F.col("i1")
    return tiles.gathered(df, F.expr(f"i0 div {height}"), at, F.coalesce(F.col("x").cast("double"), F.lit(0.0)), strip, _NODE)


def _up(triangles: DataFrame, columns: int, fan: int) -> DataFrame:
    """(s, g, q, r) of (s, r): nodes g of `fan` triangles; the first of a node has its r."""
    met = triangles.select(F.expr(f"s div {fan}").alias("g"), "s", "r").repartition("g").sortWithinPartitions("g", "s")

    def node(g: int, held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        q, r = _factor(np.concatenate([t for _, t in held]))
        for k, (s, _) in enumerate(held):
            yield _node(s, g, q[k * columns : (k + 1) * columns], None if k else r)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                g, s = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if g != now and held:
                    yield from node(now, held)
                    held = []
                now = g
                held.append((s, np.asarray(batch.column(2)[k].values).reshape(columns, columns)))
        if held:
            yield from node(now, held)

    return met.mapInArrow(run, _NODE)


def _tree(df: DataFrame, rows: int, columns: int) -> tuple[list[DataFrame], int]:
    """Levels from the strips to the root, and rows of a strip."""
    height, fan = max(STRIP, columns), max(2, min(FAN, CELLS // columns**2))
    levels, nodes = [_strips(df, rows, columns, height)], -(-rows // height)
    while nodes > 1:
        triangles = levels[-1].filter("r is not null").select(F.col("g").alias("s"), "r")
        levels.append(_up(triangles, columns, fan))
        nodes = -(-nodes // fan)
    return levels, height


def triangle(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Cells (i0, i1, x) of R, columns x columns."""
    root = _tree(df, rows, columns)[0][-1].filter("r is not null")
    cells = root.select(F.posexplode("r").alias("_k", "x"))
    return cells.select(F.expr(f"_k div {columns}").alias("i0"), (F.col("_k") % columns).cast("long").alias("i1"), "x")


def orthogonal(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Cells (i0, i1, x) of Q, rows x columns."""
    levels, height = _tree(df, rows, columns)

    def times(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q, above = (np.asarray(batch.column(c)[k].values).reshape(-1, columns) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), _list(q @ above)], ["s", "q"])

    down = levels[-1].select("s", "q")
    for level in reversed(levels[:-1]):
        met = level.select("s", "g", "q").join(down.select(F.col("s").alias("g"), F.col("q").alias("_above")), "g")
        down = met.select("s", "q", "_above").mapInArrow(times, "s long, q array<double>")
    cells = down.select("s", F.posexplode("q").alias("_k", "x"))
    place = cells.select((F.col("s") * height + F.expr(f"_k div {columns}")).alias("i0"), (F.col("_k") % columns).cast("long").alias("i1"), "x")
    return place.filter(F.col("i0") < rows)
