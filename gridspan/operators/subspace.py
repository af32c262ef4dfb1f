"""Leading eigenvalues and vectors of symmetric matrices that fit no task, by block subspace iteration.

A block of vectors, somewhat wider than what is asked for, is multiplied by the
tiles of the matrix, made orthogonal by the tree for tall matrices, and turned
towards the eigenvectors by the small matrix of its products (Rayleigh and Ritz),
until the residual of each wanted vector is small. The driver sees that small
matrix and the residuals; blocks are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.array import GridArray, array
from gridspan.functions.random import uniform01
from gridspan.operators import tall, tiles
from gridspan.operators.blocked import written
from gridspan.operators.tiles import Tiled
from gridspan.session import forget

_CELLS = "i0 long, i1 long, x double"


def _matrix(cells: DataFrame, rows: int, columns: int) -> np.ndarray:
    """A small matrix on the driver."""
    out = np.zeros((rows, columns))
    for r in cells.collect():
        out[r["i0"], r["i1"]] = r["x"]
    return out


def leading(a: GridArray | Sequence[GridArray], k: int, tol: float = 1e-9, rounds: int = 200) -> tuple[GridArray, GridArray]:
    """The k eigenvalues of largest size, largest first, and their vectors as columns; of equal size, in any order, and of vectors either sign.

    Stops when each residual |a v - w v| is at most tol times the largest value;
    raises LinAlgError if `rounds` products don't get there. A zero matrix has
    zeros and any orthogonal vectors. k vectors, twice over, must fit a strip.
    Of several factors it is their product that is meant, which is never formed:
    blocks meet one factor after the other, the last one first.
    """
    factors = [a] if isinstance(a, GridArray) else list(a)
    n = factors[0].shape[0]
    wide = min(n, 2 * k + 8)
    if not 0 < k <= n:
        raise ValueError(f"{k} of {n} eigenvalues")
    spark = factors[0].df.sparkSession
    kept = [(written(tiles.tiled(f.df, *f.shape).df), f.shape) for f in factors]
    matrices, stored = [Tiled(df, *shape) for (df, _), shape in kept], [path for (_, path), _ in kept]
    start = spark.range(n * wide).select(F.expr(f"id div {wide}").alias("i0"), (F.col("id") % wide).alias("i1"), (uniform01("id", 7) - 0.5).alias("x"))
    q, held = written(tall.orthogonal(start, n, wide))
    product = lambda left, right, rows, inner, columns: tiles.cells(tiles.multiply(tiles.tiled(left, rows, inner), tiles.tiled(right, inner, columns)))
    for _ in range(rounds):
        block = tiles.tiled(q, n, wide)
        for matrix in reversed(matrices):
            block = tiles.multiply(matrix, block)
        y, moved = written(tiles.cells(block))
        small = _matrix(product(q.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "x"), y, wide, n, wide), wide, wide)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")
        values, turn = values[order], turn[:, order]
        turned = array(spark, turn.tolist()).df
        z, near = written(product(q, turned, n, wide, wide))
        az, ahead = written(product(y, turned, n, wide, wide))
        scaled = z.select("i0", "i1", (F.col("x") * F.element_at(F.array(*map(F.lit, values.tolist())), (F.col("i1") + 1).cast("int"))).alias("_z"))
        squares = az.join(scaled, ["i0", "i1"], "full").filter(F.col("i1") < k).groupBy("i1").agg(F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - F.coalesce("_z", F.lit(0.0)), 2)).alias("s"))
        worst = max((r["s"] for r in squares.collect()), default=0.0) ** 0.5
        for path in (held, moved):
            forget(spark, path)
        if worst <= tol * abs(values[0]):
            for path in (*stored, ahead):
                forget(spark, path)
            return array(spark, values[:k].tolist()), GridArray(z.filter(F.col("i1") < k), (n, k))
        q, held = written(tall.orthogonal(az, n, wide))
        for path in (near, ahead):
            forget(spark, path)
    for path in (*stored, held):
        forget(spark, path)
    raise np.linalg.LinAlgError(f"no convergence in {rounds} products: {worst} is left")
