"""Square matrices that fit no task: elimination and Cholesky factors, one panel of columns after the other.

The matrix is a grid of tiles (bi, bj, tile). Elimination finds the pivot rows of
a panel by a tournament: each tile names its best rows by partial pivoting, and
the winners of FAN tiles meet until one set is left. The square block of those
rows, one tile in size, goes to every task; their other columns are solved for it
and taken from all rows in the columns to the right, tile by tile. Right-hand
sides are further columns, so that no second pass is needed; rows stay where they
are, and only the numbers of the pivot rows come to the driver. What a panel
leaves is written to the shared folder, so lineage stays short and lost executors
cost one panel. Tiles travel as the bytes of their cells, which no step between
tasks takes apart. A masked or missing cell counts as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators import tiles
from gridspan.operators.tiles import Tiled
from gridspan.session import forget, scratch

#: Sets of candidate rows that meet in one task of the tournament.
FAN = 16
#: Bytes of a row or column of tiles that goes to every task.
SENT = 1 << 25

_TILE = "bi long, bj long, tile binary"


def _batch(*columns: pa.Array, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


def _longs_of(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return np.asarray(batch.column(column)[k].values)


def _block(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[k].as_buffer(), float)


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values, float).tobytes()], pa.binary())


def _longs(batch: pa.RecordBatch, columns: int, k: int) -> tuple[int, ...]:
    return tuple(batch.column(c)[k].as_py() for c in range(columns))


def written(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """`df` as a table of its own; the table `before`, which it came from, goes."""
    spark = df.sparkSession
    path = scratch(spark, "panel")
    df.write.parquet(path)
    if before is not None:
        forget(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def _whole(t: Tiled, at: int = 0) -> DataFrame:
    """Every tile of the grid, given with all its tiles, with zeros for cells that don't count; columns of tiles start at `at`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj = _longs(batch, 2, k)
                values = batch.column(2)[k].values.fill_null(0.0).to_numpy(zero_copy_only=False)
                yield _batch(pa.array([bi]), pa.array([bj + at]), _bytes(values), names="bi bj tile")

    return t.df.mapInArrow(run, _TILE)


def _made(spark: SparkSession, rows: int, columns: int, at: int, unit: bool, which: str = "true") -> DataFrame:
    """Tiles of zeros, or of the unit matrix; columns of tiles start at `at`. which: a condition on bi and bj."""
    (high, wide), side = Tiled(None, rows, columns).grid, tiles.SIDE
    grid = spark.range(high * wide).select(F.expr(f"id div {wide}").alias("bi"), (F.col("id") % wide).alias("bj")).filter(which)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj = _longs(batch, 2, k)
                shape = min(side, rows - bi * side), min(side, columns - bj * side)
                yield _batch(pa.array([bi]), pa.array([bj + at]), _bytes(np.eye(*shape) if unit and bi == bj else np.zeros(shape)), names="bi bj tile")

    return grid.mapInArrow(run, _TILE)


def _met(panel: DataFrame, n: int) -> DataFrame:
    """A row or column of tiles over n cells as one side of a join with the grid: to every task while it is small, else by a shuffle, whatever the planner believes."""
    return F.broadcast(panel) if n * tiles.SIDE * 8 <= SENT else panel.hint("merge")


def _best(block: np.ndarray, wide: int) -> np.ndarray:
    """Rows in the order in which partial pivoting takes them, `wide` at most."""
    m, order = block.copy(), np.arange(len(block))
    for c in range(min(wide, len(m))):
        p = c + int(np.argmax(np.abs(m[c:, c])))
        m[[c, p]], order[[c, p]] = m[[p, c]], order[[p, c]]
        if m[c, c] != 0:
            m[c + 1 :, c + 1 :] -= np.outer(m[c + 1 :, c] / m[c, c], m[c, c + 1 :])
    return order[:wide]


def _tournament(panel: DataFrame, used: np.ndarray, wide: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivot rows and their cells. panel: (bi, tile) of one column of tiles, `wide` cells wide; used: rows that were pivots before."""
    side = tiles.SIDE

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bi, block = batch.column(0)[k].as_py(), _block(batch, 1, k).reshape(-1, wide)
                free = np.flatnonzero(~used[bi * side : bi * side + len(block)])
                if len(free):
                    free = free[_best(block[free], wide)]
                    yield _batch(pa.array([bi]), pa.ListArray.from_arrays([0, len(free)], pa.array(free + bi * side)), _bytes(block[free]), names="g rows block")

    def later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, blocks = None, [], []

        def winners() -> pa.RecordBatch:
            named, block = np.concatenate(rows), np.concatenate(blocks)
            best = _best(block, wide)
            return _batch(pa.array([now]), pa.ListArray.from_arrays([0, len(best)], pa.array(named[best])), _bytes(block[best]), names="g rows block")

        for batch in batches:
            for k in range(batch.num_rows):
                g = batch.column(0)[k].as_py()
                if g != now and rows:
                    yield winners()
                    rows, blocks = [], []
                now = g
                rows.append(_longs_of(batch, 1, k))
                blocks.append(_block(batch, 2, k).reshape(-1, wide))
        if rows:
            yield winners()

    schema = "g long, rows array<long>, block binary"
    found = panel.mapInArrow(first, schema)
    while high > 1:
        met = found.withColumn("_s", F.col("g")).withColumn("g", F.expr(f"g div {FAN}")).repartition("g").sortWithinPartitions("g", "_s").drop("_s")
        found, high = met.mapInArrow(later, schema), -(-high // FAN)
    (winner,) = found.collect()  # one set: a tile's worth of cells
    return np.array(winner["rows"]), np.frombuffer(winner["block"]).reshape(-1, wide)


def _taken(table: DataFrame, k: int, pivots: np.ndarray, block: np.ndarray, width: Callable[[int], int], used: np.ndarray, wide: int) -> DataFrame:
    """The tiles right of panel k once its pivot rows are solved for their block and taken from all other rows."""
    side, high = tiles.SIDE, len(block)
    where: dict[int, list[int]] = {}
    for place, row in enumerate(pivots.tolist()):
        where.setdefault(row // side, []).append(place)

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                bi, bj = _longs(batch, 2, n)
                tile = _block(batch, 2, n).reshape(-1, width(bj))
                places = np.array(where[bi])
                yield _batch(pa.array([bj]), pa.ListArray.from_arrays([0, len(places)], pa.array(places)), _bytes(tile[pivots[places] % side]), names="bj places rows")

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                bj = batch.column(0)[n].as_py()
                if bj != now:
                    if now is not None:
                        yield _batch(pa.array([now]), _bytes(np.linalg.solve(block, held)), names="bj u")
                    now, held = bj, np.zeros((high, width(bj)))
                held[_longs_of(batch, 1, n)] = _block(batch, 2, n).reshape(-1, width(bj))
        if now is not None:
            yield _batch(pa.array([now]), _bytes(np.linalg.solve(block, held)), names="bj u")

    def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                bi, bj = _longs(batch, 2, n)
                tile, left, u = (_block(batch, c, n) for c in (2, 3, 4))
                u = u.reshape(high, -1)
                new = tile.reshape(-1, u.shape[1]) - left.reshape(-1, high) @ u
                for place in where.get(bi, ()):
                    new[pivots[place] % side] = u[place]
                yield _batch(pa.array([bi]), pa.array([bj]), _bytes(new), names="bi bj tile")

    right = table.filter(F.col("bj") > k)
    met = right.filter(F.col("bi").isin(list(where))).mapInArrow(rows_of, "bj long, places array<long>, rows binary")
    u = met.repartition("bj").sortWithinPartitions("bj").mapInArrow(solved, "bj long, u binary")
    left = table.filter(F.col("bj") == k).select("bi", F.col("tile").alias("l"))
    return right.join(_met(left, len(used)), "bi").join(_met(u, wide), "bj").select("bi", "bj", "tile", "l", "u").mapInArrow(update, _TILE)


def _eliminate(spark: SparkSession, a: DataFrame, n: int, right: DataFrame | None, columns: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None, str | None]:
    """Pivot rows in order, diagonals of U in order, and right-hand sides by pivot rows with the path of their table; these two are None without any.

    A singular matrix has a zero among the diagonals and no right-hand sides.
    """
    side, grid = tiles.SIDE, -(-n // tiles.SIDE)
    width = lambda bj: min(side, n - bj * side) if bj < grid else min(side, columns - (bj - grid) * side)
    table, path = written(_whole(tiles.tiled(a, n, n, whole=True)) if right is None else _whole(tiles.tiled(a, n, n, whole=True)).unionByName(right))
    used, order, diagonal = np.zeros(n, bool), [], []
    for k in range(grid):
        pivots, block = _tournament(table.filter(F.col("bj") == k).select("bi", "tile"), used, width(k), grid)
        used[pivots] = True
        order.append(pivots)
        diagonal.append(_diagonal(block))
        if (diagonal[-1] == 0).any():
            forget(spark, path)
            return np.concatenate(order), np.concatenate(diagonal), None, None
        if k + 1 < grid or right is not None:
            table, path = written(_taken(table, k, pivots, block, width, used, n + (columns if right is not None else 0)), path)
    if right is None:
        forget(spark, path)
        table = path = None
    return np.concatenate(order), np.concatenate(diagonal), table, path


def _diagonal(block: np.ndarray) -> np.ndarray:
    """Of U, for rows in the order of their pivots."""
    m = block.copy()
    for c in range(len(m)):
        if m[c, c] != 0:
            m[c + 1 :, c:] -= np.outer(m[c + 1 :, c] / m[c, c], m[c, c:])
    return np.diagonal(m).copy()


def solved(spark: SparkSession, a: DataFrame, n: int, b: DataFrame | None, columns: int) -> DataFrame:
    """Cells (i0, i1, x) of the solution of a x = b, n x columns; b None is the unit matrix. Raises LinAlgError if a is singular."""
    grid = -(-n // tiles.SIDE)
    right = _made(spark, n, columns, grid, True) if b is None else _whole(tiles.tiled(b, n, columns, whole=True), grid)
    order, diagonal, table, _ = _eliminate(spark, a, n, right, columns)
    if table is None:
        raise np.linalg.LinAlgError("Singular matrix")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    side = tiles.SIDE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj = _longs(batch, 2, k)
                tile, first = _block(batch, 2, k), (bj - grid) * side
                wide = min(side, columns - first)
                at = np.arange(len(tile))
                yield _batch(pa.array(place[bi * side + at // wide]), pa.array(first + at % wide), pa.array(tile), names="i0 i1 x")

    return table.mapInArrow(run, "i0 long, i1 long, x double")


def log_determinant(spark: SparkSession, a: DataFrame, n: int) -> tuple[float, float]:
    """Sign and logarithm of the absolute determinant of cells (i0, i1, x); 0 and -inf if singular."""
    order, diagonal, _, _ = _eliminate(spark, a, n, None, 0)
    if (diagonal == 0).any():
        return 0.0, -np.inf
    seen, cycles = np.zeros(n, bool), 0
    for start in range(n):
        cycles += not seen[start]
        while not seen[start]:
            seen[start] = True
            start = order[start]
    odd = (n - cycles + int((diagonal < 0).sum())) % 2
    return (-1.0 if odd else 1.0), float(np.log(np.abs(diagonal)).sum())


def lower(spark: SparkSession, a: DataFrame, n: int) -> DataFrame:
    """Cells (i0, i1, x) of the Cholesky factor; only cells on and below the diagonal are read. Raises LinAlgError if a is not positive definite."""
    side, grid = tiles.SIDE, -(-n // tiles.SIDE)
    table, path = written(_whole(tiles.tiled(a.filter(f"i0 div {side} >= i1 div {side}"), n, n, whole=True)).filter("bi >= bj"))
    out = scratch(spark, "factor")
    for k in range(grid):
        wide = min(side, n - k * side)
        (corner,) = table.filter(f"bi = {k} and bj = {k}").collect()  # one tile
        try:
            root = np.linalg.cholesky(np.frombuffer(corner["tile"]).reshape(wide, wide))
        except np.linalg.LinAlgError:
            forget(spark, path)
            forget(spark, out)
            raise

        def panel(batches: Iterable[pa.RecordBatch], k: int = k, wide: int = wide, root: np.ndarray = root) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    bi = batch.column(0)[row].as_py()
                    tile = root if bi == k else np.ascontiguousarray(np.linalg.solve(root, _block(batch, 2, row).reshape(-1, wide).T).T)
                    yield _batch(pa.array([bi]), pa.array([k]), _bytes(tile), names="bi bj tile")

        def update(batches: Iterable[pa.RecordBatch], wide: int = wide) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    tile, p, q = (_block(batch, c, row) for c in (2, 3, 4))
                    new = tile.reshape(-1, len(q) // wide) - p.reshape(-1, wide) @ q.reshape(-1, wide).T
                    yield _batch(batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), _bytes(new), names="bi bj tile")

        table.filter(F.col("bj") == k).mapInArrow(panel, _TILE).write.mode("append").parquet(out)
        if k + 1 < grid:
            done = spark.read.schema(_TILE).parquet(out).filter(F.col("bj") == k)
            p, q = (done.select(F.col("bi").alias(name), F.col("tile").alias(f"_{name}")) for name in ("bi", "bj"))
            table, path = written(table.filter(F.col("bj") > k).join(_met(p, n), "bi").join(_met(q, n), "bj").select("bi", "bj", "tile", "_bi", "_bj").mapInArrow(update, _TILE), path)
    forget(spark, path)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bi, bj = _longs(batch, 2, row)
                tile, wide = _block(batch, 2, row), min(side, n - bj * side)
                at = np.arange(len(tile))
                yield _batch(pa.array(bi * side + at // wide), pa.array(bj * side + at % wide), pa.array(tile), names="i0 i1 x")

    factor = spark.read.schema(_TILE).parquet(out).unionByName(_made(spark, n, n, 0, False, "bi < bj"))
    return factor.mapInArrow(cells, "i0 long, i1 long, x double")
