"""Hard negatives: for anchors and their nearest rows of the same label, near rows of other labels within a band of scores.

A kNN join by Voronoi cells. Scores are inner products; a vector x lengthened by
sqrt(M^2 - |x|^2), M being the largest norm, has the same distance to an anchor
(lengthened by 0) as a matter of its score alone: d^2 = |a|^2 + M^2 - 2 score.
So triangle inequalities bound scores.

1. Pivots are rows of the smallest hash, a bounded number. Every anchor joins the
   cell of its nearest pivot; the anchors of a cell, in parts of at most PART, are
   a group, with the radius of the group around its pivot.
2. Rows of a cell meet the groups of their own cell first. What an anchor has
   found there bounds how far its results can be.
3. Every other row goes to those groups, and no others, that it might serve: it
   is near enough for some anchor of the group to need it by the distances to
   pivots and by the half space between two cells, and, for a band with an upper
   end, not too near for all.
4. A group meets its rows in blocks, block by block exact, and keeps the best of
   each anchor. The best of the blocks are merged by rank.

Positives take steps 2 to 4, then negatives, whose bands depend on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, stash, tidy

#: Anchors are the rows whose id this divides; positives of an anchor; negatives of each; the band in percent of the positive's score.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90
#: Pivots at most, rows for each, anchors of a group, and rows that a group meets in one task.
PIVOTS, PER_PIVOT, PART, BLOCK = 256, 12_500, 1_024, 100_000
#: Rows whose scores are made at a time, and the share by which bounds on distances give way for rounding.
STEP, SLACK = 4_096, 1e-9


class Cells(NamedTuple):
    """What tasks need: lengthened pivots, the square of the largest norm, components of a vector, and of each group its name, cell and bounds."""

    pivots: np.ndarray
    most: float
    width: int
    groups: list[str] = []
    cell: np.ndarray = np.empty(0, np.int64)
    radius: np.ndarray = np.empty(0)
    near: np.ndarray = np.empty(0)
    far: np.ndarray = np.empty(0)

    def apart(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances of vectors to pivots."""
        x = vectors.astype(float)
        norm = (x * x).sum(1)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - norm, 0))
        square = norm[:, None] + (more * more)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (np.column_stack([x, more]) @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    size, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: by doubles where they hold every sum, else by longs."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    raise OverflowError("scores do not fit a long")


# 1. Cells


def _assign(cells: Cells):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = cells.apart(_vectors(batch.column(2), cells.width), anchors=True)
            nearest = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(apart[np.arange(len(apart)), nearest])], ["vec_id", "label", "vector", "cell", "apart"])

    return run


def _cells(rows: DataFrame) -> Cells | None:
    """Pivots of `rows`; the driver gets PIVOTS vectors at most."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, width, most = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    if not n:
        return None
    drawn = [r.vector for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vector").limit(min(PIVOTS, -(-n // PER_PIVOT))).select("vector").collect()]
    pivots = np.zeros((len(drawn), width + 1))
    for k, v in enumerate(drawn):
        pivots[k, : len(v)] = v
    pivots[:, width] = np.sqrt(np.maximum(most - (pivots * pivots).sum(1), 0))
    return Cells(pivots, most, width)


# 2 and 3. Which rows go to which group


def _serve(cells: Cells, own: bool, blocks: int):
    """Rows (group, block, side 1, ids, labels, vectors): batches of rows to the groups of their own cell, or to those of others that they might serve."""
    between = np.sqrt(np.maximum(((cells.pivots[:, None] - cells.pivots[None]) ** 2).sum(2), 0)) if not own else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            vectors = _vectors(batch.column(2), cells.width)
            apart = cells.apart(vectors, anchors=False)
            home = apart.argmin(1)
            out = []
            for g, name in enumerate(cells.groups):
                c = cells.cell[g]
                if own:
                    goes = home == c
                else:
                    d, d_own = apart[:, c], apart[np.arange(len(home)), home]
                    least = d - cells.radius[g]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        half = np.where(between[home, c] > 0, (d * d - d_own * d_own) / (2 * between[home, c]), 0.0)
                    slack = SLACK * (1 + np.sqrt(cells.most)) + 1e-7 * np.sqrt(cells.most)
                    goes = (home != c) & (np.maximum(least, half) <= cells.far[g] + slack) & (d + cells.radius[g] >= cells.near[g] - slack)
                for some in np.array_split(np.flatnonzero(goes), max(1, -(-int(goes.sum()) // STEP))):
                    if len(some):
                        kind = np.min_scalar_type(-int(np.abs(vectors[some]).max(initial=1)) - 1)  # the narrowest that holds them
                        block = int(ids[some[0]]) % blocks
                        out.append((name, block, 1, ids[some].astype("<i8").tobytes(), labels[some].astype("<i8").tobytes(), kind.str.encode() + b" " + vectors[some].astype(kind).tobytes()))
            if out:
                types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["group", "block", "side", "ids", "labels", "vectors"])

    return run


_DEALT = "group string, block int, side int, ids binary, labels binary, vectors binary"


# 4. A group and its rows


def _best(score: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first `most` of distinct (score, id), higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score))
    found = np.stack([score[order], ids[order]], axis=1)
    if len(found) > 1:
        found = found[np.concatenate([[True], (found[1:] != found[:-1]).any(1)])]
    return [(int(s), int(i)) for s, i in found[:most]]


def _meet(width: int, same: bool, most: int):
    """Rows (anchor, band, score, id): of each anchor and band the best `most`. In: rows of a group and block, its anchors (side 0) first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, best = None, [], {}

        def told() -> pa.RecordBatch:
            rows = [(a, band, s, i) for (a, band), found in best.items() for s, i in found]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["anchor", "band", "score", "id"])

        for batch in batches:
            for group, block, side, ids, labels, data, anchor, bands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, block) != now:
                    if best:
                        yield told()
                    now, anchors, best = (group, block), [], {}
                kind, numbers = data.split(b" ", 1)
                vectors = np.frombuffer(numbers, kind.decode()).reshape(-1, width).astype(np.int64)
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                if side == 0:
                    anchors.append((anchor, int(ids[0]), int(labels[0]), vectors[0], [(b["band"], b["low"], b["high"]) for b in bands]))
                    continue
                if not anchors:
                    continue
                every = scores(np.stack([v for *_, v, _ in anchors]), vectors)
                for row, (a, own, label, _, wanted) in zip(every, anchors, strict=True):
                    may = np.flatnonzero((labels == label) & (ids != own)) if same else np.flatnonzero((labels != label) & (ids != own))
                    for band, low, high in wanted:
                        held = best.get((a, band), [])
                        least = held[-1][0] if len(held) == most else low
                        fit = may[(row[may] >= max(least, low)) & (row[may] <= high)]
                        if len(fit):
                            before = np.array(held, np.int64).reshape(-1, 2)
                            best[a, band] = _best(np.concatenate([row[fit], before[:, 0]]), np.concatenate([ids[fit], before[:, 1]]), most)
        if best:
            yield told()

    return run


def _join(rows: DataFrame, anchors: DataFrame, cells: Cells, own: bool, same: bool, most: int, blocks: int) -> DataFrame:
    """(anchor, band, score, id): the best that the groups find among the rows that `_serve` sends them. anchors: (anchor, group, vec_id, label, vector, bands)."""
    dealt = rows.mapInArrow(tidy(_serve(cells, own, blocks)), _DEALT)
    none = F.lit(None)
    dealt = dealt.select("*", none.cast("long").alias("anchor"), none.cast("array<struct<band: int, low: long, high: long>>").alias("bands"))
    packed = anchors.mapInArrow(_pack(cells.width), "group string, ids binary, labels binary, vectors binary, anchor long, bands array<struct<band: int, low: long, high: long>>")
    sides = packed.select("group", F.explode(F.array(*(F.lit(b) for b in range(blocks)))).alias("block"), F.lit(0).alias("side"), "ids", "labels", "vectors", "anchor", "bands")
    both = sides.unionByName(dealt).repartition("group", "block").sortWithinPartitions("group", "block", "side")
    return both.mapInArrow(tidy(_meet(cells.width, same, most)), "anchor long, band long, score long, id long")


def _pack(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, ids, labels, vectors, anchor, bands = (batch.column(i) for i in range(6))
            data = [b"<i8 " + v.astype("<i8").tobytes() for v in _vectors(vectors, width)]
            eight = lambda c: pa.array([x.tobytes() for x in np.asarray(c).astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([group, eight(ids), eight(labels), pa.array(data, pa.binary()), anchor, bands], ["group", "ids", "labels", "vectors", "anchor", "bands"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, cells: Cells, same: bool, most: int, blocks: int) -> DataFrame:
    """(anchor, band, score, id, place): steps 2 to 4. anchors: (anchor, vec_id, label, vector, group, cell, apart, bands).

    A band is (band, low, high), both ends whole scores.
    """
    wanted = ["group", "vec_id", "label", "vector", "anchor", "bands"]
    shape = anchors.groupBy("group").agg(F.first("cell").alias("cell"), F.max("apart").alias("radius")).orderBy("group").collect()  # one row for PART anchors or for a cell
    cells = cells._replace(groups=[r.group for r in shape], cell=np.array([r.cell for r in shape], np.int64), radius=np.array([r.radius for r in shape]))
    top = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    merged = lambda found: found.withColumn("place", F.dense_rank().over(top)).filter(F.col("place") <= most).distinct()
    first = stash(merged(_join(rows, anchors.select(*wanted), cells, True, same, most, blocks)), "own-cells")
    # The band of an anchor that has found all it wants begins at the last of these.
    full = first.filter(F.col("place") == most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("band").cast("int"), F.col("score")))).alias("held"))
    tighter = F.transform("bands", lambda b: F.struct(b["band"].alias("band"), F.greatest(b["low"], F.coalesce(F.element_at("held", b["band"]), b["low"])).alias("low"), b["high"].alias("high")))
    anchors = stash(anchors.join(full, "anchor", "left").withColumn("bands", F.when(F.col("held").isNull(), F.col("bands")).otherwise(tighter)).drop("held"), "anchors")
    # Distances in which results of a group can lie.
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x) + F.lit(cells.most)
    far = F.sqrt(F.greatest(square - 2 * F.array_min(F.transform("bands", lambda b: b["low"])).cast("double"), F.lit(0.0)))
    near = F.sqrt(F.greatest(square - 2 * F.array_max(F.transform("bands", lambda b: b["high"])).cast("double"), F.lit(0.0)))
    bounds = {r.group: r for r in anchors.groupBy("group").agg(F.max(far).alias("far"), F.min(near).alias("near")).collect()}
    cells = cells._replace(far=np.array([bounds[g].far for g in cells.groups]), near=np.array([bounds[g].near for g in cells.groups]))
    return stash(merged(first.drop("place").unionByName(_join(rows, anchors.select(*wanted), cells, False, same, most, blocks))), "found")


def mine(table: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    table: vec_id and label, whole numbers, and vector, an array of whole numbers.
    Rows whose id, label, vector or any component is null take no part; of
    vectors of different lengths the shorter end in zeros. Anchors are the rows
    whose id `every` divides. An anchor's positives are its first `positives`
    other rows of its label by score, ties by smaller id; of each the first
    `negatives` rows of other labels with low * positive <= 100 * score <=
    high * positive are returned. Equal rows count once; rows that share an id
    but are not equal count each, but never for an anchor of their id. An empty
    table, or one without anchors, gives no rows; other columns are not looked
    at. Vectors may have any length; a group holds PART anchors and a batch of
    rows at a time. A score beyond a long is an error.
    """
    spark = table.sparkSession
    small_batches(spark)
    whole = F.forall("vector", lambda x: x.isNotNull())
    kept = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(whole)
    rows = stash(kept, "vectors")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if (cells := _cells(rows)) is None:
        return empty
    blocks = max(1, -(-rows.count() // BLOCK))
    assigned = rows.filter(F.col("vec_id") % every == 0).distinct().mapInArrow(_assign(cells), "vec_id long, label long, vector array<long>, cell long, apart double")
    assigned = stash(assigned.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    parts = assigned.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
    group = F.concat_ws("-", F.col("cell").cast("string"), F.pmod(F.xxhash64("anchor"), "parts").cast("string"))
    any_score = F.array(F.struct(F.lit(0).alias("band"), F.lit(-(1 << 62)).cast("long").alias("low"), F.lit(1 << 62).cast("long").alias("high")))
    anchors = assigned.join(F.broadcast(parts), "cell").withColumn("group", group).drop("parts")
    near = _search(rows, anchors.withColumn("bands", any_score), cells, True, positives, blocks)
    # A positive's place is its band's number.
    band = F.struct(F.col("place").cast("int").alias("band"), F.expr(f"-(-{low} * score div 100) + if(pmod({low} * score, 100) > 0 and score > 0, 1, 0)").alias("low"), F.expr(f"{high} * score div 100").alias("high"))
    banded = near.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(band)).alias("bands"))
    found = _search(rows, anchors.join(banded, "anchor"), cells, False, negatives, blocks)
    named = near.select("anchor", F.col("place").cast("long").alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    told = found.join(named, ["anchor", "band"]).join(assigned.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return told.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
