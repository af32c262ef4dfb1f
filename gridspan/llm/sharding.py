"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Rows of equal text form a group that stays together. Differencing runs in
levels: each task divides its groups into 8 parts, a bounded number of groups
at a time, and leaves a partial partition of 8 sums; tasks difference the
partials against each other in the same way, until few enough are left for the
driver. At every level the two partial partitions of the largest spread are
combined, the one's largest part with the other's smallest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import meet, small_batches, stash, tidy

SHARDS = 8
#: Groups, or partial partitions, that a task differences at a time; partials that the driver differences at most.
GROUPS, PARTIALS = 20_000, 4_000


def difference(sums: list[list[int]]) -> list[list[int]]:
    """For each partial partition, the shard of each of its parts. sums: the parts' sizes, equally many each."""
    if not sums:
        return []
    parts = len(sums[0])
    # A node: the spread, its number, the parts' sums above the smallest, and the order of its parts.
    heap, made = [], []
    for number, s in enumerate(sums):
        order = sorted(range(parts), key=lambda k: -s[k])
        low = s[order[-1]]
        heap.append((low - s[order[0]], number, [s[k] - low for k in order]))
        made.append((order, None, None))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(parts), key=lambda k: -both[k])
        low = both[order[-1]]
        heapq.heappush(heap, (low - both[order[0]], len(made), [both[k] - low for k in order]))
        made.append((order, a, b))
    out: list[list[int]] = [[] for _ in sums]
    # shard_of[k]: the shard of a node's k-th largest part.
    todo = [(heap[0][1], list(range(parts)))]
    while todo:
        node, shard_of = todo.pop()
        order, a, b = made[node]
        back = [0] * parts
        for rank, k in enumerate(order):
            back[k] = shard_of[rank]
        if a is None:
            out[node] = back
        else:
            todo += [(a, back), (b, back[::-1])]
    return out


def _divide(shards: int):
    """Rows (h1, h2, n, bytes) of groups: each one's partial partition and its part there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for chunk, rows in enumerate(_chunks(batches)):
            labels = [s[0] for s in difference([[v, *[0] * (shards - 1)] for v in rows.column(3).to_pylist()])]
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([(task << 32) + chunk] * n, pa.int64()), pa.array(labels, pa.int32())], [*rows.schema.names, "partial", "label"])

    return run


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, GROUPS at a time."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, GROUPS - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == GROUPS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (partial, sums) of partials: the partial of the next level that each becomes a part of, and the part there of each of its parts."""
    task = TaskContext.get().partitionId()
    for chunk, rows in enumerate(_chunks(batches)):
        n = rows.num_rows
        found = difference(rows.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([(task << 32) + chunk] * n, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["partial", "sums", "above", "places"])


def _sums(parts: DataFrame, shards: int) -> DataFrame:
    """(partial, sums) of rows (partial, label, bytes)."""
    by_label = [F.coalesce(F.sum(F.when(F.col("label") == s, F.col("bytes"))), F.lit(0)) for s in range(shards)]
    return parts.groupBy("partial").agg(F.array(*by_label).alias("sums"))


def _places(divided: DataFrame, shards: int) -> DataFrame:
    """(partial, label, shard): the shard of each part of each partial of `divided`.

    Partials are differenced in tasks, level by level, until the driver can
    difference the PARTIALS or fewer that are left; shards then go back down.
    """
    spark = divided.sparkSession
    now, levels = stash(_sums(divided, shards), "partials"), []
    while now.count() > PARTIALS:
        level = stash(now.mapInArrow(tidy(_combine), "partial long, sums array<long>, above long, places array<int>"), "partials")
        levels.append(level)
        parts = level.select(F.col("above").alias("partial"), F.explode(F.arrays_zip("sums", "places")).alias("x"))
        above = stash(_sums(parts.select("partial", F.col("x.places").alias("label"), F.col("x.sums").alias("bytes")), shards), "partials")
        if above.count() == level.count():  # too few in each task to combine: all of them in fewer tasks
            above = stash(above.coalesce(max(1, above.rdd.getNumPartitions() // 8)), "partials")
        now = above
    rows = sorted((r.partial, list(r.sums)) for r in now.collect())
    chosen = [(k, label, s) for (k, _), found in zip(rows, difference([s for _, s in rows]), strict=True) for label, s in enumerate(found)]
    places = spark.createDataFrame(chosen, "partial long, label int, shard int")
    for level in reversed(levels):
        below = level.select("partial", "above", F.posexplode("places").alias("label", "place"))
        target = places.select(F.col("partial").alias("above"), F.col("label").alias("place"), "shard")
        places = below.join(target, ["above", "place"]).select("partial", "label", "shard")
    return places


def _number(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = np.asarray(batch.column(3)).astype(np.int64)
            place = np.empty(len(shard), np.int64)
            for s in range(shards):
                mine = shard == s
                place[mine] = nth[s] + np.arange(mine.sum())
                nth[s] += mine.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(shard), pa.int32()), pa.array(place)], [*batch.schema.names, "task", "nth"])

    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`.

    The law is `bytes`. A null text counts as empty; rows of equal text, repeated
    rows among them, share a shard. Ids may repeat or be null. An empty table
    gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
    )
    rows = stash(rows, "sizes")
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    divided = stash(groups.mapInArrow(tidy(_divide(shards)), "h1 long, h2 long, n long, bytes long, partial long, label int"), "groups")
    placed = divided.join(_places(divided, shards), ["partial", "label"]).select("h1", "h2", "n", "shard")
    joined = meet(rows, placed, ["h1", "h2"], rows.count()).select("doc_id", "size", "text_crc32", "shard")
    numbered = stash(joined.mapInArrow(tidy(_number(shards)), "doc_id long, size long, text_crc32 long, shard int, task int, nth long"), "sharded")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("shard", "task").agg(F.count("*").alias("n")).select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(base, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
