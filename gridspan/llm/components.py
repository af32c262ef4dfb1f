"""Connected components of a graph given by its edges, without bringing any of it to the driver.

Tasks first shrink their own edges to a forest. Of what is left, fewer than EDGES
edges are shrunk once more, by one task, which tells all; a task shrinks as many
at a time anyway, and rounds over them would be hundreds of small tasks. More
edges go by large-star and small-star steps, which alternate until every node
points at the smallest of its component (Kiveris et al., 2014). All sums are minima, so a node with very many edges is
a few rows a task when it is summed, and its edges learn the minimum by
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, meet, stash, tidy


class Forest:
    """Union-find; the smaller root stays."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


#: Edges that a task shrinks at a time.
EDGES = 500_000


def _shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        forest = Forest()
        for a, b in np.unique(np.concatenate(held), axis=0).tolist():
            forest.join(a, b)
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1))
        size += batch.num_rows
        if size >= EDGES:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def shrink(edges: DataFrame) -> DataFrame:
    """Edges with the same components, at most one a node and task. edges: (a, b), no nulls."""
    return edges.mapInArrow(tidy(_shrink), "a long, b long")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return meet(both.filter("b > a"), least, ["a"], 2 * total).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = meet(down, least, ["u"], total).filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another, root itself left out: the smallest node of its component.

    edges: (a, b) longs without nulls; loops and repeats are allowed.
    """
    now = stash(shrink(edges.filter("a <> b").select("a", "b")), "edges")
    total, seen = now.count(), None
    if total < EDGES:
        after = stash(shrink(now.coalesce(1)), "edges")
        discard(now)
        return after.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(rounds):
        larger = stash(_large_star(now, total), "edges")
        after = stash(_small_star(larger, total), "edges")
        discard(now)
        discard(larger)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        total, seen = mark[0], mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
