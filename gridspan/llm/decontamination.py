"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so the question is
containment: which share of the item's shingles occur in the document. Items
are partitioned by size; an item of a partition with at most u shingles is
indexed by its bottom-k MinHash sketch, its k smallest shingle hashes, with
k = u - ceil(t * u) + 1. A document that holds a share t of the item's shingles
misses at most floor((1 - t) * size) of them and so holds one of the sketch:
the search misses nothing. What it finds is verified by the exact count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches, stash, tidy
from .text import U64, Shingler, column_bytes, pieces

#: Shingles of the items in a block, about: 64 MB. A block goes to every task; each further one is another pass over the documents.
BLOCK_SHINGLES = 8_000_000

FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("n_item", T.LongType()),
        T.StructField("n_shared", T.LongType()),
        T.StructField("containment", T.DoubleType()),
    ]
)


class Index:
    """The sketches and shingle sets of one block of items. items: (item_id, its distinct shingles in order)."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], percent: int = 75, k: int = 5):
        self.percent, self.k, self.ids = percent, k, [i for i, _ in items]
        self.at = np.concatenate([[0], np.cumsum([len(s) for _, s in items], dtype=np.int64)]).astype(np.int64)
        self.shingles = np.concatenate([s for _, s in items]) if items else np.empty(0, U64)
        size = np.diff(self.at)
        # The partition: sizes over top / 2, up to top.
        top = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        wanted = np.minimum(top + percent * top // -100 + 1, size)
        inner = np.arange(self.at[-1]) - np.repeat(self.at[:-1], size)
        mine = inner < np.repeat(wanted, size)
        self.keys, self.owners = self.shingles[mine], np.repeat(np.arange(len(size)), size)[mine]
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.bits = U64((1 << min(max(20, (16 * len(self.keys)).bit_length()), 25)) - 1)
        self.screen = np.zeros(int(self.bits) + 1, bool)
        self.screen[(self.keys & self.bits).astype(np.int64)] = True

    def search(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item's place, its shingles, shared ones) of all contained items. hashes: the rows' shingles."""
        hit = np.flatnonzero(self.screen[(hashes & self.bits).astype(np.int64)])
        low = np.searchsorted(self.keys, hashes[hit])
        real = low < len(self.keys)
        real[real] = self.keys[low[real]] == hashes[hit[real]]
        hit, rows = hit[real], np.searchsorted(at, hit[real], "right") - 1
        cuts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]]) if len(rows) else [0]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            row, mine = int(rows[start]), np.unique(hashes[hit[start:end]])
            a, b = np.searchsorted(self.keys, mine), np.searchsorted(self.keys, mine, "right")
            own = np.unique(hashes[at[row] : at[row + 1]])
            for item in np.unique(np.concatenate([self.owners[i:j] for i, j in zip(a, b, strict=True)])):
                want = self.shingles[self.at[item] : self.at[item + 1]]
                place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                shared = int((own[place] == want).sum())
                if 100 * shared >= self.percent * len(want):
                    yield row, int(item), len(want), shared


def _sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            n, sets = [], []
            for a, b in pieces(offsets):
                hashes, at = shingler.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for row in range(b - a):
                    found = np.unique(hashes[at[row] : at[row + 1]])
                    n.append(len(found))
                    sets.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], ["item_id", "n", "shingles"])

    return run


def blocks(benchmark: DataFrame, percent: int = 75, k: int = 5) -> Iterator[Index]:
    """Indexes of the stated query set, in blocks of a size that is checked. An item without an id counts as any other."""
    sets = benchmark.selectExpr("cast(item_id as long) item_id", "text").mapInArrow(tidy(_sets(k)), "item_id long, n long, shingles binary")
    items = stash(sets.filter("n > 0").select(F.monotonically_increasing_id().alias("row"), "*"), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    count = -(-total // BLOCK_SHINGLES)
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == block).orderBy("row").collect()
        yield Index([(r.item_id, np.frombuffer(bytes(r.shingles), "<u8").astype(U64)) for r in rows], percent, k)


def _searcher(index: Index):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(index.k)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            out: list[tuple] = []
            for a, b in pieces(offsets):
                hashes, at = shingler.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [(ids[a + row], index.ids[item], n, m, m / n) for row, item, n, m in index.search(hashes, at)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], FOUND.names)

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document and item where the
    document holds at least `percent` of the item's distinct k-word shingles.

    An item of fewer than k words is one shingle, which only a document of the
    same few words has. Items or documents without words match nothing; a null
    text counts as empty. Repeated rows are returned as often as they occur, and
    items with equal texts each; an item's or document's id may be null. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    found = None
    for index in blocks(benchmark, percent, k):
        part = rows.mapInArrow(tidy(_searcher(index)), FOUND)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], FOUND) if found is None else found


def _sieve(index: Index, text_at: int):
    def sieve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(index.k)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            data, offsets = column_bytes(batch.column(text_at))
            for a, b in pieces(offsets):
                hashes, at = shingler.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for row, *_ in index.search(hashes, at):
                    keep[a + row] = False
            yield batch.filter(pa.array(keep))

    return sieve


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """`docs` with all its columns, without the documents that `contaminated` finds, items without an id among the rest. One pass for each block."""
    small_batches(docs.sparkSession)
    for index in blocks(benchmark, percent, k):
        docs = docs.mapInArrow(tidy(_sieve(index, docs.columns.index("text"))), docs.schema)
    return docs
