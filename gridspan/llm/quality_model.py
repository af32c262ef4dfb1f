"""A quality classifier on random-indexing word vectors.

Each token has a sparse ternary index vector, a function of its hash; a token's
word vector is the sum of the index vectors of its neighbours over the whole
corpus. Word vectors live in a table of fixed size by token hash, so what each
task adds up, and what all tasks need, is 2 MB whatever the corpus. A
document's vector pools those of its tokens. A two-layer network in numpy
learns from a bounded sample of labelled documents and is calibrated by a
temperature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stash, tidy
from .text import U64, Shingler, column_bytes, mix, pieces

#: Rows of the word vector table (a power of 2, as is the width), its width, the neighbours on each side, and the parts that tasks send it in.
ROWS, WIDTH, REACH, BLOCKS = 1 << 14, 32, 2, 64
#: Labelled documents that the network learns from at most: those of the smallest hash of doc_id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7

_CLASS = np.full(256, 3, np.uint8)  # marks of all kinds
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


class Tokens:
    """Runs of letters, of digits and of marks, as hashes."""

    def __init__(self):
        self.shingler = Shingler(1, fold_case=False)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens in order, and offsets into them for each row."""
        if not len(data):
            return np.empty(0, U64), np.zeros(len(offsets), np.int64)
        kind = _CLASS[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        return self.shingler.hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U64(ROWS - 1)).astype(np.int64)


def _index(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Place and sign of the two entries of each index vector."""
    h = mix(hashes)
    return [(((h >> U64(8 * k)) & U64(WIDTH - 1)).astype(np.int64), ((h >> U64(40 + k)) & U64(1)).astype(float) * 2 - 1) for k in range(2)]


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, table = Tokens(), np.zeros(ROWS * WIDTH, np.int64)
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        for a, b in pieces(offsets):
            hashes, at = tokens.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row, doc, index = _rows(hashes), np.repeat(np.arange(b - a), np.diff(at)), _index(hashes)
            for step in range(1, REACH + 1):
                same = doc[step:] == doc[:-step]
                for place, sign in index:
                    cells = np.concatenate([(row[step:] * WIDTH + place[:-step])[same], (row[:-step] * WIDTH + place[step:])[same]])
                    table += np.bincount(cells, np.concatenate([sign[:-step][same], sign[step:][same]]), ROWS * WIDTH).astype(np.int64)
    yield from _blocks(table.reshape(BLOCKS, -1))


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, block in enumerate(table):
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(block.astype("<i8").tobytes(), 1)], pa.binary())], ["block", "data"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((BLOCKS, ROWS * WIDTH // BLOCKS), np.int64)
    for batch in batches:
        for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            table[k] += np.frombuffer(zlib.decompress(data), "<i8")
    yield from _blocks(table)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors of all texts: each row centred and of length 1."""
    part = docs.select("text").mapInArrow(tidy(_neighbours), "block int, data binary")
    whole = part.repartition(BLOCKS, "block").mapInArrow(tidy(_add), "block int, data binary")
    table = np.zeros((BLOCKS, ROWS * WIDTH // BLOCKS))
    for k, data in whole.collect():  # the table itself: of fixed size
        table[k] = np.frombuffer(zlib.decompress(data), "<i8")
    table = table.reshape(ROWS, WIDTH)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1.0)
    return (table - table.mean(0)).astype(np.float32)


def _pool(vectors: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            out = np.zeros((batch.num_rows, 2 * WIDTH + 2), np.float32)
            for a, b in pieces(offsets):
                hashes, at = tokens.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                each, count = vectors[_rows(hashes)], n[some, None]
                mean = np.add.reduceat(each, at[some], axis=0) / count
                square = np.add.reduceat(each * each, at[some], axis=0) / count
                doc = np.repeat(np.arange(b - a), n).astype(np.uint64)
                kinds = np.unique(mix(hashes + doc * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
                distinct = np.bincount(doc[kinds].astype(np.int64), minlength=b - a)[some]
                rows = a + some
                out[rows, :WIDTH], out[rows, WIDTH : 2 * WIDTH] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
                out[rows, -2], out[rows, -1] = np.log1p(n[some]) / 10, distinct / n[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in out], pa.binary())], ["doc_id", "pooled"])

    return run


class Network:
    """Inputs scaled by the training rows, one hidden layer, a sigmoid, a temperature. All in numpy and seeded."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 8):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature = 1.0
        self.constant: float | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Every fifth row is kept from learning, for the temperature. Of no rows, or of one class only, the score is constant."""
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(self.seed)
        learn = np.arange(len(y)) % 5 != 4
        self.low, self.scale = x[learn].mean(0), x[learn].std(0) + 1e-6
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        rows, self.w = np.flatnonzero(learn), w
        for _ in range(self.epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), 256):
                a = (x[rows[i : i + 256]] - self.low) / self.scale
                hidden = np.tanh(a @ w[0] + w[1])
                error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - y[rows[i : i + 256]]) / len(a)
                back = np.outer(error, w[2]) * (1 - hidden * hidden)
                gradient = [a.T @ back + self.decay * w[0], back.sum(0), hidden.T @ error + self.decay * w[2], error.sum(keepdims=True)]
                step += 1
                for v, g, m, s in zip(w, gradient, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.temperature = self._calibrate(self.logits(x[~learn]), y[~learn])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.low) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    @staticmethod
    def _calibrate(z: np.ndarray, y: np.ndarray) -> float:
        """The temperature of the least log loss, of a fine grid."""
        if not len(y):
            return 1.0
        grid = np.exp(np.linspace(np.log(0.25), np.log(10), 80))
        loss = [np.mean(np.logaddexp(0, -z / t) * y + np.logaddexp(0, z / t) * (1 - y)) for t in grid]
        return float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _judge(network: Network):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, 2 * WIDTH + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x.astype(float)), pa.float64())], ["doc_id", "score"])

    return run


def held_out():
    """Rows that the network never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _smallest(rows: DataFrame, most: int) -> list:
    """The `most` rows of the smallest hash of doc_id, in order of doc_id.

    Hashes are counted in ranges first, so that little more than these rows come to the driver, not so many from each task.
    """
    placed = rows.withColumn("place", F.xxhash64("doc_id"))
    ranges = placed.groupBy(F.shiftright("place", 48).alias("range")).count().orderBy("range").collect()  # 65,536 at most
    upto, last = 0, None
    for r in ranges:
        if upto >= most:
            break
        upto, last = upto + r["count"], r["range"]
    if last is None:
        return []
    taught = placed.filter(F.shiftright("place", 48) <= last).orderBy("place", "doc_id", "pooled").limit(most).collect()
    return sorted(taught, key=lambda r: (r.doc_id, bytes(r.pooled)))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, from its whole text alone.

    A null or empty text has no tokens and gets the score of a zero vector.
    Repeated rows get equal scores; several labels of one document count as
    their mean, null ones not at all. Without labels the score is 0.5. A null
    doc_id is not held out and has no label. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    pooled = stash(rows.mapInArrow(tidy(_pool(word_vectors(rows))), "doc_id long, pooled binary"), "pooled")
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    taught = _smallest(pooled.filter(~held_out()).join(known, "doc_id"), train_rows)
    x = np.frombuffer(b"".join(bytes(r.pooled) for r in taught), np.float32).reshape(len(taught), 2 * WIDTH + 2).astype(float)
    network = Network().fit(x, np.array([r.y for r in taught], float))
    scored = pooled.mapInArrow(tidy(_judge(network)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
