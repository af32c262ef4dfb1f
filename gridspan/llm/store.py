"""Where intermediate tables live, and how text reaches Python."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in an Arrow batch at most; Spark also holds a batch to the bytes below.
BATCH_ROWS, BATCH_BYTES = 10_000, "8m"
#: Keys that are broadcast because many rows have them, at most, and rows that a key of these has at least.
HOT_KEYS, HOT_ROWS = 50_000, 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that texts travel in small, so that a Python worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Callable) -> Callable:
    """`run` over Arrow batches; at its end the worker, which Spark keeps for later tasks, gives freed memory back."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, a temporary one, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="gridspan-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stash(df: DataFrame, what: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: its lineage ends there. The table goes with the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.stashed_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    where, files = _file_system(table.sparkSession, table.stashed_at)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def meet(rows: DataFrame, sums: DataFrame, on: list[str], total: int | None = None) -> DataFrame:
    """`rows` joined with `sums`, which has one row for each key of `rows` and in `n` the rows that have it.

    Keys of very many rows, HOT_KEYS at most, come by broadcast, so that no task
    gets all rows of one key; the rest meet by a shuffle. total: the sum of n,
    or more.
    """
    if total is None:
        total = sums.agg(F.sum("n")).first()[0] or 0
    many = max(HOT_ROWS, total // HOT_KEYS)
    if total <= many:
        return rows.join(sums, on)
    hot = F.broadcast(sums.filter(F.col("n") > many).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, on, "left")
    by_shuffle = marked.filter("_hot is null").select(*rows.columns).join(sums.filter(F.col("n") <= many), on)
    by_broadcast = marked.filter("_hot").drop("_hot")
    return by_broadcast.unionByName(by_shuffle)


def doc_key(column: str = "doc_id"):
    """doc_id for joins and order: a null id counts as the smallest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)).cast("long"))


def row_keys(docs: DataFrame) -> DataFrame | None:
    """(k, d, h): a number for each distinct (doc_id, text), in order of doc_id; None if every doc_id, null too, is of one row.

    d is the row's `doc_key` and h its `text_key`. Numbers rather than ids keep rows apart that share an id.
    """
    ids = docs.select(doc_key().alias("d"))
    if not ids.groupBy("d").count().filter("count > 1").limit(1).count():
        return None
    rows = docs.select(doc_key().alias("d"), text_key().alias("h")).distinct().orderBy("d", "h")
    return stash(rows.select(F.monotonically_increasing_id().alias("k"), "d", "h"), "row-keys")


def text_key(column: str = "text"):
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)
