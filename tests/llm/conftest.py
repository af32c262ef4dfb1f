import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    """documents of given (doc_id, text), with columns whose names clash with those the operators use inside."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def make(rows):
        df = spark.createDataFrame(list(rows), schema)
        return df.withColumns({c: F.lit("x") for c in ("lang", "source", "k", "key", "n", "rep", "group", "p1", "size", "task", "_c0")})

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty texts, blanks, ties, repeated rows, a long text and one of a single character."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "a null id has a text of six words"), (7, long), (8, "é" * 300), (8, "é" * 300), (9, "x" * 5000), (10, "tab\there\x0band there " * 20)]
