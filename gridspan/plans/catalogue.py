"""All queries of the array library, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.plans import aggregates, arrays, elementwise, masked_arrays, more, strings_dates
from gridspan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _grouped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").cast("bigint").alias("n"),
            F.round(F.avg(net), 4).alias("mean_net"),
            F.round(F.stddev_pop(net), 4).alias("std_net"),
            F.round(F.min(net), 4).alias("min_net"),
            F.round(F.max(net), 4).alias("max_net"),
            F.sum((F.col("l_discount") != 0).cast("int")).cast("bigint").alias("nonzero_discount"),
        )
    )


_GROUPED_STATS_SQL = """
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n,
       round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean_net,
       round(stddev_pop(l_extendedprice * (1 - l_discount)), 4) AS std_net,
       round(min(l_extendedprice * (1 - l_discount)), 4) AS min_net,
       round(max(l_extendedprice * (1 - l_discount)), 4) AS max_net,
       sum(CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END)::BIGINT AS nonzero_discount
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""


def entries() -> dict[str, tuple[Query, str | None]]:
    """Name to (query, SQL)."""
    found: dict[str, tuple[Query, str | None]] = {"agg_grouped_stats": (_grouped_stats, _GROUPED_STATS_SQL)}
    for part in (aggregates, elementwise, strings_dates, arrays, masked_arrays, more):
        found.update(part.entries())
    return found


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in entries().items() if s is not None}
