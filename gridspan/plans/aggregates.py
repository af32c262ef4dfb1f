"""Grouped aggregates over lineitem: plain, NaN-skipping, masked, and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.functions.semantics import NAN
from gridspan.operators import aggregate as A
from gridspan.operators import selection as Q
from gridspan.session import table

GROUP = ["l_returnflag", "l_linestatus"]
_T = """
SELECT l_returnflag, l_linestatus, l_orderkey * 1000000 + l_partkey AS id, l_extendedprice AS p, l_quantity AS q, l_discount AS d,
       CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS z,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS m
FROM lineitem
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("l_extendedprice"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        *GROUP, (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("id"), p.alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
        F.when(n == 3, NAN).otherwise(p).alias("z"), F.when(n != 4, p).alias("m"),
    )


_OK = "FILTER (NOT isnan(z))"
_SORTED = "list_sort(list(p))"


def _at(h: str, n: str = "count(*)") -> str:
    """SQL of a quantile by place h in the sorted values, interpolated."""
    h = f"least(greatest({h}, 0.0), {n} - 1.0)"
    low, high = f"{_SORTED}[CAST(floor({h}) AS BIGINT) + 1]", f"{_SORTED}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"{low} + ({h} - floor({h})) * ({high} - {low})"


SHARE = 0.3
#: A function of no argument gives an aggregate, one of the rows a table (keys, value).
CASES: dict[str, tuple[object, str]] = {
    "sum": (lambda: A.sum_("q"), "sum(q)"),
    "prod": (lambda: A.prod(1 + F.col("d") / 1000), "product(1 + d / 1000)"),
    "mean": (lambda: A.mean("p"), "avg(p)"),
    "std": (lambda: A.std("p"), "stddev_pop(p)"),
    "std_ddof": (lambda: A.std("p", 1), "stddev_samp(p)"),
    "var": (lambda: A.var("d"), "var_pop(d)"),
    "max": (lambda: A.max_("p"), "max(p)"),
    "min": (lambda: A.min_("p"), "min(p)"),
    "min_spreads_nan": (lambda: A.min_("z"), "CASE WHEN bool_or(isnan(z)) THEN CAST('NaN' AS DOUBLE) ELSE min(z) END"),
    "ptp": (lambda: A.ptp("p"), "max(p) - min(p)"),
    "argmax": (lambda: A.argmax("p", "id"), "arg_max(id, (p, -id))"),
    "argmin": (lambda: A.argmin("p", "id"), "arg_min(id, (p, id))"),
    "all": (lambda: A.all_("d").cast("int"), "min(CASE WHEN d <> 0 THEN 1 ELSE 0 END)"),
    "any": (lambda: A.any_("d").cast("int"), "max(CASE WHEN d <> 0 THEN 1 ELSE 0 END)"),
    "count_nonzero": (lambda: A.count_nonzero("d"), "count(*) FILTER (d <> 0)"),
    "average": (lambda: A.average("p", "q"), "sum(p * q) / sum(q)"),
    "cov": (lambda: A.cov("q", "p"), "covar_samp(p, q)"),
    "cov_ddof0": (lambda: A.cov("q", "p", 0), "covar_pop(p, q)"),
    "corrcoef": (lambda: A.corrcoef("q", "p"), "corr(p, q)"),
    "nansum": (lambda: A.nansum("z"), f"sum(z) {_OK}"),
    "nanprod": (lambda: A.nanprod(F.when(F.isnan("z"), NAN).otherwise(1 + F.col("d") / 1000)), f"product(1 + d / 1000) {_OK}"),
    "nanmean": (lambda: A.nanmean("z"), f"avg(z) {_OK}"),
    "nanvar": (lambda: A.nanvar(F.col("z") / 1000), f"var_pop(z / 1000) {_OK}"),
    "nanstd": (lambda: A.nanstd("z"), f"stddev_pop(z) {_OK}"),
    "nanmax": (lambda: A.nanmax("z"), f"max(z) {_OK}"),
    "nanmin": (lambda: A.nanmin("z"), f"min(z) {_OK}"),
    "nanargmax": (lambda: A.nanargmax("z", "id"), f"arg_max(id, (z, -id)) {_OK}"),
    "nanargmin": (lambda: A.nanargmin("z", "id"), f"arg_min(id, (z, id)) {_OK}"),
    "nanmedian": (lambda df: Q.nanmedian(df, GROUP, "z"), f"quantile_cont(z, 0.5) {_OK}"),
    "nanquantile": (lambda df: Q.nanquantile(df, GROUP, "z", 0.3), f"quantile_cont(z, 0.3) {_OK}"),
    "nanpercentile": (lambda df: Q.nanpercentile(df, GROUP, "z", 90), f"quantile_cont(z, 0.9) {_OK}"),
    "ma_sum": (lambda: A.sum_("m"), "sum(m)"),
    "ma_mean": (lambda: A.mean("m"), "avg(m)"),
    "ma_var": (lambda: A.var(F.col("m") / 1000), "var_pop(m / 1000)"),
    "ma_std": (lambda: A.std("m"), "stddev_pop(m)"),
    "ma_min": (lambda: A.min_("m"), "min(m)"),
    "ma_max": (lambda: A.max_("m"), "max(m)"),
    "ma_ptp": (lambda: A.ptp("m"), "max(m) - min(m)"),
    "ma_count": (lambda: F.count("m"), "count(m)"),
    "ma_count_masked": (lambda: F.count(F.when(F.col("m").isNull(), 1)), "count(*) - count(m)"),
    "ma_average": (lambda: A.average("m", "q"), "sum(m * q) / sum(q) FILTER (m IS NOT NULL)"),
    "ma_median": (lambda df: Q.median(df, GROUP, "m"), "quantile_cont(m, 0.5)"),
    "ma_argmax": (lambda: A.argmax("m", "id"), "arg_max(id, (m, -id)) FILTER (m IS NOT NULL)"),
    "ma_argmin": (lambda: A.argmin("m", "id"), "arg_min(id, (m, id)) FILTER (m IS NOT NULL)"),
    "median": (lambda df: Q.median(df, GROUP, "p"), "quantile_cont(p, 0.5)"),
    "percentile": (lambda df: Q.percentile(df, GROUP, "p", 77.7), "quantile_cont(p, 0.777)"),
    "quantile_linear": (lambda df: Q.quantile(df, GROUP, "p", SHARE), _at(f"{SHARE} * (count(*) - 1)")),
    "quantile_interpolated_inverted_cdf": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "interpolated_inverted_cdf"), _at(f"{SHARE} * count(*) - 1")),
    "quantile_hazen": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "hazen"), _at(f"{SHARE} * count(*) - 0.5")),
    "quantile_weibull": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "weibull"), _at(f"{SHARE} * (count(*) + 1) - 1")),
    "quantile_median_unbiased": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "median_unbiased"), _at(f"{SHARE} * (count(*) + 1.0 / 3) + 1.0 / 3 - 1")),
    "quantile_normal_unbiased": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "normal_unbiased"), _at(f"{SHARE} * (count(*) + 0.25) + 0.375 - 1")),
    "quantile_lower": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "lower"), _at(f"floor({SHARE} * (count(*) - 1))")),
    "quantile_higher": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "higher"), _at(f"ceil({SHARE} * (count(*) - 1))")),
    "quantile_nearest": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "nearest"), _at(f"round_even({SHARE} * (count(*) - 1), 0)")),
    "quantile_midpoint": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "midpoint"), f"(({_at(f'floor({SHARE} * (count(*) - 1))')}) + ({_at(f'ceil({SHARE} * (count(*) - 1))')})) / 2"),
    "quantile_inverted_cdf": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "inverted_cdf"), _at(f"ceil({SHARE} * count(*)) - 1")),
    "quantile_averaged_inverted_cdf": (
        lambda df: Q.quantile(df, GROUP, "p", SHARE, "averaged_inverted_cdf"),
        f"CASE WHEN {SHARE} * count(*) = floor({SHARE} * count(*)) THEN (({_at(f'ceil({SHARE} * count(*)) - 1')}) + ({_at(f'floor({SHARE} * count(*))')})) / 2 ELSE {_at(f'ceil({SHARE} * count(*)) - 1')} END",
    ),
    "quantile_closest_observation": (lambda df: Q.quantile(df, GROUP, "p", SHARE, "closest_observation"), _at(f"round_even({SHARE} * count(*), 0) - 1")),
}


def entries():
    found = {}
    for name, (make, sql) in CASES.items():

        def query(spark: SparkSession, sf_dir: str, make=make) -> DataFrame:
            rows = _rows(spark, sf_dir)
            found = make(rows) if make.__code__.co_argcount else rows.groupBy(*GROUP).agg(make().cast("double").alias("value"))
            return found.select(*GROUP, F.round("value", 4).alias("value"))

        found[f"agg_{name}"] = query, f"WITH t AS ({_T}) SELECT l_returnflag, l_linestatus, round(CAST({sql} AS DOUBLE), 4) AS value FROM t GROUP BY l_returnflag, l_linestatus"
    return found
