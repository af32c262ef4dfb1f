"""A query of each kind against its SQL, on the smallest tables, and the contract's functions."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as contract
from gridspan.plans import catalogue

DIR = "/root/testdata/sf0.001"
NAMES = [
    "agg_grouped_stats", "agg_argmax", "agg_nanvar", "agg_quantile_weibull", "agg_ma_average", "elementwise_divide", "elementwise_remainder_negative", "elementwise_signbit", "elementwise_gcd",
    "strings_title", "strings_center", "dates_busday_count", "dates_busday_offset", "searchsorted", "histogram", "histogram_density", "bincount", "unique_all", "setxor1d", "isin", "lexsort",
    "array_cumsum", "array_sort", "array_gradient", "array_mask_select", "array_convolve", "array_ma_anom", "matmul_gram", "cross", "lstsq", "solve", "polynomial_laguerre_val", "clump_unmasked",
    "rfft", "elementwise_y1", "polynomial_hermite_int", "polynomial_fromroots", "random_gamma", "array_unwrap", "array_sort_descending", "shape_put_along_axis", "shape_fancy_index", "made_mgrid", "kaiser",
    "ma_intersect1d", "ma_isin", "ma_convolve", "ma_polyfit", "ma_apply_along_axis", "ma_diagflat", "source_loadtxt", "source_savez", "source_frombuffer", "record_append_fields", "array_reduceat_of_table", "array_reduceat_max_of_table", "linalg_inv_blocked", "linalg_slogdet_blocked", "linalg_eigh_leading_values", "sort_complex", "types_promote_types",
]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    query, text = catalogue.entries()[name]
    df, told = query(spark, DIR), sql.sql(text)
    names = sorted(df.columns)
    assert sorted(told.columns) == names
    rows = lambda found, order: sorted(([plain(r[i]) for i in order] for r in found), key=repr)
    got, want = rows(df.collect(), [df.columns.index(n) for n in names]), rows(told.fetchall(), [told.columns.index(n) for n in names])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", ["array_sort", "array_sort_descending", "array_argsort_descending", "searchsorted", "sort_complex", "array_cumsum"])
def test_no_task_gets_all_rows(spark, name):
    """A window without a key is over ranges or blocks, one row each, never over the rows themselves."""
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line:
            keyed = re.search(r"windowspecdefinition\((\w+#\d+)L?, ", line)
            assert keyed or "_n#" in line or "_total#" in line, line


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalogue.queries()) <= set(contract.queries())
