import numpy as np
import pytest

from gridspan import api as gs
from gridspan import array as G
from gridspan.operators import aggregate, selection
from gridspan.plans import catalogue

NAN = float("nan")


def groups():
    rng = np.random.default_rng(1)
    rows = []
    for g, (n, kinds) in enumerate([(900, 60), (40, 5), (1, 3), (300, 10**6)]):
        rows += [(g, float(v)) for v in rng.integers(0, kinds, n)]
    return rows + [(5, NAN)] * 3 + [(6, None)] * 2 + [(7, 1.0), (7, NAN), (7, 3.0), (7, None)]


@pytest.mark.parametrize(("large", "cuts", "skip"), [(10**6, 256, False), (10**6, 256, True), (30, 32, True), (100, 4, False)])
def test_all_methods_against_numpy(spark, monkeypatch, large, cuts, skip):
    """Groups ordered at once, and groups narrowed in one or two rounds."""
    monkeypatch.setattr(selection, "LARGE", large)
    monkeypatch.setattr(selection, "CUTS", cuts)
    rows = groups()
    df = spark.createDataFrame(rows, "g int, x double")
    wanted = {f"{m}_{k}": (q, m) for m in aggregate.METHODS for k, q in enumerate((0, 0.3, 0.5, 1))}
    found = selection.quantiles(df, ["g"], "x", wanted, skip).collect()
    assert sorted(r.g for r in found) == [0, 1, 2, 3, 5, 6, 7]
    for r in found:
        values = np.array([x for g, x in rows if g == r.g and x is not None])
        if skip and not np.isnan(values).all():
            values = values[~np.isnan(values)]
        for name, (q, method) in wanted.items():
            if not len(values):
                assert r[name] is None
            else:
                assert r[name] == pytest.approx(np.quantile(values, q, method=method), rel=1e-12, nan_ok=True)


def test_of_no_keys_and_of_arrays(spark):
    x = np.random.default_rng(2).normal(size=(6, 50))
    a = G.array(spark, x.tolist())
    assert selection.median(a.df, [], "x").first().value == pytest.approx(np.median(x))
    assert gs.quantile(a, 0.4, 1, "hazen").tolist() == pytest.approx(np.quantile(x, 0.4, axis=1, method="hazen").tolist())
    assert gs.percentile(a, 10).tolist() == pytest.approx(np.percentile(x, 10))
    assert gs.median(a, 0).tolist() == pytest.approx(np.median(x, 0).tolist())
    assert gs.nanmedian(G.array(spark, [1.0, NAN, 4.0, None])).tolist() == 2.5
    assert np.isnan(gs.median(G.array(spark, [1.0, NAN, 4.0])).tolist())
    assert selection.median(a.df.filter("i0 < 0"), [], "x").first().value is None


def test_partition(spark):
    x = np.random.default_rng(3).integers(0, 9, (4, 30)).astype(float)
    rows = x.tolist()
    rows[1][3], rows[1][8], rows[2][0] = NAN, NAN, None
    a = G.array(spark, rows)
    for kth in (0, 11, -1):
        got, places = a.partition(kth, 1).tolist(), a.argpartition(kth, 1).tolist()
        at = kth % 30
        for lane, found, where in zip(rows, got, places, strict=True):
            key = lambda v: (v is None, v is not None and v != v, 0 if v is None or v != v else v)
            assert sorted(map(key, found)) == sorted(map(key, lane)) and sorted(where) == list(range(30))
            assert [key(lane[int(k)]) for k in where] == [key(v) for v in found]
            assert all(key(v) <= key(found[at]) for v in found[:at]) and all(key(v) >= key(found[at]) for v in found[at:])
            assert key(found[at]) == sorted(map(key, lane))[at]


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if any(w in n for w in ("median", "quantile", "percentile", "partition")) and n.startswith(("agg_", "array_", "shape_"))])
def test_plans_collect_no_group(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile(" not in plan and "collect_set" not in plan


def test_large_groups_are_cut_by_values_alone(spark, monkeypatch):
    """Numbers of all sizes and signs, and no approximate quantiles, which may differ from scan to scan."""
    monkeypatch.setattr(selection, "LARGE", 50)
    x = np.concatenate([np.random.default_rng(4).normal(size=300), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1e308, -1e308, NAN], np.full(200, 7.25)])
    df = spark.createDataFrame([(0, float(v)) for v in x], "g int, x double")
    ranks = range(len(x))
    found = selection.at_ranks(df, ["g"], "x", {f"r{k}": lambda _, k=k: selection.F.lit(k) for k in ranks})
    assert "approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert [row[f"r{k}"] for k in ranks] == pytest.approx(np.sort(x).tolist(), nan_ok=True)


def test_partition_with_parts_in_order(spark):
    x = np.random.default_rng(5).integers(0, 9, 40).astype(float)
    assert G.array(spark, x.tolist()).partition(10, ordered=True).tolist() == np.sort(x).tolist()


def test_only_a_cell_of_a_large_group_is_ordered(spark, monkeypatch):
    """Whatever the rows: at most LARGE of a group for each rank, and no approximate quantiles of the whole table."""
    monkeypatch.setattr(selection, "LARGE", 50)
    sizes, counted = [], selection._counted

    def seen(rows, keys):
        sizes.append(rows.groupBy(*keys).count().agg(selection.F.max("count")).first()[0])
        return counted(rows, keys)

    monkeypatch.setattr(selection, "_counted", seen)
    x = np.random.default_rng(6).uniform(900, 105000, 3000)
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(x)], "g int, x double")
    found = selection.quantiles(df, ["g"], "x", {"low": (0.3, "linear"), "high": (0.777, "inverted_cdf")})
    got = {r["g"]: (r["low"], r["high"]) for r in found.collect()}
    assert all(got[g] == pytest.approx((np.quantile(x[g::2], 0.3), np.quantile(x[g::2], 0.777, method="inverted_cdf"))) for g in (0, 1))
    assert sizes and max(sizes) <= 50 and "approx" not in found._jdf.queryExecution().optimizedPlan().toString()
