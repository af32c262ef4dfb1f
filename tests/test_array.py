"""GridArray against numpy on small arrays."""

import math
import re

import numpy as np
import pytest
from numpy.testing import assert_allclose
from pyspark.sql import functions as F

from gridspan import api as gs
from gridspan import array as G
from gridspan import layout
from gridspan.operators import linalg as L
from gridspan.operators.ufunc import UFUNCS

A23 = [[3.0, -1.0, 2.0], [0.5, 4.0, -2.0]]
B23 = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
V = [4.0, 1.0, 3.0, 1.0, -2.0, 0.0]
SQ = [[4.0, 1.0, 0.0], [1.0, 3.0, -1.0], [0.0, -1.0, 2.0]]


def same(found, want):
    got = found.tolist()
    got = np.array(got, float) if not isinstance(got, float | int | bool) else got
    assert found.shape == np.shape(want)
    assert_allclose(got, np.asarray(want, float), rtol=1e-9, atol=1e-12)


CASES = {
    "add": (lambda s, a, b, v: a + b, lambda a, b, v: a + b),
    "broadcast": (lambda s, a, b, v: a * b[0], lambda a, b, v: a * b[0]),
    "broadcast_col": (lambda s, a, b, v: a - b.mean(1, True), lambda a, b, v: a - b.mean(1, keepdims=True)),
    "div_mod": (lambda s, a, b, v: (a // 2.0) + (a % 2.0), lambda a, b, v: a // 2.0 + a % 2.0),
    "sum": (lambda s, a, b, v: a.sum(), lambda a, b, v: a.sum()),
    "sum0": (lambda s, a, b, v: a.sum(0), lambda a, b, v: a.sum(0)),
    "prod1": (lambda s, a, b, v: a.prod(1), lambda a, b, v: a.prod(1)),
    "std": (lambda s, a, b, v: a.std(1, 1), lambda a, b, v: a.std(1, ddof=1)),
    "minmax": (lambda s, a, b, v: a.max(0) - a.min(0), lambda a, b, v: np.ptp(a, 0)),
    "argmax": (lambda s, a, b, v: a.argmax(1), lambda a, b, v: a.argmax(1)),
    "argmin_flat": (lambda s, a, b, v: v.argmin(), lambda a, b, v: v.argmin()),
    "median": (lambda s, a, b, v: a.median(1), lambda a, b, v: np.median(a, 1)),
    "quantile": (lambda s, a, b, v: v.quantile(0.3, method="hazen"), lambda a, b, v: np.quantile(v, 0.3, method="hazen")),
    "average": (lambda s, a, b, v: a.average(b, 0), lambda a, b, v: np.average(a, 0, b)),
    "cumsum": (lambda s, a, b, v: a.cumsum(1), lambda a, b, v: a.cumsum(1)),
    "cumprod_flat": (lambda s, a, b, v: a.cumprod(), lambda a, b, v: a.cumprod()),
    "diff": (lambda s, a, b, v: v.diff(2), lambda a, b, v: np.diff(v, 2)),
    "gradient": (lambda s, a, b, v: v.gradient(0.5), lambda a, b, v: np.gradient(v, 0.5)),
    "gradient2": (lambda s, a, b, v: v.gradient(1.0, 0, 2), lambda a, b, v: np.gradient(v, edge_order=2)),
    "ediff1d": (lambda s, a, b, v: v.ediff1d([9.0], [8.0, 7.0]), lambda a, b, v: np.ediff1d(v, [8.0, 7.0], [9.0])),
    "trapezoid": (lambda s, a, b, v: a.trapezoid(2.0, 1), lambda a, b, v: np.trapezoid(a, dx=2.0, axis=1)),
    "sort": (lambda s, a, b, v: v.sort(), lambda a, b, v: np.sort(v)),
    "sort_rows": (lambda s, a, b, v: a.sort(1), lambda a, b, v: np.sort(a, 1)),
    "argsort": (lambda s, a, b, v: v.argsort(), lambda a, b, v: np.argsort(v, kind="stable")),
    "searchsorted": (lambda s, a, b, v: v.sort().searchsorted(a), lambda a, b, v: np.searchsorted(np.sort(v), a)),
    "searchsorted_right": (lambda s, a, b, v: v.sort().searchsorted(v, "right"), lambda a, b, v: np.searchsorted(np.sort(v), v, "right")),
    "flatnonzero": (lambda s, a, b, v: v.flatnonzero(), lambda a, b, v: np.flatnonzero(v)),
    "reshape": (lambda s, a, b, v: a.reshape(3, -1), lambda a, b, v: a.reshape(3, -1)),
    "transpose": (lambda s, a, b, v: a.T, lambda a, b, v: a.T),
    "flip": (lambda s, a, b, v: a.flip(1), lambda a, b, v: np.flip(a, 1)),
    "rot90": (lambda s, a, b, v: a.rot90(), lambda a, b, v: np.rot90(a)),
    "rot270": (lambda s, a, b, v: a.rot90(3), lambda a, b, v: np.rot90(a, 3)),
    "repeat": (lambda s, a, b, v: a.repeat(2, 1), lambda a, b, v: a.repeat(2, 1)),
    "tile": (lambda s, a, b, v: a.tile(2, 3), lambda a, b, v: np.tile(a, (2, 3))),
    "resize": (lambda s, a, b, v: v.resize(3, 3), lambda a, b, v: np.resize(v, (3, 3))),
    "roll": (lambda s, a, b, v: a.roll(2, 1), lambda a, b, v: np.roll(a, 2, 1)),
    "roll_flat": (lambda s, a, b, v: a.roll(-1), lambda a, b, v: np.roll(a, -1)),
    "moveaxis": (lambda s, a, b, v: a.expand_dims(0).moveaxis(0, 2), lambda a, b, v: np.moveaxis(a[None], 0, 2)),
    "slice": (lambda s, a, b, v: v[4:0:-2], lambda a, b, v: v[4:0:-2]),
    "index": (lambda s, a, b, v: a[-1, 1:], lambda a, b, v: a[-1, 1:]),
    "newaxis": (lambda s, a, b, v: a[:, None, 2], lambda a, b, v: a[:, None, 2]),
    "mask_index": (lambda s, a, b, v: v[v > 0.5], lambda a, b, v: v[v > 0.5]),
    "compress": (lambda s, a, b, v: a.compress(G.array(s, [True, False, True]), 1), lambda a, b, v: a.compress([True, False, True], 1)),
    "take": (lambda s, a, b, v: a.take(G.array(s, [2, 0]), 1), lambda a, b, v: a.take([2, 0], 1)),
    "take_along": (lambda s, a, b, v: a.take_along_axis(a.argsort(1), 1), lambda a, b, v: np.sort(a, 1)),
    "delete": (lambda s, a, b, v: a.delete([1], 1), lambda a, b, v: np.delete(a, [1], 1)),
    "insert": (lambda s, a, b, v: v.insert(2, G.array(s, [9.0])), lambda a, b, v: np.insert(v, 2, 9.0)),
    "put": (lambda s, a, b, v: v.put(G.array(s, [0, -1, 0]), G.array(s, [7.0, 8.0, 9.0])), lambda a, b, v: np.array([9.0, *v[1:-1], 8.0])),
    "set": (lambda s, a, b, v: a.set((slice(None), 1), 5.0), lambda a, b, v: np.stack([a[:, 0], [5, 5], a[:, 2]], 1)),
    "add_at": (lambda s, a, b, v: v.add_at(G.array(s, [1, 1]), G.array(s, [1.0, 2.0])), lambda a, b, v: v + [0, 3, 0, 0, 0, 0]),
    "reduceat": (lambda s, a, b, v: v.add_reduceat([0, 3, 1]), lambda a, b, v: np.add.reduceat(v, [0, 3, 1])),
    "concat": (lambda s, a, b, v: G.concatenate([a, b], 1), lambda a, b, v: np.concatenate([a, b], 1)),
    "stack": (lambda s, a, b, v: G.stack([a, b], 1), lambda a, b, v: np.stack([a, b], 1)),
    "dstack": (lambda s, a, b, v: G.dstack([v, v]), lambda a, b, v: np.dstack([v, v])),
    "block": (lambda s, a, b, v: G.block([[a, b], [b, a]]), lambda a, b, v: np.block([[a, b], [b, a]])),
    "array_split": (lambda s, a, b, v: G.array_split(v, 4)[1], lambda a, b, v: np.array_split(v, 4)[1]),
    "where": (lambda s, a, b, v: G.where(a > b, a, 0.0), lambda a, b, v: np.where(a > b, a, 0.0)),
    "select": (lambda s, a, b, v: G.select([a > 3, a > 0], [a, b], -1.0), lambda a, b, v: np.select([a > 3, a > 0], [a, b], -1.0)),
    "choose": (lambda s, a, b, v: G.choose(G.array(s, [1, 0, 2]), [10, 20, 30]), lambda a, b, v: np.choose([1, 0, 2], [10, 20, 30])),
    "piecewise": (lambda s, a, b, v: G.piecewise(v, [v < 0, v > 2], [lambda x: -x, 7.0]), lambda a, b, v: np.piecewise(v, [v < 0, v > 2], [lambda x: -x, 7.0])),
    "sliding": (lambda s, a, b, v: v.sliding_window_view(3), lambda a, b, v: np.lib.stride_tricks.sliding_window_view(v, 3)),
    "as_strided": (lambda s, a, b, v: v.as_strided([2, 3], [3, 1]), lambda a, b, v: v.reshape(2, 3)),
    "trim": (lambda s, a, b, v: G.array(s, [0.0, 1.0, 0.0, 2.0, 0.0]).trim_zeros(), lambda a, b, v: np.array([1.0, 0.0, 2.0])),
    "diagonal": (lambda s, a, b, v: a.diagonal(1), lambda a, b, v: a.diagonal(1)),
    "diag": (lambda s, a, b, v: G.diag(v[:2], -1), lambda a, b, v: np.diag(v[:2], -1)),
    "tril": (lambda s, a, b, v: a.tril(-1), lambda a, b, v: np.tril(a, -1)),
    "vander": (lambda s, a, b, v: G.vander(v, 3), lambda a, b, v: np.vander(v, 3)),
    "linspace": (lambda s, a, b, v: G.linspace(s, 1, 2, 5), lambda a, b, v: np.linspace(1, 2, 5)),
    "geomspace": (lambda s, a, b, v: G.geomspace(s, 1, 100, 3), lambda a, b, v: np.geomspace(1, 100, 3)),
    "arange": (lambda s, a, b, v: G.arange(s, 1, 8, 3), lambda a, b, v: np.arange(1, 8, 3)),
    "eye": (lambda s, a, b, v: G.eye(s, 3, 4, 1), lambda a, b, v: np.eye(3, 4, 1)),
    "meshgrid": (lambda s, a, b, v: G.meshgrid(v[:2], v)[0], lambda a, b, v: np.meshgrid(v[:2], v)[0]),
    "matmul": (lambda s, a, b, v: a @ b.T, lambda a, b, v: a @ b.T),
    "matvec": (lambda s, a, b, v: a @ v[:3], lambda a, b, v: a @ v[:3]),
    "outer": (lambda s, a, b, v: L.outer(v, v), lambda a, b, v: np.outer(v, v)),
    "kron": (lambda s, a, b, v: L.kron(a, b), lambda a, b, v: np.kron(a, b)),
    "cross": (lambda s, a, b, v: L.cross(a, b), lambda a, b, v: np.cross(a, b)),
    "tensordot": (lambda s, a, b, v: L.tensordot(a, b, 2), lambda a, b, v: np.tensordot(a, b, 2)),
    "einsum": (lambda s, a, b, v: L.einsum("ij,kj,k->i", a, b, v[:2]), lambda a, b, v: np.einsum("ij,kj,k->i", a, b, v[:2])),
    "einsum_dots": (lambda s, a, b, v: L.einsum("...j,...j", a, b), lambda a, b, v: np.einsum("...j,...j", a, b)),
    "norm_inf": (lambda s, a, b, v: L.norm(a, float("inf")), lambda a, b, v: np.linalg.norm(a, np.inf)),
    "norm2": (lambda s, a, b, v: L.norm(a, axis=1), lambda a, b, v: np.linalg.norm(a, axis=1)),
    "multi_dot": (lambda s, a, b, v: L.multi_dot([a, b.T, a]), lambda a, b, v: a @ b.T @ a),
}


@pytest.mark.parametrize("name", CASES)
def test_against_numpy(spark, name):
    ours, theirs = CASES[name]
    found = ours(spark, G.array(spark, A23), G.array(spark, B23), G.array(spark, V))
    same(found, theirs(np.array(A23), np.array(B23), np.array(V)))


@pytest.mark.parametrize("mode", ["constant", "edge", "wrap", "reflect", "symmetric", "maximum", "minimum", "mean", "median", "linear_ramp"])
def test_pad(spark, mode):
    same(G.array(spark, A23).pad(2, 3, 1, mode), np.pad(np.array(A23), [(0, 0), (2, 3)], mode))


def test_dense(spark):
    m = np.array(SQ)
    a = G.array(spark, SQ)
    same(L.inv(a), np.linalg.inv(m))
    same(L.det(a), np.linalg.det(m))
    same(L.solve(a, G.array(spark, [1.0, 2.0, 3.0])), np.linalg.solve(m, [1.0, 2.0, 3.0]))
    same(L.eigvalsh(a), np.linalg.eigvalsh(m))
    same(L.cholesky(a), np.linalg.cholesky(m))
    same(L.matrix_power(a, 5), np.linalg.matrix_power(m, 5))
    stack = np.stack([m, 2 * m, m + np.eye(3)])
    same(L.inv(G.array(spark, stack.tolist())), np.linalg.inv(stack))


def test_running_sum_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("gridspan.layout.BLOCK", 7)
    x = np.arange(100.0) % 13
    a = G.from_column(spark.range(100).withColumn("x", (F.col("id") % 13).cast("double")), "x", "id")
    same(a.cumsum(), np.cumsum(x))
    same(a.maximum_accumulate(), np.maximum.accumulate(x))


def test_masked_and_nan(spark):
    a = G.array(spark, [1.0, None, float("nan"), 4.0])
    assert a.count().tolist() == 3
    assert np.isnan(a.sum().tolist()) and np.isnan(a.min().tolist())
    assert a.compressed().shape == (3,)
    assert a.filled(9.0).tolist()[1] == 9.0
    assert a.cumsum().tolist()[1] is None


def test_empty(spark):
    a = G.array(spark, V)[3:3]
    assert a.shape == (0,) and a.sum().tolist() == 0.0 and a.sort().tolist() == [] and a.diff().shape == (0,)


@pytest.mark.parametrize("kind", ["hot", "text", "null", "nan", "spread"])
def test_ranks_by_ranges(spark, kind):
    """Places by ranges, of any leading type and with a value that most rows have, are those of a plain sort; no range has most rows."""
    n = 4_000
    lead = {
        "hot": lambda k: 1.0 if k % 4 else float(k), "text": lambda k: "x" * (k % 3) + str(k % 50), "null": lambda k: None if k % 3 else float(k % 7),
        "nan": lambda k: math.nan if k % 3 else float(-k), "spread": lambda k: float(k * 7919 % n),
    }[kind]
    rows = [(lead(k), k * 31 % n) for k in range(n)]
    df = spark.createDataFrame(rows, f"v {'string' if kind == 'text' else 'double'}, i long")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] != r[0], 0 if r[0] is None or r[0] != r[0] else r[0], r[1]))
    found = {r.i: r["at"] for r in layout.ranked(df, ["v", "i"], "at").collect()}
    assert [found[i] for _, i in order] == list(range(n))
    sizes = [r["count"] for r in df.withColumn("r", layout.ranges(df, ["v", "i"])).groupBy("r").count().collect()]
    assert max(sizes) < n / 2
    assert layout.ranked(df.limit(0), ["v", "i"], "at").count() == 0


def test_running_by_blocks_of_blocks(spark, monkeypatch):
    x = np.arange(100.0) % 13
    monkeypatch.setattr(layout, "BLOCK", 4)
    monkeypatch.setattr(layout, "BLOCKS", 3)
    same(G.array(spark, x.tolist()).cumsum(), np.cumsum(x))


@pytest.mark.parametrize("bounds", [[0], [0, 4, 1, 5, 2, 6], [3, 3, 3, 40, 2, 41], [0, 7, 16, 17, 33, 200], [250, 0], list(range(0, 251, 3)), [(k * 97) % 251 for k in range(251)]])
def test_reduceat(spark, monkeypatch, bounds):
    monkeypatch.setattr(G, "FANOUT", 4)
    x = np.random.default_rng(3).integers(-50, 50, 251)
    a = G.array(spark, x.tolist())
    for given in (bounds, G.array(spark, bounds)):
        assert UFUNCS["add"].reduceat(a, given).tolist() == np.add.reduceat(x, bounds).tolist()
    assert UFUNCS["maximum"].reduceat(a, bounds).tolist() == np.maximum.reduceat(x, bounds).tolist()
    assert UFUNCS["logical_and"].reduceat(a, bounds).tolist() == np.logical_and.reduceat(x, bounds).tolist()


def test_reduceat_of_axes_and_masks_without_comparing_all(spark):
    x = np.arange(60.0).reshape(20, 3)
    found = UFUNCS["add"].reduceat(G.array(spark, x.tolist()), G.array(spark, [0, 5, 19]))
    assert np.allclose(found.tolist(), np.add.reduceat(x, [0, 5, 19]))
    assert np.allclose(UFUNCS["add"].reduceat(G.array(spark, x.tolist()), [0, 2], 1).tolist(), np.add.reduceat(x, [0, 2], 1))
    assert G.array(spark, [1.0, None, 3.0, None]).reduceat(F.sum, [0, 1, 3]).tolist() == [1.0, 3.0, None]
    assert not re.search("NestedLoop|Cartesian|Window", found.df._jdf.queryExecution().executedPlan().toString())


def test_reduceat_asks_each_tier_of_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(G, "FANOUT", 4)
    x, bounds = np.arange(250.0), [0, 200, 3, 249, 17]
    a = G.array(spark, x.tolist())
    found = UFUNCS["add"].reduceat(G.GridArray(a.df.filter("i0 not in (18, 240)"), a.shape), bounds)
    assert found.tolist() == np.add.reduceat(np.where(np.isin(x, [18, 240]), 0, x), bounds).tolist()
    plan = found.df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 2  # 250 cells, 16 blocks


def test_place_takes_values_in_turn(spark):
    x = np.arange(12.0).reshape(3, 4)
    want = x.copy()
    np.place(want, x % 5 != 0, [-1.0, -2.0, -3.0, -4.0])
    a = G.array(spark, x.tolist())
    assert a.place(a.apply(lambda v: v % 5 != 0), G.array(spark, [-1.0, -2.0, -3.0, -4.0])).tolist() == want.tolist()
    assert a.place(a > 100, G.array(spark, [1.0])).tolist() == x.tolist()
    with pytest.raises(ValueError):
        a.place(a > 1, G.array(spark, [1.0])[:0])


def test_put_along_axis_keeps_the_last(spark):
    x, at, new = np.zeros((2, 4)), np.array([[1, 1, 3], [2, 0, 2]]), np.array([[9.0, 5.0, 1.0], [8.0, 3.0, 2.0]])
    want = x.copy()
    np.put_along_axis(want, at, new, 1)
    assert gs.put_along_axis(G.array(spark, x.tolist()), G.array(spark, at.tolist()), G.array(spark, new.tolist()), 1).tolist() == want.tolist()


def test_narrow_arrays_meet_wide_ones_unrepeated(spark):
    """Neither side is repeated over the wider shape before they meet, and a small one goes to every task."""
    x = np.arange(12.0).reshape(3, 4)
    a = G.array(spark, x.tolist())
    found = [a - a.mean(0), a - a.mean(1, keepdims=True), a.anom(), UFUNCS["subtract"].outer(a[0], G.arange(spark, 3)), a[:1] + a[:, 1:2]]
    want = [x - x.mean(0), x - x.mean(1, keepdims=True), x - x.mean(), np.subtract.outer(x[0], np.arange(3)), x[:1] + x[:, 1:2]]
    for got, told in zip(found, want, strict=True):
        same(got, told)
        plan = got.df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan and "broadcast" in plan
