import numpy as np
import pytest

from gridspan import array as G
from gridspan.operators import linalg as L
from gridspan.operators import blocked, tall, tiles

RNG = np.random.default_rng(11)


def real(spark, x):
    return G.array(spark, x.tolist())


def values(a):
    return np.array(a.tolist(), float)


@pytest.fixture
def small_parts(monkeypatch):
    """Several tiles, splits, strips and levels for a small matrix."""
    monkeypatch.setattr(tiles, "SIDE", 5)
    monkeypatch.setattr(tiles, "PAIRS", 2)
    monkeypatch.setattr(tall, "STRIP", 6)
    monkeypatch.setattr(tall, "FAN", 2)


def test_products_of_tiles(spark, small_parts):
    a, b = RNG.normal(size=(13, 22)), RNG.normal(size=(22, 7))
    product = L.matmul(real(spark, a), real(spark, b))
    assert np.allclose(values(product), a @ b, atol=1e-9)
    assert "Join" not in product.df._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(values(L.tensordot(real(spark, a), real(spark, b.T), ([1], [1]))), a @ b, atol=1e-9)
    assert np.allclose(values(L.inner(real(spark, a), real(spark, a))), a @ a.T, atol=1e-9)


def test_masked_and_not_finite_cells_in_products(spark, small_parts):
    a = [[1.0, None, 3.0], [None, None, None], [float("nan"), 1.0, float("inf")]]
    b = [[1.0, 2.0], [None, 5.0], [7.0, 0.0]]
    found = L.matmul(G.array(spark, a), G.array(spark, b)).tolist()
    assert found[0] == [22.0, 2.0] and found[1] == [None, None]
    assert np.isnan(found[2]).all()


def test_integers_stay_exact(spark):
    big = 2**53 + 1
    assert L.matmul(G.array(spark, [[big, 0], [0, 1]]), G.array(spark, [[1, 0], [0, 1]])).tolist() == [[big, 0], [0, 1]]


@pytest.mark.parametrize("rows", [4, 6, 29])
def test_tall_factors(spark, small_parts, rows):
    a = RNG.normal(size=(rows, 3))
    q, r = (values(x) for x in L.qr(real(spark, a)))
    want = np.linalg.qr(a)[1]
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(3)) and np.allclose(r, want * np.sign(np.diagonal(want))[:, None])
    u, s, vt = (values(x) for x in L.svd(real(spark, a), full_matrices=False))
    assert np.allclose(u * s @ vt, a) and np.allclose(s, np.linalg.svd(a)[1])
    assert np.allclose(values(L.pinv(real(spark, a))), np.linalg.pinv(a))


def test_tall_of_deficient_rank(spark, small_parts):
    a = RNG.normal(size=(23, 3))
    a = np.column_stack([a, a[:, 0] + a[:, 1]])
    y = RNG.normal(size=23)
    assert L.matrix_rank(real(spark, a)).tolist() == 3
    assert np.allclose(values(L.lstsq_small(real(spark, a), real(spark, y))), np.linalg.lstsq(a, y, rcond=None)[0])
    assert np.allclose(values(L.lstsq_small(real(spark, a), real(spark, np.stack([y, 2 * y], 1)))), np.linalg.lstsq(a, np.stack([y, 2 * y], 1), rcond=None)[0])


@pytest.mark.parametrize("n", [6, 10, 23])
def test_elimination_by_panels(spark, small_parts, monkeypatch, n):
    monkeypatch.setattr(blocked, "FAN", 2)
    a, b = RNG.normal(size=(n, n)), RNG.normal(size=(n, 7))
    a[0, 0] = 0.0  # no pivot where the diagonal begins
    given = real(spark, a)
    assert np.allclose(values(L.solve(given, real(spark, b))), np.linalg.solve(a, b))
    assert np.allclose(values(L.solve(given, real(spark, b[:, 0]))), np.linalg.solve(a, b[:, 0]))
    assert np.allclose(values(L.inv(given)), np.linalg.inv(a))
    assert np.allclose(values(L.slogdet(given)), np.linalg.slogdet(a))
    assert np.allclose(values(L.det(given)), np.linalg.det(a))


def test_elimination_of_odd_matrices(spark, small_parts):
    turned = np.roll(np.eye(12), 5, 0)  # every pivot is in another tile
    assert np.allclose(values(L.inv(real(spark, turned))), turned.T)
    assert L.det(real(spark, turned)).tolist() == round(np.linalg.det(turned))
    single = RNG.normal(size=(11, 11))
    single[:, 7] = 0.0
    assert L.slogdet(real(spark, single)).tolist() == [0.0, -np.inf]
    with pytest.raises(np.linalg.LinAlgError):
        L.inv(real(spark, single))
    masked = np.diag(np.arange(1.0, 13)).tolist()
    masked = [[x or None for x in row] for row in masked]  # whole tiles without a cell
    assert np.allclose(values(L.inv(G.array(spark, masked))), np.diag(1 / np.arange(1.0, 13)))


@pytest.mark.parametrize("n", [6, 10, 23])
def test_cholesky_by_panels(spark, small_parts, n):
    a = RNG.normal(size=(n, n))
    a = a @ a.T + np.eye(n)
    assert np.allclose(values(L.cholesky(real(spark, a))), np.linalg.cholesky(a))
    with pytest.raises(np.linalg.LinAlgError):
        L.cholesky(real(spark, a - 2 * np.trace(a) * np.eye(n)))


def test_leading_eigenvalues(spark, small_parts):
    q = np.linalg.qr(RNG.normal(size=(31, 31)))[0]
    given = np.array([-9.0, 8.0, 5.0, *np.linspace(-0.5, 0.5, 28)])
    a = q * given @ q.T
    w, v = (values(x) for x in L.eigh_leading(real(spark, a), 3))
    assert np.allclose(w, given[:3]) and np.allclose(a @ v, v * w, atol=1e-7) and np.allclose(v.T @ v, np.eye(3))
    assert np.allclose(values(L.eigh_leading(real(spark, np.zeros((7, 7))), 2)[0]), 0)


def test_leading_eigenvalues_of_a_product_that_is_not_formed(spark, small_parts, monkeypatch):
    e = RNG.normal(size=(41, 3)) * [3.0, 2.0, 1.0]
    sizes = []
    tiled = tiles.tiled
    monkeypatch.setattr(tiles, "tiled", lambda df, rows, columns: sizes.append(rows * columns) or tiled(df, rows, columns))
    a = real(spark, e)
    w, v = (values(x) for x in L.eigh_leading((a, a.T), 3))
    assert max(sizes) < 41 * 41
    given = np.linalg.eigvalsh(e @ e.T)[::-1][:3]
    assert np.allclose(w, given) and np.allclose(e @ (e.T @ v), v * w, atol=1e-7) and np.allclose(v.T @ v, np.eye(3))


def test_large_arrays_never_meet_by_an_estimated_broadcast(spark, monkeypatch):
    """What tasks make of a small table may be large: sides of more than FEW cells meet in a shuffle, panels by their known size."""
    monkeypatch.setattr(G, "FEW", 8)
    x = np.arange(16.0).reshape(4, 4)
    a = G.array(spark, x.tolist())
    found = a @ a.T + a
    assert "strategy=merge" in found.df._jdf.queryExecution().optimizedPlan().toString()
    np.testing.assert_allclose(found.tolist(), x @ x.T + x)
    panel = spark.range(2)
    plan = lambda n: panel.join(blocked._met(panel, n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1000) and "strategy=merge" in plan(blocked.SENT)


def test_cells_meet_in_pieces(spark, small_parts, monkeypatch):
    """No list of structs is aggregated, whose tasks sort all their cells from 128 tiles or strips on; cells may come in any order."""
    monkeypatch.setattr(tiles, "HELD", 40)
    x = RNG.normal(size=(400, 7))
    a = real(spark, x)
    a.df = a.df.orderBy("x").coalesce(1)
    u, s, vt = L.svd(a, full_matrices=False)
    plan = ((u * s) @ vt).df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "strategy=merge" not in plan
    assert np.allclose(values((u * s) @ vt), x) and np.allclose(values(L.matmul(a, real(spark, x.T))), x @ x.T)
    holes = x.tolist()
    holes[13][2], holes[399] = None, [None] * 7
    a = G.array(spark, holes)
    a.df = a.df.orderBy("x").coalesce(1)
    found = L.matmul(a, real(spark, np.eye(7))).tolist()
    zeros = np.array([[0.0 if v is None else v for v in row] for row in holes])
    assert found[399] == [None] * 7 and np.allclose(np.array(found[:399], float), zeros[:399])
    assert np.allclose(values(L.svdvals(a)), np.linalg.svd(zeros)[1])


def test_a_tile_goes_to_blocks_of_a_product(spark, small_parts, monkeypatch):
    sent, numbers = [], tiles._numbers
    monkeypatch.setattr(tiles, "_numbers", lambda n: sent.append(n) or numbers(n))
    rng = np.random.default_rng(4)
    for rows, inner, columns, most in ((40, 23, 40, 3), (6, 12, 200, 14)):
        a, b = rng.normal(size=(rows, inner)), rng.normal(size=(inner, columns))
        sent.clear()
        np.testing.assert_allclose(values(real(spark, a) @ real(spark, b)), a @ b, atol=1e-12)
        assert max(sent) <= most  # before: every column or row of tiles, 8 and 40


@pytest.mark.parametrize("of", ["inv", "solve", "cholesky"])
def test_panels_are_written_as_bytes_and_without_a_join_for_missing_tiles(spark, small_parts, monkeypatch, of):
    plans, written = [], blocked.written
    monkeypatch.setattr(blocked, "written", lambda df, before=None: plans.append((dict(df.dtypes), df._jdf.queryExecution().optimizedPlan().toString())) or written(df, before))
    x = np.diag(np.arange(1.0, 18.0))
    a = real(spark, x)
    a.df = a.df.filter("x <> 0")  # whole tiles are missing
    found = {"inv": lambda: L.inv(a), "solve": lambda: L.solve(a, real(spark, np.ones(17))), "cholesky": lambda: L.cholesky(a)}[of]()
    np.testing.assert_allclose(values(found), {"inv": np.linalg.inv(x), "solve": 1 / np.diag(x), "cholesky": np.sqrt(x)}[of], atol=1e-12)
    assert all(types["tile"] == "binary" for types, _ in plans)
    assert "Join" not in plans[0][1]
