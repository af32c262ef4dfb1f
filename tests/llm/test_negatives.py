import random

import numpy as np
import pytest

from gridspan.llm import negatives as N

SCHEMA = "vec_id long, label int, vector array<long>, cell int, anchor string, place int, block int"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    rows = list({(i, c, tuple(v)) for i, c, v in rows if i is not None and c is not None and v is not None and None not in v})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, c, v in rows:
        if i % every == 0:
            others = sorted({(-dot(v, w), j, d == c) for j, d, w in rows if j != i})
            for s, j, _ in [x for x in others if x[2]][:positives]:
                fit = [x for x in others if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
                out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def check(spark, rows, **more):
    found = N.mine(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA), **more)
    assert sorted(map(tuple, found.collect())) == brute(rows, **more)


def points(rng, n, spread, scale, kinds=4):
    centres = [[rng.gauss(0, scale) for _ in range(6)] for _ in range(8)]
    return [(k, rng.randrange(kinds), [round(rng.gauss(m, spread)) for m in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize(("spread", "scale"), [(5, 100), (60, 60), (1, 2)])
def test_against_all_pairs(spark, monkeypatch, spread, scale):
    """Tight and loose clusters, ties; many cells, parts and blocks."""
    monkeypatch.setattr(N, "PER_PIVOT", 60)
    monkeypatch.setattr(N, "PART", 3)
    monkeypatch.setattr(N, "BLOCK", 250)
    monkeypatch.setattr(N, "STEP", 40)
    rng = random.Random(spread)
    check(spark, points(rng, 700, spread, scale), every=20)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = points(rng, 120, 3, 20)
    rows += [rows[0], rows[0], rows[7], rows[7], (0, 1, [9, 9, 9, 9, 9, 9]), (13, 2, [50, 1]), (14, 0, []), (200, 1, []), (None, 1, [1, 2]), (300, None, [1] * 6), (400, 1, None), (500, 1, [1, None]), (600, 3, [0] * 6), (601, 3, [0] * 6)]
    check(spark, rows)


def test_large_numbers(spark):
    rng = random.Random(2)
    check(spark, [(k, k % 3, [rng.randrange(-(10**8), 10**8) for _ in range(5)]) for k in range(120)], every=10)
    with pytest.raises(OverflowError):
        N.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_empty_tables(spark):
    check(spark, [])
    check(spark, [(1, 1, [1]), (2, 1, [2])])
    check(spark, [(100, 1, [1])])


def test_cells_leave_groups_out():
    """Of well separated cells no row goes to another cell's group."""
    import pyarrow as pa

    pivots = np.array([[100.0, 0, 0], [0, 100.0, 0]])
    cells = N.Cells(pivots, 10_000.0, 2, ["0-0", "1-0"], np.array([0, 1]), np.array([3.0, 3.0]), np.array([0.0, 0.0]), np.array([10.0, 10.0]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([[99, 1], [1, 99]], pa.list_(pa.int64()))], ["vec_id", "label", "vector"])
    assert [r for b in N._serve(cells, False, 1)([batch]) for r in b.to_pylist()] == []
    assert [(r["group"], np.frombuffer(r["ids"], "<i8").tolist()) for b in N._serve(cells, True, 1)([batch]) for r in b.to_pylist()] == [("0-0", [1]), ("1-0", [2])]
