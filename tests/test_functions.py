"""Functions against numpy and Python, sources, masked arrays, streams."""

import math
import tracemalloc
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan import array as G
from gridspan.functions import dates as D
from gridspan.functions import elementwise as E
from gridspan.functions import polynomials as P
from gridspan.functions import strings as S
from gridspan.functions import types as T
from gridspan.functions.random import default_rng
from gridspan.operators import masked as M
from gridspan.operators import spectral as FT
from gridspan.operators import ufunc as U
from gridspan.sources import npy, text

SPECIAL = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, float("inf"), float("-inf"), float("nan"), 1e300, 5e-324]


def evaluate(spark, values, make, kind="double"):
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "id long, " + ", ".join(f"{c} {kind}" for c in "ab"[: len(values[0])]))
    return [r.v for r in df.select("id", make().alias("v")).orderBy("id").collect()]


BINARY = {"divide": np.divide, "floor_divide": np.floor_divide, "remainder": np.remainder, "fmod": np.fmod, "maximum": np.maximum, "minimum": np.minimum, "fmax": np.fmax, "fmin": np.fmin, "copysign": np.copysign, "logaddexp": np.logaddexp, "hypot": np.hypot, "equal": np.equal, "less": np.less, "heaviside": np.heaviside, "nextafter": np.nextafter}
UNARY = {"sign": np.sign, "log": np.log, "log1p": np.log1p, "sqrt": np.sqrt, "floor": np.floor, "ceil": np.ceil, "trunc": np.trunc, "rint": np.rint, "reciprocal": np.reciprocal, "isfinite": np.isfinite, "signbit": np.signbit, "sinc": np.sinc, "nan_to_num": np.nan_to_num}


@pytest.mark.parametrize("name", BINARY)
def test_binary_specials(spark, name):
    pairs = [(a, b) for a in SPECIAL for b in SPECIAL]
    with np.errstate(all="ignore"):
        want = [BINARY[name](a, b) for a, b in pairs]
    for (a, b), got, w in zip(pairs, evaluate(spark, pairs, lambda: getattr(E, name)("a", "b")), want, strict=True):
        if name == "floor_divide" and (math.isinf(a) or math.isinf(b)):
            continue
        assert got == pytest.approx(float(w), rel=1e-12, nan_ok=True), (a, b)


@pytest.mark.parametrize("name", UNARY)
def test_unary_specials(spark, name):
    with np.errstate(all="ignore"):
        want = [UNARY[name](a) for a in SPECIAL]
    for a, got, w in zip(SPECIAL, evaluate(spark, [(a,) for a in SPECIAL], lambda: getattr(E, name)("a")), want, strict=True):
        assert got == pytest.approx(float(w), rel=1e-12, nan_ok=True), a


def test_special_functions(spark):
    x = [(0.5,), (1.0,), (3.7,), (12.0,)]
    assert evaluate(spark, x, lambda: E.gamma("a")) == pytest.approx([math.gamma(v) for (v,) in x])
    assert evaluate(spark, x, lambda: E.erf("a")) == pytest.approx([math.erf(v) for (v,) in x])
    assert evaluate(spark, [(2.0,)], lambda: E.j0("a")) == pytest.approx([0.22389077914123567])
    assert evaluate(spark, [(2.0,)], lambda: E.j1("a")) == pytest.approx([0.5767248077568734])
    assert evaluate(spark, [(2.0,)], lambda: E.y0("a")) == pytest.approx([0.5103756726497451], rel=1e-6)
    assert evaluate(spark, [(2.0,)], lambda: E.y1("a")) == pytest.approx([-0.10703243154093755], rel=1e-6)
    assert evaluate(spark, [(None,)], lambda: E.gamma("a")) == [None]


TEXTS = ["", "Hello World", "abc abc", "  x  ", "ÉCOLE été", "a\tb\n", "123", "-42", "don't stop", "ABC", "aXbXc"]
PY = {
    "center": (lambda: S.center("a", 14, "*"), lambda s: s.center(14, "*")), "zfill": (lambda: S.zfill("a", 6), lambda s: s.zfill(6)), "title": (lambda: S.title("a"), str.title), "swapcase": (lambda: S.swapcase("a"), str.swapcase),
    "strip": (lambda: S.strip("a"), str.strip), "split": (lambda: S.split("a"), str.split), "split_sep": (lambda: S.split("a", "X", 1), lambda s: s.split("X", 1)), "rsplit": (lambda: S.rsplit("a", "X", 1), lambda s: s.rsplit("X", 1)),
    "splitlines": (lambda: S.splitlines("a"), str.splitlines), "count": (lambda: S.count("a", "abc"), lambda s: s.count("abc")), "find": (lambda: S.find("a", "b"), lambda s: s.find("b")), "rfind": (lambda: S.rfind("a", "X"), lambda s: s.rfind("X")),
    "isalpha": (lambda: S.isalpha("a"), str.isalpha), "isdigit": (lambda: S.isdigit("a"), str.isdigit), "isupper": (lambda: S.isupper("a"), str.isupper), "islower": (lambda: S.islower("a"), str.islower), "isspace": (lambda: S.isspace("a"), str.isspace),
    "istitle": (lambda: S.istitle("a"), str.istitle), "partition": (lambda: S.partition("a", "X"), lambda s: s.partition("X")), "rpartition": (lambda: S.rpartition("a", "X"), lambda s: s.rpartition("X")), "expandtabs": (lambda: S.expandtabs("a", 4), lambda s: s.expandtabs(4)),
    "capitalize": (lambda: S.capitalize("a"), str.capitalize), "replace": (lambda: S.replace("a", "a", "_", 1), lambda s: s.replace("a", "_", 1)), "lstrip": (lambda: S.lstrip("a", "A-"), lambda s: s.lstrip("A-")),
}


@pytest.mark.parametrize("name", PY)
def test_strings(spark, name):
    ours, theirs = PY[name]
    got = evaluate(spark, [(t,) for t in TEXTS], ours, "string")
    assert [tuple(g) if name.endswith("partition") else g for g in got] == [theirs(t) for t in TEXTS]


def test_business_days(spark):
    calendar = D.busdaycalendar("Mon Tue Wed Thu Sat", [date(2024, 1, 1), date(2024, 1, 6)])
    theirs = np.busdaycalendar([1, 1, 1, 1, 0, 1, 0], ["2024-01-01", "2024-01-06"])
    days = [np.datetime64("2023-12-20") + k for k in range(40)]
    df = spark.createDataFrame([(k, d.item(), days[(k * 7) % 40].item()) for k, d in enumerate(days)], "id long, a date, b date")
    rows = df.select("id", D.is_busday("a", calendar).alias("w"), D.busday_count("a", "b", calendar).alias("n"), D.busday_offset("a", 5, "forward", calendar).alias("o"), D.busday_offset("a", -3, "backward").alias("p")).orderBy("id").collect()
    for k, r in enumerate(rows):
        assert r.w == np.is_busday(days[k], busdaycal=theirs)
        assert r.n == np.busday_count(days[k], days[(k * 7) % 40], busdaycal=theirs)
        assert r.o == np.busday_offset(days[k], 5, "forward", busdaycal=theirs).item()
        assert r.p == np.busday_offset(days[k], -3, "backward").item()


@pytest.mark.parametrize("kind", P.BASES)
def test_polynomials(spark, kind):
    x = [(v,) for v in (-0.9, 0.0, 0.3, 1.7)]
    c = [1.0, -2.0, 0.5, 3.0]
    cls = P._class(kind)
    plain = lambda k: cls(k)(np.array([v for (v,) in x]))
    assert evaluate(spark, x, lambda: P.val("a", c, kind)) == pytest.approx(plain(c).tolist())
    assert [r[3] for r in evaluate(spark, x, lambda: P.vander("a", 3, kind))] == pytest.approx(cls.basis(3)(np.array([v for (v,) in x])).tolist())
    assert P.to_power(P.line(2.0, 3.0, kind), kind) == pytest.approx([2.0, 3.0])
    assert evaluate(spark, x, lambda: P.val("a", P.der(c, 1, kind), kind)) == pytest.approx(cls(c).deriv()(np.array([v for (v,) in x])).tolist())


def test_types():
    for a in T.DTYPES:
        for b in T.DTYPES:
            if T.DTYPES[a][0] in "buifc" and T.DTYPES[b][0] in "buifc":
                assert T.promote_types(a, b) == np.promote_types(a, b).name
                assert T.can_cast(a, b) == np.can_cast(a, b)
    assert T.min_scalar_type(300) == "uint16" and T.min_scalar_type(-1) == "int8"
    assert T.issubdtype("int8", "integer") and not T.issubdtype("float32", "integer")


def test_random_is_repeatable_and_right(spark):
    df = spark.range(20_000)
    draw = lambda n: [r.v for r in df.repartition(n).select("id", default_rng(3).normal("id", 5.0, 2.0).alias("v")).orderBy("id").collect()]
    a = draw(1)
    assert a == draw(5)
    assert np.mean(a) == pytest.approx(5.0, abs=0.06) and np.std(a) == pytest.approx(2.0, abs=0.06)
    g = default_rng(1)
    row = df.select(F.avg(g.exponential("id", 2.0)), F.avg(g.poisson("id", 4.0)), F.avg(g.integers("id", 1, 7)), F.avg(g.triangular("id", 0.0, 1.0, 2.0))).first()
    assert list(row) == pytest.approx([2.0, 4.0, 3.5, 1.0], abs=0.08)


def test_fft(spark):
    x = np.random.default_rng(0).normal(size=(3, 8))
    a = G.array(spark, x.tolist())
    pair = lambda z: np.stack([z.real, z.imag], -1)
    np.testing.assert_allclose(np.array(FT.fft(a).tolist()), pair(np.fft.fft(x)), atol=1e-12)
    np.testing.assert_allclose(np.array(FT.fft2(a).tolist()), pair(np.fft.fft2(x)), atol=1e-12)
    np.testing.assert_allclose(np.array(FT.irfft(FT.rfft(a)).tolist()), x, atol=1e-12)
    np.testing.assert_allclose(np.array(FT.convolve(a[0], [1.0, 2.0, 3.0], "same").tolist()), np.convolve(x[0], [1, 2, 3], "same"), atol=1e-12)
    np.testing.assert_allclose(np.array(FT.kaiser(spark, 7, 5.0).tolist()), np.kaiser(7, 5.0), atol=1e-12)


def test_masked(spark):
    m = np.ma.masked_greater(np.array([[1.0, 5.0, 3.0], [7.0, 2.0, 9.0]]), 6)
    a = M.masked_greater(G.array(spark, [[1.0, 5.0, 3.0], [7.0, 2.0, 9.0]]), 6)
    assert a.tolist() == [[1.0, 5.0, 3.0], [None, 2.0, None]]
    assert M.count(a, 1).tolist() == m.count(1).tolist() and M.count_masked(a).tolist() == 2
    assert M.mean(a).tolist() == pytest.approx(m.mean()) and M.max_(a, 0).tolist() == [1.0, 5.0, 3.0]
    assert M.compress_rowcols(a, 1).tolist() == np.ma.compress_cols(m).tolist()
    assert M.mask_rows(a).tolist() == [[1.0, 5.0, 3.0], [None] * 3]
    assert sorted(tuple(r) for r in M.clump_unmasked(a).collect()) == [(0, 3), (4, 5)]
    assert M.divide(a, 0.0).tolist() == [[None] * 3] * 2
    assert M.allequal(a, a) and M.is_masked(a)


def test_ufuncs(spark):
    a = G.array(spark, [3.0, 1.0, 2.0])
    assert U.UFUNCS["add"].accumulate(a).tolist() == [3.0, 4.0, 6.0]
    assert U.UFUNCS["maximum"].reduce(a).tolist() == 3.0
    assert U.UFUNCS["multiply"].outer(a, a).tolist() == np.outer([3, 1, 2], [3, 1, 2]).tolist()
    assert U.UFUNCS["add"].at(a, G.array(spark, [0, 0]), G.array(spark, [1.0, 1.0])).tolist() == [5.0, 1.0, 2.0]
    assert U.apply_along_axis(np.cumsum, 0, a, 3).tolist() == [3.0, 4.0, 6.0]


def test_text_sources(spark, tmp_path):
    path = str(tmp_path / "m.txt")
    with open(path, "w") as f:
        f.write("# head\n1 2 3\n\n4 5 6 # tail\n7 8 9\n")
    np.testing.assert_array_equal(text.loadtxt(spark, path).tolist(), np.loadtxt(path))
    np.testing.assert_array_equal(text.loadtxt(spark, path, usecols=[2, 0], max_rows=2).tolist(), np.loadtxt(path, usecols=[2, 0], max_rows=2))
    with open(path, "w") as f:
        f.write("1,x,3\n4,NA,6\n")
    np.testing.assert_array_equal(text.genfromtxt(spark, path, ",").tolist(), np.genfromtxt(path, delimiter=","))
    out = str(tmp_path / "out")
    text.savetxt(spark.createDataFrame([(1.5, 2.0), (3.0, 4.0)], "a double, b double").coalesce(1), ["a", "b"], out, "%.2f", ",")
    assert [r.value for r in spark.read.text(out).collect()] == ["1.50,2.00", "3.00,4.00"]
    text.savez(str(tmp_path / "z"), a=spark.range(3), b=spark.range(2))
    z = text.NpzFile(spark, str(tmp_path / "z"), ["a", "b"])
    assert z["a"].count() == 3 and z.b.count() == 2 and len(z) == 2


def test_npy_sources(spark, tmp_path):
    x = np.arange(12.0).reshape(3, 4)
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "y.npz", p=x[0], q=x[:, 1])
    rows = npy.load(spark, str(tmp_path)).collect()
    assert {(r.name, tuple(r.shape)) for r in rows} == {("arr_0", (3, 4)), ("p", (4,)), ("q", (3,))}
    assert [r.x for r in sorted(rows, key=lambda r: r.flat) if r.name == "arr_0"] == x.ravel().tolist()
    df = npy.save(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v")
    assert npy.decode(bytes(df.first().data)).tolist() == [1.0, 2.0]
    assert npy.frombuffer(df.select(F.lit(b"\x00\x00\x00\x00\x00\x00\xf0?").alias("c")), "c").first()["values"] == [1.0]


def test_stream(spark, tmp_path):
    from gridspan.streaming import histogram

    src = str(tmp_path / "in")
    spark.createDataFrame([(k, float(k % 10)) for k in range(100)], "s long, x double").select(F.timestamp_seconds("s").alias("ts"), "x").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, x double").parquet(src)
    query = histogram(stream, "ts", "x", 0.0, 10.0, 5, "50 seconds").writeStream.format("memory").queryName("h").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(count) n, count(*) c from h").first() == (100, 10)


def test_one_namespace(spark):
    from gridspan import api as gs

    a = gs.array(spark, [[1.0, 2.0], [3.0, float("nan")]])
    assert gs.nansum(a, axis=0).tolist() == [4.0, 2.0]
    assert gs.sin(gs.array(spark, [0.0])).tolist() == [0.0]
    assert gs.maximum(2.5, gs.array(spark, [1.0, 3.0])).tolist() == [2.5, 3.0]
    assert gs.sum(gs.array(spark, [1.0, 2.0])).tolist() == 3.0
    assert [i.tolist() for i in gs.tril_indices(spark, 3)] == [i.tolist() for i in np.tril_indices(3)]
    assert spark.range(6).select(*gs.unravel_index(F.col("id"), (2, 3))).collect()[4] == (1, 1)
    assert gs.round(gs.array(spark, [2.5]), 0).tolist() == [2.0] and gs.gamma(gs.array(spark, [5.0])).tolist() == [24.0]


def test_format_float_scientific_rounds_the_exact_value(spark):
    values = [10005.0, 10015.0, 12345.0, 0.00012345, 2.5, -10025.0, 0.0, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.v for r in df.select(S.format_float_scientific("x", 3).alias("v")).collect()]
    assert got == [None if v is None else "%.3e" % v for v in values]


@pytest.mark.parametrize(("name", "args"), [("dirichlet", ([1.0, 2.0],)), ("bytes", (5,)), ("logseries", (0.5,)), ("f", (5.0, 12.0)), ("binomial", (10, 0.3))])
def test_a_row_draws_from_its_own_key(spark, name, args):
    """Whatever rows it meets in its batch, and without a new generator for each."""
    df = spark.range(40).repartition(3)
    got = {r.id: r.v for r in df.select("id", getattr(default_rng(9), name)("id", *args).alias("v")).collect()}
    for k in range(40):
        want = getattr(np.random.Generator(np.random.Philox(key=(9, (1 << 48) + k))), name)(*args)
        assert (bytes(got[k]) if name == "bytes" else got[k]) == (want.tolist() if isinstance(want, np.ndarray) else want)


def test_masked_sets_by_one_aggregation(spark):
    """No row is sorted to meet another: memory goes with the values, not with the rows."""
    a, b = (spark.createDataFrame([(v,) for v in rows], "x double") for rows in ([1.0, 1.0, 2.0, None, float("nan"), -0.0], [2.0, 2.0, None, 3.0, 0.0]))
    for f, want in ((M.intersect1d, {None, 2.0, 0.0}), (M.setdiff1d, {1.0, "nan"}), (M.setxor1d, {1.0, 3.0, "nan"})):
        found = f(a, "x", b, "x")
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = ["nan" if r.x != r.x else r.x for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_bessel_memory_does_not_follow_the_length():
    x = np.linspace(-2.5, 2.5, 5000)
    for kind, at in (("j", x), ("y", x + 3)):
        tracemalloc.start()
        found = E.bessel(kind, 1, at)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10e6
        assert np.allclose(found[::500], np.concatenate([E.bessel(kind, 1, at[k : k + 1]) for k in range(0, 5000, 500)]), rtol=1e-12, atol=1e-14)
