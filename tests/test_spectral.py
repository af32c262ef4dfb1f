import numpy as np
import pytest

from gridspan import array as G
from gridspan.operators import spectral as FT

RNG = np.random.default_rng(7)


def real(spark, x):
    return G.array(spark, x.tolist())


def pairs(x):
    return np.stack([x.real, x.imag], axis=-1)


def cplx(spark, x):
    return G.array(spark, pairs(x).tolist())


def same(found, want):
    found = np.array(found.tolist(), float)
    want = pairs(want) if np.iscomplexobj(want) else want
    assert found.shape == want.shape and np.allclose(found, want, atol=1e-9)


@pytest.mark.parametrize(("lane", "n"), [(4096, 60), (8, 60), (8, 61), (8, 62)])
def test_short_and_long_lanes(spark, monkeypatch, lane, n):
    """At once, by four steps, and, for a prime and twice a prime, by a convolution."""
    monkeypatch.setattr(FT, "LANE", lane)
    x, z = RNG.normal(size=n), RNG.normal(size=n) + 1j * RNG.normal(size=n)
    same(FT.fft(real(spark, x)), np.fft.fft(x))
    same(FT.ifft(cplx(spark, z), norm="ortho"), np.fft.ifft(z, norm="ortho"))
    same(FT.irfft(cplx(spark, z[:31])), np.fft.irfft(z[:31]))


def test_lengths_and_axes(spark, monkeypatch):
    x, z = RNG.normal(size=(4, 6, 5)), RNG.normal(size=(3, 6)) + 1j * RNG.normal(size=(3, 6))
    for n in (4, 9):
        same(FT.rfft(real(spark, x), n, 1), np.fft.rfft(x, n, 1))
        same(FT.irfft(cplx(spark, z), n), np.fft.irfft(z, n))
    same(FT.hfft(cplx(spark, z)), np.fft.hfft(z))
    same(FT.ihfft(real(spark, x[0])), np.fft.ihfft(x[0]))
    same(FT.fftn(real(spark, x)), np.fft.fftn(x))
    same(FT.ifftn(cplx(spark, z)), np.fft.ifftn(z))
    same(FT.rfftn(real(spark, x), (0, 2)), np.fft.rfftn(x, axes=(0, 2)))
    same(FT.irfftn(cplx(spark, z)), np.fft.irfftn(z))


def test_of_an_array_column_without_a_shuffle(spark):
    x = RNG.normal(size=(5, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    found = FT.rfft(G.from_rows(df, "v", "k"))
    same(found, np.fft.rfft(x))
    assert "Exchange" not in found.df._jdf.queryExecution().executedPlan().toString()


def test_no_group_is_larger_than_about_the_root(spark, monkeypatch):
    import pyspark.sql.functions as F

    monkeypatch.setattr(FT, "LANE", 64)
    sizes, lanes = [], FT._lanes

    def watched(df, keys, axis, n, *args, **options):
        sizes.append(n)
        return lanes(df, keys, axis, n, *args, **options)

    monkeypatch.setattr(FT, "_lanes", watched)
    x = RNG.normal(size=10_000)
    a = G.GridArray(spark.range(10_000).select(F.col("id").alias("i0"), F.get(F.array(*(F.lit(float(v)) for v in x[:1])), F.lit(0)).alias("x")), [10_000])
    assert FT.fft(a).df.count() == 20_000 and max(sizes) <= 100


@pytest.mark.parametrize("kernel", [16, 1024, 3])
def test_convolve_of_two_columns(spark, monkeypatch, kernel):
    """Blocks of one against all of a short one; products of transforms for two long ones."""
    monkeypatch.setattr(FT, "KERNEL", kernel)
    monkeypatch.setattr(FT, "LANE", 32)
    x, y = RNG.normal(size=300), RNG.normal(size=11)
    for mode in ("full", "same", "valid"):
        same(FT.convolve(real(spark, x), real(spark, y), mode), np.convolve(x, y, mode))
        same(FT.correlate(real(spark, x), real(spark, y), mode), np.correlate(x, y, mode))
    same(FT.convolve(real(spark, y), real(spark, x)), np.convolve(x, y))
    same(FT.convolve(real(spark, y), list(RNG.normal(size=70) * 0 + 2.0)), np.convolve(y, np.full(70, 2.0)))


def test_long_transforms_meet_in_a_shuffle(spark, monkeypatch):
    """A transform is larger than the table it came from, so the planner's estimate must not send it to every task."""
    monkeypatch.setattr(FT, "KERNEL", 8)
    monkeypatch.setattr(FT, "FEW", 64)
    x, y = np.arange(90.0) % 7, np.arange(50.0) % 5
    found = FT.convolve(G.array(spark, x.tolist()), G.array(spark, y.tolist()))
    assert "strategy=merge" in found.df._jdf.queryExecution().optimizedPlan().toString()
    np.testing.assert_allclose(found.tolist(), np.convolve(x, y), atol=1e-9)
