"""Seeded samples as expressions of a row's index: the same row gets the same number under any partitioning.

A uniform number is a hash of (seed, stream, index); distributions with an
inverse are expressions of it, the others run numpy over Arrow batches with a
generator seeded by the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import ColumnOrValue, col


def uniform01(index: ColumnOrValue, seed: int, stream: int = 0) -> Column:
    """[0, 1) on a grid of 2^-53."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), col(index).cast("long"))
    return F.shiftrightunsigned(h, 11).cast("double") / 2.0**53


class Generator:
    """All samplers take the index column first. Each call of one generator draws from another stream."""

    def __init__(self, seed: int = 0):
        self.seed, self.streams = seed, 0

    def _u(self, index: ColumnOrValue) -> Column:
        self.streams += 1
        return uniform01(index, self.seed, self.streams)

    def random(self, index):
        return self._u(index)

    rand = random_sample = random

    def uniform(self, index, low=0.0, high=1.0):
        return self._u(index) * (high - low) + low

    def integers(self, index, low: int, high: int | None = None, endpoint: bool = False):
        low, high = (0, low) if high is None else (low, high)
        return (F.floor(self._u(index) * (high + endpoint - low)) + low).cast("long")

    randint = integers

    def standard_normal(self, index):
        """Box and Muller's transform of two uniform numbers."""
        return F.sqrt(-2 * F.log(1 - self._u(index))) * F.cos(2 * math.pi * self._u(index))

    randn = standard_normal

    def normal(self, index, loc=0.0, scale=1.0):
        return self.standard_normal(index) * scale + loc

    def lognormal(self, index, mean=0.0, sigma=1.0):
        return F.exp(self.normal(index, mean, sigma))

    def exponential(self, index, scale=1.0):
        return -F.log(1 - self._u(index)) * scale

    def standard_exponential(self, index):
        return self.exponential(index)

    def weibull(self, index, a):
        return F.pow(-F.log(1 - self._u(index)), 1.0 / a)

    def rayleigh(self, index, scale=1.0):
        return F.sqrt(-2 * F.log(1 - self._u(index))) * scale

    def power(self, index, a):
        return F.pow(self._u(index), 1.0 / a)

    def pareto(self, index, a):
        return F.pow(1 - self._u(index), -1.0 / a) - 1

    def laplace(self, index, loc=0.0, scale=1.0):
        u = self._u(index)
        return F.when(u < 0.5, loc + scale * F.log(2 * F.greatest(u, F.lit(2.0**-54)))).otherwise(loc - scale * F.log(2 * (1 - u)))

    def logistic(self, index, loc=0.0, scale=1.0):
        u = F.greatest(self._u(index), F.lit(2.0**-54))
        return loc + scale * F.log(u / (1 - u))

    def gumbel(self, index, loc=0.0, scale=1.0):
        return loc - scale * F.log(-F.log(F.greatest(self._u(index), F.lit(2.0**-54))))

    def standard_cauchy(self, index):
        return F.tan(math.pi * (self._u(index) - 0.5))

    def triangular(self, index, left, mode, right):
        u, cut = self._u(index), (mode - left) / (right - left)
        return F.when(u < cut, left + F.sqrt(u * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - u) * (right - left) * (right - mode)))

    def geometric(self, index, p):
        return F.ceil(F.log(1 - self._u(index)) / math.log1p(-p)).cast("long") if p < 1 else F.lit(1).cast("long")

    def choice(self, index, values: Sequence, p: Sequence[float] | None = None):
        """With replacement."""
        items = F.array(*map(F.lit, values))
        if p is None:
            return F.element_at(items, (F.floor(self._u(index) * len(values)) + 1).cast("int"))
        u, sums = self._u(index), np.cumsum(p)
        at = F.size(F.filter(F.array(*(F.lit(float(s)) for s in sums[:-1])), lambda s: s <= u))
        return F.element_at(items, at + 1)

    def _numpy(self, index, draw: Callable[[np.random.Generator], float], kind: str = "double"):
        self.streams += 1
        seed, stream = self.seed, self.streams

        @F.pandas_udf(kind)
        def run(i: pd.Series) -> pd.Series:
            bits = np.random.Philox(key=(seed, stream << 48))
            generator, fresh = np.random.Generator(bits), bits.state

            def drawn(k: int):
                fresh["state"]["key"][1] = (stream << 48) + k % (1 << 48)  # one generator, set to the row's key: making one takes longer than the draw
                bits.state = fresh
                return draw(generator)

            return pd.Series([drawn(k) for k in i.tolist()])

        return run(col(index).cast("long"))

    def multivariate_normal(self, index, mean: Sequence[float], cov: Sequence[Sequence[float]]):
        """array<double>, by the Cholesky factor of the covariance."""
        root = np.linalg.cholesky(np.asarray(cov, float) + 1e-12 * np.eye(len(mean)))
        z = [self.standard_normal(index) for _ in mean]
        return F.array(*(sum((float(root[i, j]) * z[j] for j in range(i + 1)), F.lit(float(m))) for i, m in enumerate(mean)))


def _drawn(name: str, kind: str = "double"):
    def sample(self: Generator, index, *args):
        number = float if kind == "double" else int
        return self._numpy(index, lambda g: number(getattr(g, name)(*args)), kind)

    sample.__name__ = name
    return sample


for _name in ("beta", "gamma", "standard_gamma", "chisquare", "f", "noncentral_chisquare", "noncentral_f", "standard_t", "vonmises", "wald"):
    setattr(Generator, _name, _drawn(_name))
for _name in ("poisson", "binomial", "negative_binomial", "hypergeometric", "logseries", "zipf"):
    setattr(Generator, _name, _drawn(_name, "long"))


def _array_draw(name: str, kind: str):
    def sample(self: Generator, index, *args):
        return self._numpy(index, lambda g: getattr(g, name)(*args).tolist(), kind)

    return sample


Generator.dirichlet = _array_draw("dirichlet", "array<double>")
Generator.multinomial = _array_draw("multinomial", "array<long>")
Generator.bytes = lambda self, index, n: self._numpy(index, lambda g: g.bytes(n), "binary")


class SeedSequence:
    """Seeds for independent generators."""

    def __init__(self, entropy: int = 0):
        self.entropy = entropy

    def spawn(self, n: int) -> list[SeedSequence]:
        return [SeedSequence(int(np.random.SeedSequence(self.entropy, spawn_key=(k,)).generate_state(1, np.uint64)[0] >> 1)) for k in range(n)]

    def generate_state(self, n: int) -> list[int]:
        return np.random.SeedSequence(self.entropy).generate_state(n).tolist()


def default_rng(seed: int | SeedSequence = 0) -> Generator:
    return Generator(seed.entropy if isinstance(seed, SeedSequence) else seed)


#: The named bit generators differ in their streams only; here all are the one hash.
BitGenerator = MT19937 = PCG64 = PCG64DXSM = SFC64 = Philox = SeedSequence
RandomState = Generator


def permutation(df: DataFrame, index: str, seed: int = 0) -> DataFrame:
    """The rows in a random order, a distributed sort by a hash of the index."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(index)), index)


shuffle = permutation


def sample_without_replacement(df: DataFrame, index: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, all choices alike: those of the smallest hashes, by a bounded heap in each task."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(index)), index).limit(n)
