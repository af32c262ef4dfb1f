"""Polynomials in six bases: evaluation is a column expression, coefficient algebra is driver-side and tiny.

Coefficients are listed from the lowest degree, but for the classic functions
(polyval, polyadd, ..), which list them from the highest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import ColumnOrValue, double

Coefficients = Sequence[float]
#: For each basis the terms a, b, c of P_{n+1} = (a x + b) P_n - c P_{n-1}, and the terms of P_1.
RECURRENCE: dict[str, Callable[[int], tuple[float, float, float]]] = {
    "polynomial": lambda n: (1.0, 0.0, 0.0),
    "chebyshev": lambda n: (2.0 if n else 1.0, 0.0, 1.0),
    "legendre": lambda n: ((2 * n + 1) / (n + 1), 0.0, n / (n + 1)),
    "hermite": lambda n: (2.0, 0.0, 2.0 * n),
    "hermite_e": lambda n: (1.0, 0.0, float(n)),
    "laguerre": lambda n: (-1 / (n + 1), (2 * n + 1) / (n + 1), n / (n + 1)),
}
BASES = tuple(RECURRENCE)


def basis(x: Column, degree: int, kind: str = "polynomial") -> list[Column]:
    """P_0(x) .. P_degree(x)."""
    out = [F.lit(1.0)]
    for n in range(degree):
        a, b, c = RECURRENCE[kind](n)
        step = a * x + b if b else a * x
        out.append(step * out[n] - c * out[n - 1] if c and n else step * out[n])
    return out


def val(x: ColumnOrValue, c: Coefficients, kind: str = "polynomial") -> Column:
    """sum of c[n] P_n(x), by Clenshaw's rule: as many steps as coefficients."""
    x = double(x)
    later, last = F.lit(0.0), F.lit(0.0)
    for n in reversed(range(len(c))):
        a, b, _ = RECURRENCE[kind](n)
        _, _, after = RECURRENCE[kind](n + 1)
        step = (a * x + b if b else a * x) * later
        later, last = F.lit(float(c[n])) + step - (after * last if after else 0.0), later
    return later


def val2d(x: ColumnOrValue, y: ColumnOrValue, c: Sequence[Coefficients], kind: str = "polynomial") -> Column:
    return _mixed([val(y, row, kind) for row in c], double(x), kind)


def val3d(x: ColumnOrValue, y: ColumnOrValue, z: ColumnOrValue, c, kind: str = "polynomial") -> Column:
    return _mixed([val2d(y, z, plane, kind) for plane in c], double(x), kind)


def _mixed(c: list[Column], x: Column, kind: str) -> Column:
    return sum((v * p for v, p in zip(c[1:], basis(x, len(c) - 1, kind)[1:], strict=True)), c[0])


def grid2d(xs: DataFrame, x: str, ys: DataFrame, y: str, c, kind: str = "polynomial") -> DataFrame:
    """All pairs of two grids, with the value: the result itself is that large."""
    return xs.select(x).crossJoin(ys.select(y)).withColumn("value", val2d(x, y, c, kind))


def grid3d(xs: DataFrame, x: str, ys: DataFrame, y: str, zs: DataFrame, z: str, c, kind: str = "polynomial") -> DataFrame:
    return xs.select(x).crossJoin(ys.select(y)).crossJoin(zs.select(z)).withColumn("value", val3d(x, y, z, c, kind))


def vander(x: ColumnOrValue, degree: int, kind: str = "polynomial") -> Column:
    """array<double> of P_0 .. P_degree."""
    return F.array(*(p.cast("double") for p in basis(double(x), degree, kind)))


def vander2d(x: ColumnOrValue, y: ColumnOrValue, degrees: tuple[int, int], kind: str = "polynomial") -> Column:
    return F.array(*((p * q).cast("double") for p in basis(double(x), degrees[0], kind) for q in basis(double(y), degrees[1], kind)))


def vander3d(x, y, z, degrees: tuple[int, int, int], kind: str = "polynomial") -> Column:
    cells = [p * q * r for p in basis(double(x), degrees[0], kind) for q in basis(double(y), degrees[1], kind) for r in basis(double(z), degrees[2], kind)]
    return F.array(*(c.cast("double") for c in cells))


def _class(kind: str):
    names = {"polynomial": "Polynomial", "chebyshev": "Chebyshev", "legendre": "Legendre", "hermite": "Hermite", "hermite_e": "HermiteE", "laguerre": "Laguerre"}
    return getattr(np.polynomial, names[kind])


def add(a: Coefficients, b: Coefficients) -> list[float]:
    n = max(len(a), len(b))
    return [(a[k] if k < len(a) else 0.0) + (b[k] if k < len(b) else 0.0) for k in range(n)]


def sub(a: Coefficients, b: Coefficients) -> list[float]:
    return add(a, [-v for v in b])


def mul(a: Coefficients, b: Coefficients, kind: str = "polynomial") -> list[float]:
    return (_class(kind)(a) * _class(kind)(b)).coef.tolist()


def mulx(a: Coefficients, kind: str = "polynomial") -> list[float]:
    return mul(a, _class(kind).identity().coef, kind)


def div(a: Coefficients, b: Coefficients, kind: str = "polynomial") -> tuple[list[float], list[float]]:
    q, r = divmod(_class(kind)(a), _class(kind)(b))
    return q.coef.tolist(), r.coef.tolist()


def pow(a: Coefficients, n: int, kind: str = "polynomial") -> list[float]:  # noqa: A001
    return (_class(kind)(a) ** n).coef.tolist()


def der(a: Coefficients, m: int = 1, kind: str = "polynomial") -> list[float]:
    return _class(kind)(a).deriv(m).coef.tolist()


def integral(a: Coefficients, m: int = 1, k: Coefficients = (), kind: str = "polynomial") -> list[float]:
    return _class(kind)(a).integ(m, list(k)).coef.tolist()


def roots(a: Coefficients, kind: str = "polynomial") -> list[complex]:
    return _class(kind)(a).roots().tolist()


def fromroots(r: Sequence[float], kind: str = "polynomial") -> list[float]:
    # The window as domain: another one would scale x.
    return _class(kind).fromroots(r, domain=_class(kind).window).coef.tolist() if len(r) else [1.0]


def trim(a: Coefficients, tol: float = 0.0) -> list[float]:
    out = list(a)
    while len(out) > 1 and abs(out[-1]) <= tol:
        out.pop()
    return out


def line(offset: float, scale: float, kind: str = "polynomial") -> list[float]:
    """Coefficients of offset + scale x."""
    first = {"hermite": [offset, scale / 2], "laguerre": [offset + scale, -scale]}
    return first.get(kind, [offset, scale])


def companion(a: Coefficients, kind: str = "polynomial") -> np.ndarray:
    module = {"hermite": "hermcompanion", "hermite_e": "hermecompanion", "chebyshev": "chebcompanion", "legendre": "legcompanion", "laguerre": "lagcompanion", "polynomial": "polycompanion"}
    return getattr(getattr(np.polynomial, kind), module[kind])(a)


def gauss(n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of Gaussian quadrature."""
    return getattr(getattr(np.polynomial, kind), {"chebyshev": "chebgauss", "legendre": "leggauss", "hermite": "hermgauss", "hermite_e": "hermegauss", "laguerre": "laggauss"}[kind])(n)


def weight(x: ColumnOrValue, kind: str) -> Column:
    x = double(x)
    return {
        "chebyshev": 1 / F.sqrt(1 - x * x),
        "legendre": F.lit(1.0) + x * 0,
        "hermite": F.exp(-x * x),
        "hermite_e": F.exp(-x * x / 2),
        "laguerre": F.exp(-x),
    }[kind]


def chebpts1(n: int) -> list[float]:
    return np.polynomial.chebyshev.chebpts1(n).tolist()


def chebpts2(n: int) -> list[float]:
    return np.polynomial.chebyshev.chebpts2(n).tolist()


def chebinterpolate(f: Callable[[np.ndarray], np.ndarray], degree: int) -> list[float]:
    return np.polynomial.chebyshev.chebinterpolate(f, degree).tolist()


def to_power(a: Coefficients, kind: str) -> list[float]:
    """Coefficients of powers of x."""
    return _class(kind)(a).convert(kind=np.polynomial.Polynomial).coef.tolist()


def from_power(a: Coefficients, kind: str) -> list[float]:
    return np.polynomial.Polynomial(a).convert(kind=_class(kind), domain=_class(kind).window).coef.tolist()


def valfromroots(x: ColumnOrValue, r: Sequence[float]) -> Column:
    out = F.lit(1.0)
    for v in r:
        out = out * (double(x) - float(v))
    return out


def fit(df: DataFrame, x: str, y: str, degree: int, kind: str = "polynomial", weights: str | None = None) -> DataFrame:
    """(term, coefficient), lowest degree first: least squares over any number of rows in one aggregation."""
    from gridspan.operators.linalg import lstsq

    w = double(weights) if weights else F.lit(1.0)
    return lstsq(df, [p * w for p in basis(double(x), degree, kind)], double(y) * w)


# The classic functions: highest degree first


def polyval(c: Coefficients, x: ColumnOrValue) -> Column:
    return val(x, list(c)[::-1])


def polyfit(df: DataFrame, x: str, y: str, degree: int, weights: str | None = None) -> DataFrame:
    """(power, coefficient)."""
    return fit(df, x, y, degree, "polynomial", weights).withColumnRenamed("term", "power")


def polyadd(a: Coefficients, b: Coefficients) -> list[float]:
    return add(list(a)[::-1], list(b)[::-1])[::-1]


def polysub(a: Coefficients, b: Coefficients) -> list[float]:
    return sub(list(a)[::-1], list(b)[::-1])[::-1]


def polymul(a: Coefficients, b: Coefficients) -> list[float]:
    return np.convolve(a, b).tolist()


def polydiv(a: Coefficients, b: Coefficients) -> tuple[list[float], list[float]]:
    q, r = np.polydiv(a, b)
    return q.tolist(), r.tolist()


def polyder(a: Coefficients, m: int = 1) -> list[float]:
    return np.polyder(np.asarray(a, float), m).tolist()


def polyint(a: Coefficients, m: int = 1, k: float = 0.0) -> list[float]:
    return np.polyint(np.asarray(a, float), m, k).tolist()


def poly(r: Sequence[float]) -> list[float]:
    return np.poly(r).tolist()


class poly1d:  # noqa: N801
    """A polynomial by its coefficients; called with a column it is an expression."""

    def __init__(self, c: Coefficients, from_roots: bool = False):
        c = poly(c) if from_roots else [float(v) for v in c]
        while len(c) > 1 and c[0] == 0:
            c = c[1:]
        self.coeffs = list(c)

    @property
    def order(self) -> int:
        return len(self.coeffs) - 1

    @property
    def roots(self) -> list[complex]:
        return np.roots(self.coeffs).tolist()

    def __call__(self, x: ColumnOrValue) -> Column:
        return polyval(self.coeffs, x)

    def __add__(self, o: poly1d) -> poly1d:
        return poly1d(polyadd(self.coeffs, o.coeffs))

    def __sub__(self, o: poly1d) -> poly1d:
        return poly1d(polysub(self.coeffs, o.coeffs))

    def __mul__(self, o: poly1d) -> poly1d:
        return poly1d(polymul(self.coeffs, o.coeffs))

    def deriv(self, m: int = 1) -> poly1d:
        return poly1d(polyder(self.coeffs, m))

    def integ(self, m: int = 1, k: float = 0.0) -> poly1d:
        return poly1d(polyint(self.coeffs, m, k))
