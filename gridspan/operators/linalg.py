"""Linear algebra on coordinates: tiles for products, joins and grouped sums for other sums of products, trees for tall matrices, dense decompositions on stacks of small ones."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.array import GridArray, identity
from gridspan.operators import blocked, subspace, tall, tiles


def einsum(subscripts: str, *operands: GridArray) -> GridArray:
    """Operands meet on the letters they share; values are multiplied and summed over the letters that go.

    Each step joins one more operand and, as soon as no later operand and not
    the output has a letter, sums it away, so intermediate results stay small.
    """
    text = subscripts.replace(" ", "")
    inputs, _, output = text.partition("->")
    terms = inputs.split(",")
    if "..." in inputs:
        free = iter([c for c in string.ascii_uppercase if c not in text])
        wide = max(a.ndim - len(t.replace("...", "")) for t, a in zip(terms, operands, strict=True) if "..." in t)
        rest = "".join(next(free) for _ in range(wide))
        terms = [t.replace("...", rest[wide - (a.ndim - len(t.replace("...", ""))) :]) if "..." in t else t for t, a in zip(terms, operands, strict=True)]
        output = output.replace("...", rest) if "->" in text else rest + "".join(sorted(c for c in set("".join(terms)) - set(rest) if "".join(terms).count(c) == 1))
    elif "->" not in text:
        output = "".join(sorted(c for c in set("".join(terms)) if "".join(terms).count(c) == 1))
    sizes: dict[str, int] = {}
    frames = []
    for term, a in zip(terms, operands, strict=True):
        if len(term) != a.ndim:
            raise ValueError(f"{term} does not name {a.ndim} axes")
        df, names = a.df, []
        for k, c in enumerate(term):
            if sizes.setdefault(c, a.shape[k]) != a.shape[k]:
                raise ValueError(f"axis {c} has two sizes")
            if c in names:
                df = df.filter(F.col(f"i{k}") == F.col(f"i{term.index(c)}"))
            else:
                names.append(c)
        frames.append((names, df.select(*(F.col(f"i{term.index(c)}").alias(f"_{ord(c)}") for c in names), F.col("x").alias("_x"))))
    names, df = frames[0]
    for k, (more, right) in enumerate(frames[1:], 1):
        shared = [c for c in more if c in names]
        right = right.withColumnRenamed("_x", "_y")
        df = df.join(right, [f"_{ord(c)}" for c in shared]) if shared else df.crossJoin(right)
        names = [*names, *(c for c in more if c not in names)]
        df = df.withColumn("_x", F.col("_x") * F.col("_y")).drop("_y")
        later = set(output).union(*(n for n, _ in frames[k + 1 :]))
        if k + 1 < len(frames) and not set(names) <= later:
            names = [c for c in names if c in later]
            df = df.groupBy(*(f"_{ord(c)}" for c in names)).agg(F.sum("_x").alias("_x"))
    if set(names) != set(output):
        df = df.groupBy(*(f"_{ord(c)}" for c in output)).agg(F.sum("_x").alias("_x"))
    return GridArray(df.select(*(F.col(f"_{ord(c)}").alias(f"i{k}") for k, c in enumerate(output)), F.col("_x").alias("x")), [sizes[c] for c in output])


def einsum_path(subscripts: str, *operands: GridArray) -> list[str]:
    """The order of contraction: left to right, each letter summed as soon as it can be."""
    terms = subscripts.partition("->")[0].split(",")
    return [terms[0], *terms[1 : len(operands)]]


def matmul(a: GridArray, b: GridArray) -> GridArray:
    """Two matrices of floating point are multiplied by tiles; integers stay exact, and vectors and stacks meet cell by cell."""
    if a.ndim == b.ndim == 2 and {a.dtype, b.dtype} <= {"double", "float"}:
        if a.shape[1] != b.shape[0]:
            raise ValueError(f"shapes {a.shape} and {b.shape} don't fit")
        product = tiles.multiply(tiles.tiled(a.df, *a.shape), tiles.tiled(b.df, *b.shape))
        return GridArray(tiles.cells(product), (a.shape[0], b.shape[1]))
    left, right = ("n" if a.ndim == 1 else "mn"), ("n" if b.ndim == 1 else "nk")
    batch = string.ascii_uppercase[: max(a.ndim, b.ndim, 2) - 2]
    la, lb = batch[len(batch) - max(a.ndim - 2, 0) :], batch[len(batch) - max(b.ndim - 2, 0) :]
    out = batch + ("m" if a.ndim > 1 else "") + ("k" if b.ndim > 1 else "")
    return einsum(f"{la}{left},{lb}{right}->{out}", a, b)


def dot(a: GridArray, b: GridArray) -> GridArray:
    if not a.ndim or not b.ndim:
        return a * b
    if a.ndim <= 2 and b.ndim <= 2:
        return matmul(a, b)
    return tensordot(a, b, ([a.ndim - 1], [b.ndim - 2 if b.ndim > 1 else 0]))


def inner(a: GridArray, b: GridArray) -> GridArray:
    return tensordot(a, b, ([a.ndim - 1], [b.ndim - 1]))


def outer(a: GridArray, b: GridArray) -> GridArray:
    return einsum("a,b->ab", a.ravel(), b.ravel())


def vdot(a: GridArray, b: GridArray) -> GridArray:
    return einsum("a,a->", a.ravel(), b.ravel())


def tensordot(a: GridArray, b: GridArray, axes: int | tuple[Sequence[int], Sequence[int]] = 2) -> GridArray:
    pairs = (list(range(a.ndim - axes, a.ndim)), list(range(axes))) if isinstance(axes, int) else ([a._axis(k) for k in axes[0]], [b._axis(k) for k in axes[1]])
    if a.ndim == b.ndim == 2 and len(pairs[0]) == len(pairs[1]) == 1:
        return matmul(a if pairs[0][0] else a.T, b.T if pairs[1][0] else b)
    left, right = list(string.ascii_lowercase[: a.ndim]), list(string.ascii_uppercase[: b.ndim])
    for p, q in zip(*pairs, strict=True):
        right[q] = left[p]
    out = [c for k, c in enumerate(left) if k not in pairs[0]] + [c for k, c in enumerate(right) if k not in pairs[1]]
    return einsum(f"{''.join(left)},{''.join(right)}->{''.join(out)}", a, b)


def kron(a: GridArray, b: GridArray) -> GridArray:
    n = max(a.ndim, b.ndim)
    a, b = (x.reshape(*[1] * (n - x.ndim), *x.shape) for x in (a, b))
    left, right = string.ascii_lowercase[:n], string.ascii_uppercase[:n]
    both = einsum(f"{left},{right}->{''.join(x + y for x, y in zip(left, right, strict=True))}", a, b)
    return both.reshape(*(p * q for p, q in zip(a.shape, b.shape, strict=True)))


def cross(a: GridArray, b: GridArray) -> GridArray:
    """Of the last axis, of size 3."""
    k = a.ndim - 1
    near = lambda x, s: x.roll(-s, k)
    return near(a, 1) * near(b, 2) - near(a, 2) * near(b, 1)


def multi_dot(arrays: Sequence[GridArray]) -> GridArray:
    """In the order of the least multiplications."""
    n = len(arrays)
    size = [arrays[0].shape[0] if arrays[0].ndim > 1 else 1, *(a.shape[-1] if a.ndim > 1 else a.shape[0] for a in arrays)]
    if arrays[-1].ndim == 1:
        size[-2:] = [arrays[-1].shape[0], 1]
    cost, cut = [[0] * n for _ in range(n)], [[0] * n for _ in range(n)]
    for length in range(1, n):
        for i in range(n - length):
            j = i + length
            cost[i][j], cut[i][j] = min((cost[i][k] + cost[k + 1][j] + size[i] * size[k + 1] * size[j + 1], k) for k in range(i, j))

    def go(i: int, j: int) -> GridArray:
        return arrays[i] if i == j else matmul(go(i, cut[i][j]), go(cut[i][j] + 1, j))

    return go(0, n - 1)


def matrix_power(a: GridArray, n: int) -> GridArray:
    if n < 0:
        return matrix_power(inv(a), -n)
    if n == 0:
        return identity(a.df.sparkSession, a.shape[0])
    half = matrix_power(a, n // 2) if n > 1 else None
    return a if half is None else matmul(matmul(half, half), a) if n % 2 else matmul(half, half)


def norm(a: GridArray, ord: float | str | None = None, axis: int | Sequence[int] | None = None) -> GridArray:  # noqa: A002
    """Vector norms along an axis, matrix norms (fro, 1, -1, inf, -inf, 2, -2, nuc) of a matrix."""
    inf = float("inf")
    if axis is None and a.ndim == 2 and ord not in (None, "fro"):
        if ord in (2, -2, "nuc"):
            s = svdvals(a)
            return {2: s.max, -2: s.min, "nuc": s.sum}[ord]()
        sums = abs(a).sum(0 if abs(ord) == 1 else 1)
        return sums.max() if ord > 0 else sums.min()
    if ord in (None, 2, "fro"):
        return a.apply(lambda x: x * x).sum(axis).apply(F.sqrt)
    if ord == inf:
        return abs(a).max(axis)
    if ord == -inf:
        return abs(a).min(axis)
    if ord == 0:
        return a.count_nonzero(axis)
    return abs(a).apply(lambda x: F.pow(x, float(ord))).sum(axis).apply(lambda x: F.pow(x, 1.0 / ord))


vector_norm = matrix_norm = norm


def dense(a: GridArray, f: Callable[..., np.ndarray], shape: Sequence[int], *others: GridArray) -> GridArray:
    """f on each matrix of a stack (last two axes), a stack's matrices in parallel; one matrix fits one task.

    f gets numpy matrices and returns the cells of `shape` for each.
    """
    parts, batch = [a, *others], a.ndim - 2
    keys = [f"i{k}" for k in range(batch)]
    df = None
    for n, p in enumerate(parts):
        wide = p if p.ndim >= batch + 1 or not batch else p.broadcast_to([*a.shape[:batch], *p.shape])
        inner = wide.ndim - batch
        cells = wide.df.select(*keys, F.lit(n).alias("_n"), F.col(f"i{batch}").alias("_r") if inner else F.lit(0).alias("_r"), (F.col(f"i{batch + 1}") if inner > 1 else F.lit(0)).cast("long").alias("_c"), F.col("x").cast("double").alias("x"))
        df = cells if df is None else df.unionByName(cells)
    sizes = [p.shape[-2:] if p.ndim - (batch if p.ndim > batch else 0) > 1 or n == 0 else (p.shape[-1], 1) for n, p in enumerate(parts)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        given = []
        for n, size in enumerate(sizes):
            m = np.zeros(size)
            mine = pdf[pdf["_n"] == n]
            m[mine["_r"].to_numpy(), mine["_c"].to_numpy()] = mine["x"].to_numpy(float)
            given.append(m)
        found = np.asarray(f(*given), float).reshape(shape)
        at = np.indices(found.shape).reshape(found.ndim, -1) if found.ndim else np.zeros((0, 1), int)
        out = {k: np.full(found.size, pdf[k].iloc[0]) for k in keys}
        out |= {f"j{k}": at[k] for k in range(found.ndim)}
        return pd.DataFrame(out | {"x": found.ravel()})

    schema = ", ".join([*(f"{k} long" for k in keys), *(f"j{k} long" for k in range(len(shape))), "x double"])
    found = df.groupBy(*keys).applyInPandas(run, schema) if keys else df.groupBy(F.lit(0).alias("_g")).applyInPandas(run, schema)
    whole = [*a.shape[:batch], *shape]
    return GridArray(found.toDF(*(f"i{k}" for k in range(len(whole))), "x"), whole)


def _n(a: GridArray) -> tuple[int, int]:
    return a.shape[-2], a.shape[-1]


def _is_tall(a: GridArray) -> bool:
    return a.ndim == 2 and a.shape[0] > a.shape[1] > 0


def _triangle(a: GridArray) -> GridArray:
    n = a.shape[1]
    return GridArray(tall.triangle(a.df, a.shape[0], n), (n, n))


def _is_large(a: GridArray) -> bool:
    """A square matrix of more than one tile."""
    return a.ndim == 2 and a.shape[0] == a.shape[1] > tiles.SIDE


def inv(a):
    """Of a matrix of more than one tile by elimination, panel by panel, at once."""
    if _is_large(a):
        return GridArray(blocked.solved(a.df.sparkSession, a.df, a.shape[0], None, a.shape[0]), a.shape)
    return dense(a, np.linalg.inv, _n(a))


def pinv(a, rcond: float = 1e-15):
    """Of a tall matrix: that of R, which has the same singular values, times the transpose of Q."""
    if _is_tall(a):
        q, r = qr(a)
        return matmul(pinv(r, rcond), q.T)
    return dense(a, lambda m: np.linalg.pinv(m, rcond), _n(a)[::-1])


def det(a):
    if _is_large(a):
        sign, log = blocked.log_determinant(a.df.sparkSession, a.df, a.shape[0])
        return GridArray(a.df.sparkSession.createDataFrame([(float(sign * np.exp(log)),)], "x double"), ())
    return dense(a, np.linalg.det, ())


def slogdet(a) -> GridArray:
    """A last axis of two: sign and logarithm."""
    if _is_large(a):
        found = blocked.log_determinant(a.df.sparkSession, a.df, a.shape[0])
        return GridArray(a.df.sparkSession.createDataFrame(list(enumerate(found)), "i0 long, x double"), (2,))
    return dense(a, lambda m: np.array([float(v) for v in np.linalg.slogdet(m)]), (2,))


def matrix_rank(a, tol: float | None = None):
    rows, columns = _n(a)
    rank = lambda m: (s := np.linalg.svd(m, compute_uv=False), np.float64((s > (s.max() * max(rows, columns) * np.finfo(float).eps if tol is None else tol)).sum()))[1]
    return dense(_triangle(a) if _is_tall(a) else a, rank, ())


def cond(a, p=None):
    return dense(a, lambda m: np.linalg.cond(m, p), ())


def solve(a: GridArray, b: GridArray) -> GridArray:
    """Of a matrix of more than one tile by elimination, panel by panel, at once."""
    vector = b.ndim == a.ndim - 1
    if _is_large(a):
        right = b.df.withColumn("i1", F.lit(0).cast("long")) if vector else b.df
        found = blocked.solved(a.df.sparkSession, a.df, a.shape[0], right, 1 if vector else b.shape[1])
        return GridArray(found.drop("i1") if vector else found, b.shape)
    return dense(a, lambda m, r: np.linalg.solve(m, r)[:, 0] if vector else np.linalg.solve(m, r), (a.shape[-1],) if vector else (a.shape[-1], b.shape[-1]), b)


def lstsq_small(a: GridArray, b: GridArray) -> GridArray:
    """Least squares of a matrix of any rank, the shortest where there are many.

    Of a tall matrix from the triangle of a and b side by side, which is all that one task gets.
    """
    vector = b.ndim == 1
    if _is_tall(a):
        n, wide = a.shape[1], 1 if vector else b.shape[1]
        beside = b.df.select("i0", (F.lit(n).cast("long") if vector else F.col("i1") + n).alias("i1"), "x")
        both = a.df.select(F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), F.col("x").cast("double").alias("x")).unionByName(beside.withColumn("x", F.col("x").cast("double")))
        r = _triangle(GridArray(both, (a.shape[0], n + wide)))
        eps = a.shape[0] * np.finfo(float).eps
        return dense(r, lambda m: np.linalg.lstsq(m[:, :n], m[:, n:], rcond=eps)[0][:, 0] if vector else np.linalg.lstsq(m[:, :n], m[:, n:], rcond=eps)[0], (n,) if vector else (n, wide))
    return dense(a, lambda m, r: np.linalg.lstsq(m, r, rcond=None)[0][:, 0] if vector else np.linalg.lstsq(m, r, rcond=None)[0], (a.shape[-1],) if vector else (a.shape[-1], b.shape[-1]), b)


def lstsq(df: DataFrame, features: Sequence[str | Column], target: str | Column) -> DataFrame:
    """(term, coefficient): least squares over any number of rows, from the moments of one aggregation.

    Only the square of the number of features comes together; features of full rank.
    """
    x = [F.col(c) if isinstance(c, str) else c for c in features]
    y = F.col(target) if isinstance(target, str) else target
    pairs = {f"m{i}_{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    moments = df.agg(*(v.cast("double").alias(k) for k, v in pairs.items()), *(F.sum(x[i] * y).cast("double").alias(f"v{i}") for i in range(len(x))))
    n = len(x)

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                found = np.linalg.solve(m, np.array([r[f"v{i}"] for i in range(n)]))
                yield pd.DataFrame({"term": np.arange(n), "coefficient": found})

    return moments.mapInPandas(run, "term long, coefficient double")


def svdvals(a):
    return dense(_triangle(a) if _is_tall(a) else a, lambda m: np.linalg.svd(m, compute_uv=False), (min(_n(a)),))


def svd(a: GridArray, full_matrices: bool = True) -> tuple[GridArray, GridArray, GridArray]:
    """Of a tall matrix, unless full: those of R, the left vectors times Q."""
    m, n = _n(a)
    k = min(m, n)
    if _is_tall(a) and not full_matrices:
        q, r = qr(a)
        u, s, vt = svd(r)
        return matmul(q, u), s, vt
    part = lambda j: lambda x: np.linalg.svd(x, full_matrices=full_matrices)[j]
    return dense(a, part(0), (m, m if full_matrices else k)), dense(a, part(1), (k,)), dense(a, part(2), (n if full_matrices else k, n))


def qr(a: GridArray) -> tuple[GridArray, GridArray]:
    """Of a tall matrix by a tree of strips, with no negative diagonal."""
    m, n = _n(a)
    k = min(m, n)
    if _is_tall(a):
        return GridArray(tall.orthogonal(a.df, m, n), (m, n)), _triangle(a)
    return dense(a, lambda x: np.linalg.qr(x)[0], (m, k)), dense(a, lambda x: np.linalg.qr(x)[1], (k, n))


def cholesky(a):
    """Of a matrix of more than one tile panel by panel, at once."""
    if _is_large(a):
        return GridArray(blocked.lower(a.df.sparkSession, a.df, a.shape[0]), a.shape)
    return dense(a, np.linalg.cholesky, _n(a))


def eigvalsh(a):
    return dense(a, np.linalg.eigvalsh, (a.shape[-1],))


def eigh(a: GridArray) -> tuple[GridArray, GridArray]:
    return eigvalsh(a), dense(a, lambda m: np.linalg.eigh(m)[1], _n(a))


def eigh_leading(a: GridArray | Sequence[GridArray], k: int, tol: float = 1e-9) -> tuple[GridArray, GridArray]:
    """The k eigenvalues of largest size, falling in size, and their vectors, of a symmetric matrix of any size: block subspace iteration, at once.

    Factors in place of `a` stand for their product, which is not formed.
    """
    return subspace.leading(a, k, tol)


def eigvals(a: GridArray) -> GridArray:
    """A last axis of two: real and imaginary parts, in numpy's order."""
    return dense(a, lambda m: np.stack([np.linalg.eigvals(m).real, np.linalg.eigvals(m).imag], axis=1), (a.shape[-1], 2))


def eig(a: GridArray) -> tuple[GridArray, GridArray]:
    """Values as eigvals; vectors with a last axis of real and imaginary parts."""
    return eigvals(a), dense(a, lambda m: np.stack([np.linalg.eig(m)[1].real, np.linalg.eig(m)[1].imag], axis=2), (*_n(a), 2))


def tensorinv(a: GridArray, ind: int = 2) -> GridArray:
    rows = int(np.prod(a.shape[:ind]))
    return inv(a.reshape(rows, -1)).reshape(*a.shape[ind:], *a.shape[:ind])


def tensorsolve(a: GridArray, b: GridArray) -> GridArray:
    n = b.size
    return solve(a.reshape(n, -1), b.ravel()).reshape(*a.shape[b.ndim :])
