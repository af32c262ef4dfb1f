"""Shapes, creation, joining, index builders, transforms, polynomials, samplers, sources and special functions, each with its SQL.

Special functions are held against their series, transforms against sums of
products with cosines and sines, samplers against the moments of their law.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspan import api as gs
from gridspan import array as G
from gridspan.array import GridArray
from gridspan.functions import elementwise as E
from gridspan.functions import polynomials as P
from gridspan.functions import types as T
from gridspan.functions.random import default_rng
from gridspan.layout import ranked
from gridspan.operators import binning as B
from gridspan.operators import linalg as L
from gridspan.operators import spectral as FT
from gridspan.operators import ufunc as UF
from gridspan.plans.arrays import _EMB, _SERIES, SAMPLERS, _embedding, _out, _px, _px_sql, _series, grid, grid_sql
from gridspan.session import scratch, table
from gridspan.sources import npy, text

_GR = f"WITH g AS ({grid_sql()})"
_SR = f"WITH t AS ({_SERIES})"
_R4 = "round({}, 4) + 0.0 AS x"


def _overlapping_sums(a):
    """A segment for each cell, its bounds neither rising nor falling."""
    return UF.UFUNCS["add"].reduceat(a, GridArray(a.df.withColumn("x", F.col("i0") * 7919 % a.shape[0]), a.shape))


def _rising_maxima(a):
    """Segments of 1, 2, 3 and so on cells, the last as long as the series lets it be."""
    count = math.isqrt(8 * a.shape[0]) // 2 + 1
    while count * (count - 1) // 2 >= a.shape[0]:
        count -= 1
    bounds = a.df.filter(F.col("i0") < count).withColumn("x", F.expr("i0 * (i0 + 1) div 2"))
    return UF.UFUNCS["maximum"].reduceat(a, GridArray(bounds, [count]))


#: Of the series as rows of 100.
GRID = {
    "flipud": (lambda g: gs.flipud(g), f"{_GR} SELECT (SELECT max(i) FROM g) - i AS i0, j AS i1, round(x, 4) AS x FROM g"),
    "fliplr": (lambda g: gs.fliplr(g), f"{_GR} SELECT i AS i0, 99 - j AS i1, round(x, 4) AS x FROM g"),
    "ravel": (lambda g: gs.ravel(g), f"{_GR} SELECT i * 100 + j AS i0, round(x, 4) AS x FROM g"),
    "flatten": (lambda g: gs.flatten(g), f"{_GR} SELECT i * 100 + j AS i0, round(x, 4) AS x FROM g"),
    "squeeze": (lambda g: gs.squeeze(g.expand_dims(1)), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g"),
    "expand_dims": (lambda g: gs.expand_dims(g, 1), f"{_GR} SELECT i AS i0, 0::BIGINT AS i1, j AS i2, round(x, 4) AS x FROM g"),
    "atleast_1d": (lambda g: G.atleast_1d(g), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g"),
    "atleast_2d": (lambda g: G.atleast_2d(g), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g"),
    "atleast_3d": (lambda g: G.atleast_3d(g), f"{_GR} SELECT i AS i0, j AS i1, 0::BIGINT AS i2, round(x, 4) AS x FROM g"),
    "moveaxis": (lambda g: gs.moveaxis(g.expand_dims(0), 0, 2), f"{_GR} SELECT i AS i0, j AS i1, 0::BIGINT AS i2, round(x, 4) AS x FROM g"),
    "rollaxis": (lambda g: gs.rollaxis(g, 1), f"{_GR} SELECT j AS i0, i AS i1, round(x, 4) AS x FROM g"),
    "swapaxes": (lambda g: gs.swapaxes(g, 0, 1), f"{_GR} SELECT j AS i0, i AS i1, round(x, 4) AS x FROM g"),
    "matrix_transpose": (lambda g: gs.matrix_transpose(g), f"{_GR} SELECT j AS i0, i AS i1, round(x, 4) AS x FROM g"),
    "vstack": (lambda g: G.vstack([g, g]), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g UNION ALL SELECT i + (SELECT max(i) + 1 FROM g), j, round(x, 4) FROM g"),
    "row_stack": (lambda g: gs.row_stack([g, g]), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g UNION ALL SELECT i + (SELECT max(i) + 1 FROM g), j, round(x, 4) FROM g"),
    "hstack": (lambda g: G.hstack([g, g]), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g UNION ALL SELECT i, j + 100, round(x, 4) FROM g"),
    "column_stack": (lambda g: G.column_stack([g, g]), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g UNION ALL SELECT i, j + 100, round(x, 4) FROM g"),
    "dstack": (lambda g: G.dstack([g, g]), f"{_GR} SELECT i AS i0, j AS i1, r::BIGINT AS i2, round(x, 4) AS x FROM g, (VALUES (0), (1)) v(r)"),
    "vsplit": (lambda g: G.vsplit(g, [5])[1], f"{_GR} SELECT i - 5 AS i0, j AS i1, round(x, 4) AS x FROM g WHERE i >= 5"),
    "hsplit": (lambda g: G.hsplit(g, 4)[2], f"{_GR} SELECT i AS i0, j - 50 AS i1, round(x, 4) AS x FROM g WHERE j BETWEEN 50 AND 74"),
    "dsplit": (lambda g: G.dsplit(G.dstack([g, g]), 2)[1], f"{_GR} SELECT i AS i0, j AS i1, 0::BIGINT AS i2, round(x, 4) AS x FROM g"),
    "unstack": (lambda g: G.unstack(g, 1)[3], f"{_GR} SELECT i AS i0, round(x, 4) AS x FROM g WHERE j = 3"),
    "block": (lambda g: G.block([[g, g], [g, g]]), f"{_GR} SELECT i + p * (SELECT max(i) + 1 FROM g) AS i0, j + 100 * q AS i1, round(x, 4) AS x FROM g, (VALUES (0), (1)) a(p), (VALUES (0), (1)) b(q)"),
    "concatenate": (lambda g: G.concatenate([g, g], 1), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g UNION ALL SELECT i, j + 100, round(x, 4) FROM g"),
    "apply_over_axes": (lambda g: UF.apply_over_axes(lambda a, axis: a.sum(axis, keepdims=True), g, [0]), f"{_GR} SELECT 0::BIGINT AS i0, j AS i1, round(sum(x), 4) AS x FROM g GROUP BY j"),
    "broadcast_to": (lambda g: g.mean(0).broadcast_to([3, 100]), f"{_GR} SELECT k::BIGINT AS i0, j AS i1, round(avg(x), 4) AS x FROM g, unnest(range(3)) v(k) GROUP BY 1, 2"),
    "broadcast_arrays": (lambda g: gs.broadcast_arrays(g, g.mean(0))[1], f"{_GR} SELECT i AS i0, j AS i1, round(avg(x) OVER (PARTITION BY j), 4) AS x FROM g"),
    "pad": (lambda g: g.pad(1, 2, 1, "constant", 7.0), f"{_GR} SELECT i AS i0, j + 1 AS i1, round(x, 4) AS x FROM g UNION ALL SELECT DISTINCT i, k, 7.0 FROM g, (VALUES (0), (101), (102)) v(k)"),
    "take_along_axis": (lambda g: g.take_along_axis(g.argsort(1), 1), f"{_GR} SELECT i AS i0, row_number() OVER (PARTITION BY i ORDER BY x, j) - 1 AS i1, round(x, 4) AS x FROM g"),
    "put_along_axis": (lambda g: gs.put_along_axis(g, g.argmax(1).expand_dims(1), -1.0, 1), f"{_GR}, m AS (SELECT i, arg_max(j, x) AS top FROM g GROUP BY 1) SELECT i AS i0, j AS i1, CASE WHEN j = top THEN -1.0 ELSE round(x, 4) END AS x FROM g JOIN m USING (i)"),
    "argpartition": (
        lambda g: g.argpartition(40),
        f"{_GR}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x) - 1 AS r FROM g), v AS (SELECT *, max(CASE WHEN r = 40 THEN x END) OVER (PARTITION BY i) AS v FROM r) "
        "SELECT i AS i0, row_number() OVER (PARTITION BY i ORDER BY x >= v, x > v, j) - 1 AS i1, j::DOUBLE AS x FROM v",
    ),
    "fill_diagonal": (lambda g: gs.fill_diagonal(g, 5.0), f"{_GR} SELECT i AS i0, j AS i1, CASE WHEN i = j THEN 5.0 ELSE round(x, 4) END AS x FROM g"),
    "diag": (lambda g: G.diag(g, 1), f"{_GR} SELECT i AS i0, round(x, 4) AS x FROM g WHERE j = i + 1"),
    "nonzero": (lambda g: gs.nonzero(g > 4e5), f"{_GR} SELECT row_number() OVER (ORDER BY i, j) - 1 AS place, i AS i0, j AS i1 FROM g WHERE x > 4e5"),
    "argwhere": (lambda g: gs.argwhere(g > 4e5), f"{_GR} SELECT row_number() OVER (ORDER BY i, j) - 1 AS place, i AS i0, j AS i1 FROM g WHERE x > 4e5"),
    "ix_": (lambda g: gs.take(gs.take(g, G.arange(g.df.sparkSession, 0, 4), 0), G.arange(g.df.sparkSession, 0, 100, 25), 1), f"{_GR} SELECT i AS i0, j // 25 AS i1, round(x, 4) AS x FROM g WHERE i < 4 AND j % 25 = 0"),
    "fancy_index": (lambda g: gs.fancy_get(g, G.arange(g.df.sparkSession, 0, g.shape[0]), G.arange(g.df.sparkSession, 0, g.shape[0]).apply(lambda k: k % 100)), f"{_GR} SELECT i AS i0, round(x, 4) AS x FROM g WHERE j = i % 100"),
    "copyto": (lambda g: gs.copyto(g, 0.0, g > 4e5), f"{_GR} SELECT i AS i0, j AS i1, CASE WHEN x > 4e5 THEN 0 ELSE round(x, 4) END AS x FROM g"),
    "trapz": (lambda g: gs.trapz(g, axis=1), f"{_GR} SELECT i AS i0, round(sum(CASE WHEN j IN (0, 99) THEN x / 2 ELSE x END), 4) AS x FROM g GROUP BY 1"),
    "tril_indices_from": (lambda g: gs.tril_indices_from(g[:100])[1], "SELECT row_number() OVER (ORDER BY i, j) - 1 AS i0, j::DOUBLE AS x FROM (SELECT count(*) AS n FROM orders), unnest(range(least(100, (n + 99) // 100))) a(i), unnest(range(100)) b(j) WHERE j <= i"),
    "ndenumerate": (lambda g: gs.ndenumerate(g).withColumn("x", F.round("x", 4)), f"{_GR} SELECT i AS i0, j AS i1, round(x, 4) AS x FROM g"),
}

#: Of the series itself.
SERIES = {
    "resize": (lambda a: gs.resize(a, a.size + 7), f"{_SR} SELECT i0, round(x, 4) AS x FROM t UNION ALL SELECT i0 + n, round(x, 4) FROM t WHERE i0 < 7"),
    "trim_zeros": (lambda a: gs.trim_zeros(a.apply(lambda x: F.when(x > 3e5, x).otherwise(0.0))), f"{_SR}, b AS (SELECT min(i0) AS lo, max(i0) AS hi FROM t WHERE x > 3e5) SELECT i0 - lo AS i0, CASE WHEN x > 3e5 THEN round(x, 4) ELSE 0 END AS x FROM t, b WHERE i0 BETWEEN lo AND hi"),
    "ediff1d": (lambda a: gs.ediff1d(a, [1.0], [2.0]), f"{_SR}, d AS (SELECT i0, n, lead(x) OVER (ORDER BY i0) - x AS d FROM t) SELECT i0 + 1 AS i0, {_R4.format('d')} FROM d WHERE i0 < n - 1 UNION ALL SELECT 0, 1.0 UNION ALL SELECT n, 2.0 FROM t WHERE i0 = 0"),
    "compress": (lambda a: gs.compress(a, a > 2e5), f"{_SR} SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, round(x, 4) AS x FROM t WHERE x > 2e5"),
    "extract": (lambda a: gs.extract(a, a < 1e5), f"{_SR} SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, round(x, 4) AS x FROM t WHERE x < 1e5"),
    "place": (lambda a: gs.place(a, a > 2e5, a[:7]), f"{_SR}, m AS (SELECT i0, row_number() OVER (ORDER BY i0) - 1 AS k FROM t WHERE x > 2e5) SELECT t.i0, round(CASE WHEN m.k IS NULL THEN t.x ELSE v.x END, 4) AS x FROM t LEFT JOIN m ON m.i0 = t.i0 LEFT JOIN t v ON v.i0 = m.k % 7"),
    "nancumprod": (lambda a: gs.nancumprod(a.apply(lambda x: F.when(x > 4e5, float("nan")).otherwise(1 + x / 1e10))), f"{_SR} SELECT i0, round(exp(sum(CASE WHEN x > 4e5 THEN 0 ELSE ln(1 + x / 1e10) END) OVER (ORDER BY i0)), 4) AS x FROM t"),
    "cumulative_sum": (lambda a: gs.cumulative_sum(a), f"{_SR} SELECT i0, round(sum(x) OVER (ORDER BY i0), 4) AS x FROM t"),
    "cumulative_prod": (lambda a: gs.cumulative_prod(a.apply(lambda x: 1 + x / 1e10)), f"{_SR} SELECT i0, round(exp(sum(ln(1 + x / 1e10)) OVER (ORDER BY i0)), 4) AS x FROM t"),
    "amax": (lambda a: gs.amax(a), f"{_SR} SELECT round(max(x), 4) AS x FROM t"),
    "amin": (lambda a: gs.amin(a), f"{_SR} SELECT round(min(x), 4) AS x FROM t"),
    "product": (lambda a: gs.product(a.apply(lambda x: 1 + x / 1e10)), f"{_SR} SELECT round(exp(sum(ln(1 + x / 1e10))), 4) AS x FROM t"),
    "alltrue": (lambda a: gs.alltrue(a > 0), f"{_SR} SELECT bool_and(x > 0) AS x FROM t"),
    "sometrue": (lambda a: gs.sometrue(a > 4e5), f"{_SR} SELECT bool_or(x > 4e5) AS x FROM t"),
    "sort_descending": (lambda a: a.sort(descending=True), f"{_SR} SELECT row_number() OVER (ORDER BY x DESC, i0) - 1 AS i0, round(x, 4) AS x FROM t"),
    "argsort_descending": (lambda a: a.argsort(descending=True), f"{_SR} SELECT row_number() OVER (ORDER BY x DESC, i0) - 1 AS i0, i0::DOUBLE AS x FROM t"),
    "unwrap": (lambda a: gs.unwrap(a.apply(lambda x: F.pmod(x / 1e5, F.lit(2 * math.pi)))), f"{_SR}, p AS (SELECT i0, (x / 1e5) - 2 * pi() * floor((x / 1e5) / (2 * pi())) AS p FROM t), d AS (SELECT i0, p, coalesce(p - lag(p) OVER (ORDER BY i0), 0) AS d FROM p), c AS (SELECT i0, p, CASE WHEN abs(d) < pi() THEN 0 ELSE (d + pi()) - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() - d END AS c FROM d) SELECT i0, {_R4.format('p + sum(c) OVER (ORDER BY i0)')} FROM c"),
    "copy": (lambda a: gs.copy(a), f"{_SR} SELECT i0, round(x, 4) AS x FROM t"),
    "asarray": (lambda a: gs.asarray(a), f"{_SR} SELECT i0, round(x, 4) AS x FROM t"),
    "require": (lambda a: gs.require(a), f"{_SR} SELECT i0, round(x, 4) AS x FROM t"),
    "asarray_chkfinite": (lambda a: gs.asarray_chkfinite(a), f"{_SR} SELECT i0, round(x, 4) AS x FROM t"),
    "zeros_like": (lambda a: G.zeros_like(a), f"{_SR} SELECT i0, 0.0::DOUBLE AS x FROM t"),
    "ones_like": (lambda a: G.ones_like(a), f"{_SR} SELECT i0, 1.0::DOUBLE AS x FROM t"),
    "empty_like": (lambda a: G.empty_like(a).apply(lambda x: x * 0), f"{_SR} SELECT i0, 0.0::DOUBLE AS x FROM t"),
    "full_like": (lambda a: G.full_like(a, 2.5), f"{_SR} SELECT i0, 2.5::DOUBLE AS x FROM t"),
    "ufunc_call": (lambda a: UF.UFUNCS["add"](a, a), f"{_SR} SELECT i0, round(x + x, 4) AS x FROM t"),
    "ufunc_reduce": (lambda a: UF.UFUNCS["add"].reduce(grid(a), 1), f"SELECT i AS i0, round(sum(x), 4) AS x FROM ({grid_sql()}) GROUP BY 1"),
    "ufunc_accumulate": (lambda a: UF.UFUNCS["maximum"].accumulate(a), f"{_SR} SELECT i0, round(max(x) OVER (ORDER BY i0), 4) AS x FROM t"),
    "reduceat_of_table": (_overlapping_sums, f"{_SR}, m AS (SELECT count(*) AS m FROM t), c AS (SELECT i0, sum(x) OVER (ORDER BY i0) AS c FROM t), s AS (SELECT i0 AS k, i0 * 7919 % m AS a, coalesce(lead(i0 * 7919 % m) OVER (ORDER BY i0), m) AS b FROM t, m) SELECT k AS i0, round(high.c - coalesce(low.c, 0), 4) AS x FROM s JOIN c high ON high.i0 = CASE WHEN b > a THEN b - 1 ELSE a END LEFT JOIN c low ON low.i0 = a - 1"),
    "reduceat_max_of_table": (_rising_maxima, f"{_SR}, p AS (SELECT x, CAST(floor((sqrt(8 * i0 + 1) - 1) / 2) AS BIGINT) AS k FROM t) SELECT k AS i0, round(max(x), 4) AS x FROM p GROUP BY 1"),
    "ufunc_reduceat": (lambda a: UF.UFUNCS["add"].reduceat(a, [0, 10, 500]), f"{_SR} SELECT CASE WHEN i0 < 10 THEN 0 WHEN i0 < 500 THEN 1 ELSE 2 END::BIGINT AS i0, round(sum(x), 4) AS x FROM t GROUP BY 1"),
    "ufunc_at": (lambda a: UF.UFUNCS["add"].at(a, G.arange(a.df.sparkSession, 0, a.size).apply(lambda k: F.floor(k / 2)), G.full(a.df.sparkSession, a.size, 1.0)), f"{_SR} SELECT i0, round(x + CASE WHEN 2 * i0 + 1 < n THEN 2 WHEN 2 * i0 < n THEN 1 ELSE 0 END, 4) AS x FROM t"),
    "frompyfunc": (lambda a: a.apply(lambda x: UF.frompyfunc(lambda v: v * 2 + 1, "double")(x)), f"{_SR} SELECT i0, round(x * 2 + 1, 4) AS x FROM t"),
}

_IJ = "CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1"
_23 = "unnest(range(2)) a(i), unnest(range(3)) b(j)"
#: Made from nothing.
MADE = {
    "zeros": (lambda s: G.zeros(s, [2, 3]), f"SELECT {_IJ}, 0.0::DOUBLE AS x FROM {_23}"),
    "ones": (lambda s: G.ones(s, [2, 3]), f"SELECT {_IJ}, 1.0::DOUBLE AS x FROM {_23}"),
    "empty": (lambda s: G.empty(s, [2, 3]).apply(lambda x: x * 0), f"SELECT {_IJ}, 0.0::DOUBLE AS x FROM {_23}"),
    "full": (lambda s: G.full(s, [2, 3], 7.5), f"SELECT {_IJ}, 7.5::DOUBLE AS x FROM {_23}"),
    "identity": (lambda s: G.identity(s, 3), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM unnest(range(3)) a(i), unnest(range(3)) b(j)"),
    "array": (lambda s: G.array(s, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), f"SELECT {_IJ}, (3 * i + j + 1)::DOUBLE AS x FROM {_23}"),
    "fromfunction": (lambda s: G.fromfunction(s, lambda i, j: i * 10 + j, [2, 3]), f"SELECT {_IJ}, (10 * i + j)::DOUBLE AS x FROM {_23}"),
    "geomspace": (lambda s: G.geomspace(s, 1.0, 256.0, 9), "SELECT CAST(k AS BIGINT) AS i0, round(pow(2.0, k), 4) AS x FROM unnest(range(9)) u(k)"),
    "indices": (lambda s: G.indices(s, [2, 3])[0], f"SELECT {_IJ}, i::DOUBLE AS x FROM {_23}"),
    "meshgrid": (lambda s: G.meshgrid(G.arange(s, 3), G.arange(s, 2))[0], f"SELECT {_IJ}, j::DOUBLE AS x FROM {_23}"),
    "mgrid": (lambda s: gs.mgrid(s)[0:2, 0:3][1], f"SELECT {_IJ}, j::DOUBLE AS x FROM {_23}"),
    "ogrid": (lambda s: gs.ogrid(s)[0:2, 0:3][1], "SELECT 0::BIGINT AS i0, CAST(j AS BIGINT) AS i1, j::DOUBLE AS x FROM unnest(range(3)) b(j)"),
    "diag_indices": (lambda s: gs.diag_indices(s, 5)[1], "SELECT CAST(k AS BIGINT) AS i0, k::DOUBLE AS x FROM unnest(range(5)) u(k)"),
    "tril_indices": (lambda s: gs.tril_indices(s, 4)[0], "SELECT row_number() OVER (ORDER BY i, j) - 1 AS i0, i::DOUBLE AS x FROM unnest(range(4)) a(i), unnest(range(4)) b(j) WHERE j <= i"),
    "triu_indices": (lambda s: gs.triu_indices(s, 4, 1)[1], "SELECT row_number() OVER (ORDER BY i, j) - 1 AS i0, j::DOUBLE AS x FROM unnest(range(4)) a(i), unnest(range(4)) b(j) WHERE j > i"),
    "mask_indices": (lambda s: gs.mask_indices(G.ones(s, [4, 4]).triu())[0], "SELECT row_number() OVER (ORDER BY i, j) - 1 AS i0, i::DOUBLE AS x FROM unnest(range(4)) a(i), unnest(range(4)) b(j) WHERE j >= i"),
    "diagflat": (lambda s: G.diagflat(G.arange(s, 1, 4)), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CASE WHEN i = j THEN i + 1 ELSE 0 END::DOUBLE AS x FROM unnest(range(3)) a(i), unnest(range(3)) b(j)"),
    "rfftfreq": (lambda s: FT.rfftfreq(s, 9), "SELECT CAST(k AS BIGINT) AS i0, round(k / 9.0, 4) AS x FROM unnest(range(5)) u(k)"),
    "repmat": (lambda s: gs.repmat(G.arange(s, 3), 2, 2), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, (j % 3)::DOUBLE AS x FROM unnest(range(2)) a(i), unnest(range(6)) b(j)"),
    "kaiser": (lambda s: FT.kaiser(s, 32, 8.6), "WITH i AS (SELECT k, 8.6 * sqrt(greatest(1 - pow((k - 15.5) / 15.5, 2), 0)) AS a FROM unnest(range(32)) u(k)) SELECT CAST(k AS BIGINT) AS i0, round(list_sum([pow(a / 2, 2 * m) / pow(gamma(m + 1), 2) FOR m IN range(60)]) / list_sum([pow(4.3, 2 * m) / pow(gamma(m + 1), 2) FOR m IN range(60)]), 4) AS x FROM i"),
}

_ANGLE = "2 * pi() * j * k / 64"
_DFT = f"WITH e AS ({_EMB})"
#: Neighbouring components as complex numbers, 32 a row: the first half of the spectrum of 62 real cells.
_TURN = "2 * pi() * (t * k % 62) / 62"
_HALVES = f"{_DFT}, h AS (SELECT i, j // 2 AS k, sum(CASE WHEN j % 2 = 0 THEN x ELSE 0 END) AS re, sum(CASE WHEN j % 2 = 1 THEN x ELSE 0 END) AS im, CASE WHEN j // 2 IN (0, 31) THEN 1 ELSE 2 END AS w FROM e GROUP BY 1, 2, 5)"


def _halves(e: GridArray) -> GridArray:
    return e.reshape(-1, 32, 2)


def _two_axes(sign: str, keep: int, scale: str = "1") -> str:
    """Both axes of the embeddings, one after the other."""
    turn, turn2 = "2 * pi() * (j * k % 64) / 64", "2 * pi() * (i * l % n) / n"
    return (
        f"{_DFT}, m AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT i, k, sum(x * cos({turn})) AS re, {sign}sum(x * sin({turn})) AS im FROM e, unnest(range({keep})) a(k) GROUP BY 1, 2), "
        f"c AS (SELECT l, k, n, sum(re * cos({turn2}) - {sign}1 * im * sin({turn2})) AS re, sum(im * cos({turn2}) + {sign}1 * re * sin({turn2})) AS im FROM r, m, unnest(range((SELECT count(*) FROM embeddings))) b(l) GROUP BY 1, 2, 3) "
        f"SELECT CAST(l AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, CAST(p AS BIGINT) AS i2, round(CASE WHEN p = 0 THEN re ELSE im END / ({scale}), 4) + 0.0 AS x FROM c, unnest(range(2)) b(p)"
    )


_BACK = (
    f"{_HALVES}, m AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT l, k, w, n, sum(re * cos(2 * pi() * (i * l % n) / n) - im * sin(2 * pi() * (i * l % n) / n)) AS re, sum(im * cos(2 * pi() * (i * l % n) / n) + re * sin(2 * pi() * (i * l % n) / n)) AS im "
    f"FROM h, m, unnest(range((SELECT count(*) FROM embeddings))) b(l) GROUP BY 1, 2, 3, 4) SELECT CAST(l AS BIGINT) AS i0, CAST(t AS BIGINT) AS i1, round(sum(w * (re * cos({_TURN}) - im * sin({_TURN}))) / (62.0 * max(n)), 4) + 0.0 AS x FROM c, unnest(range(62)) a(t) GROUP BY 1, 2"
)
#: Of the rows of embeddings, 64 long.
TRANSFORMS = {
    "fft": (lambda e: FT.fft(e), f"{_DFT} SELECT i AS i0, CAST(k AS BIGINT) AS i1, CAST(p AS BIGINT) AS i2, round(sum(x * CASE WHEN p = 0 THEN cos({_ANGLE}) ELSE -sin({_ANGLE}) END), 4) + 0.0 AS x FROM e, unnest(range(64)) a(k), unnest(range(2)) b(p) GROUP BY 1, 2, 3"),
    "rfft": (lambda e: FT.rfft(e), f"{_DFT} SELECT i AS i0, CAST(k AS BIGINT) AS i1, CAST(p AS BIGINT) AS i2, round(sum(x * CASE WHEN p = 0 THEN cos({_ANGLE}) ELSE -sin({_ANGLE}) END), 4) + 0.0 AS x FROM e, unnest(range(33)) a(k), unnest(range(2)) b(p) GROUP BY 1, 2, 3"),
    "ihfft": (lambda e: FT.ihfft(e), f"{_DFT} SELECT i AS i0, CAST(k AS BIGINT) AS i1, CAST(p AS BIGINT) AS i2, round(sum(x * CASE WHEN p = 0 THEN cos({_ANGLE}) ELSE sin({_ANGLE}) END) / 64, 4) + 0.0 AS x FROM e, unnest(range(33)) a(k), unnest(range(2)) b(p) GROUP BY 1, 2, 3"),
    "ifft": (lambda e: FT.ifft(e, complex_in=False), f"{_DFT} SELECT i AS i0, CAST(k AS BIGINT) AS i1, CAST(p AS BIGINT) AS i2, round(sum(x * CASE WHEN p = 0 THEN cos({_ANGLE}) ELSE sin({_ANGLE}) END) / 64, 4) + 0.0 AS x FROM e, unnest(range(64)) a(k), unnest(range(2)) b(p) GROUP BY 1, 2, 3"),
    "irfft": (lambda e: FT.irfft(_halves(e)), f"{_HALVES} SELECT i AS i0, CAST(t AS BIGINT) AS i1, round(sum(w * (re * cos({_TURN}) - im * sin({_TURN}))) / 62, 4) + 0.0 AS x FROM h, unnest(range(62)) a(t) GROUP BY 1, 2"),
    "hfft": (lambda e: FT.hfft(_halves(e)), f"{_HALVES} SELECT i AS i0, CAST(t AS BIGINT) AS i1, round(sum(w * (re * cos({_TURN}) + im * sin({_TURN}))), 4) + 0.0 AS x FROM h, unnest(range(62)) a(t) GROUP BY 1, 2"),
    "fft2": (lambda e: FT.fft2(e), _two_axes("-", 64)),
    "fftn": (lambda e: FT.fftn(e), _two_axes("-", 64)),
    "ifft2": (lambda e: FT.ifft2(e, complex_in=False), _two_axes("+", 64, "64.0 * n")),
    "ifftn": (lambda e: FT.ifftn(e, complex_in=False), _two_axes("+", 64, "64.0 * n")),
    "rfft2": (lambda e: FT.rfft2(e), _two_axes("-", 33)),
    "rfftn": (lambda e: FT.rfftn(e), _two_axes("-", 33)),
    "irfft2": (lambda e: FT.irfft2(_halves(e)), _BACK),
    "irfftn": (lambda e: FT.irfftn(_halves(e)), _BACK),
}

#: Some frequencies of the whole series.
_FREQUENCIES = "(VALUES (0), (1), (2), (7), (100), (1499)) f(k)"
_FEW = "SELECT k FROM " + _FREQUENCIES
LONG = {
    "fft_series": (lambda s, d: FT.fft(_millions(s, d)), "-", "n", ""),
    "ifft_series": (lambda s, d: FT.ifft(_millions(s, d), complex_in=False), "+", "n", " / n"),
    "fft_series_bluestein": (lambda s, d: (lambda a: FT.fft(a, _prime_below(a.size)))(_millions(s, d)), "-", "p", ""),
}


def _millions(spark, sf_dir) -> GridArray:
    return _series(spark, sf_dir).apply(lambda x: x / 1e6)


def _prime_below(n: int) -> int:
    return next(p for p in range(n, 1, -1) if all(p % k for k in range(2, math.isqrt(p) + 1)))


def _long(make, sign: str, length: str, scale: str):
    """The transform of the whole series, at some frequencies against sums over all of it; length: n, or the largest prime p up to n."""

    def query(spark, sf_dir):
        a = make(spark, sf_dir)
        return _out(GridArray(a.df.filter(F.col("i0").isin(0, 1, 2, 7, 100, 1499)), a.shape))

    prime = "(SELECT max(c) FROM (SELECT (SELECT count(*) FROM orders) - b AS c FROM unnest(range(200)) u(b)) WHERE len(list_filter(range(2, CAST(sqrt(c) AS BIGINT) + 1), lambda k: c % k = 0)) = 0)"
    angle = "2 * pi() * ((i0 * k) % m) / m"
    sql = (
        f"{_SR}, q AS (SELECT t.*, {'n' if length == 'n' else prime} AS m FROM t) SELECT CAST(k AS BIGINT) AS i0, CAST(p AS BIGINT) AS i1, round(sum(x / 1e6 * CASE WHEN p = 0 THEN cos({angle}) ELSE {sign}sin({angle}) END{scale}), 4) + 0.0 AS x "
        f"FROM q, {_FREQUENCIES}, unnest(range(2)) b(p) WHERE i0 < m GROUP BY 1, 2"
    )
    return query, sql


def _whole_numbers(spark, sf_dir, name: str, index: str, column) -> GridArray:
    df = table(spark, sf_dir, name)
    return GridArray(ranked(df, [index], "i0").select("i0", column.cast("double").alias("x")), [df.count()])


def _convolved(name: str, index: str, column, expr: str, flip: bool = False):
    """The orders' prices in thousands with another column, place by place; whole numbers, so that sums are exact."""

    def query(spark, sf_dir):
        a, b = _whole_numbers(spark, sf_dir, "orders", "o_orderkey", F.floor(F.col("o_totalprice") / 1000)), _whole_numbers(spark, sf_dir, name, index, column())
        found = FT.correlate(a, b, "full") if flip else FT.convolve(a, b)
        return found.df.select(F.col("i0").cast("long").alias("i0"), (F.round("x") + 0.0).alias("x"))

    place = "a.i + b.n - 1 - b.j" if flip else "a.i + b.j"
    sql = (
        f"WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, floor(o_totalprice / 1000) AS x FROM orders), b AS (SELECT row_number() OVER (ORDER BY {index}) - 1 AS j, {expr} AS y, count(*) OVER () AS n FROM {name}) "
        f"SELECT {place} AS i0, CAST(sum(x * y) AS DOUBLE) + 0.0 AS x FROM a, b GROUP BY 1"
    )
    return query, sql


CONVOLVED = {
    "convolve_columns": ("supplier", "s_suppkey", lambda: F.floor("s_acctbal"), "floor(s_acctbal)", False),
    "convolve_long": ("part", "p_partkey", lambda: F.col("p_size"), "p_size", False),
    "correlate_columns": ("supplier", "s_suppkey", lambda: F.floor("s_acctbal"), "floor(s_acctbal)", True),
}

_I0 = "list_sum([pow({0} * {0} / 4, k) / pow(gamma(k + 1), 2) FOR k IN range(60)])"
_J0 = "list_sum([pow(-1, k) * pow({0} * {0} / 4, k) / pow(gamma(k + 1), 2) FOR k IN range(60)])"
_J1 = "({0} / 2) * list_sum([pow(-1, k) * pow({0} * {0} / 4, k) / (gamma(k + 1) * gamma(k + 2)) FOR k IN range(60)])"
_ERF = "2 / sqrt(pi()) * list_sum([pow(-1, k) * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)) FOR k IN range(80)])"
_HARMONIC = "coalesce(list_sum([1.0 / h FOR h IN range(1, {} + 1)]), 0)"
_GAMMA = "0.5772156649015329"
#: Of x from -2.5 to 2.5 and v from 0.5 to 5.5, by order.
SPECIAL = {
    "gamma": (lambda: E.gamma("v"), "gamma(v)"),
    "lgamma": (lambda: E.lgamma("v"), "lgamma(v)"),
    "erf": (lambda: E.erf("x"), _ERF),
    "erfc": (lambda: E.erfc("x"), f"1 - {_ERF}"),
    "i0": (lambda: E.i0("x"), _I0.format("x")),
    "j0": (lambda: E.j0("x"), _J0.format("x")),
    "j1": (lambda: E.j1("x"), _J1.format("x")),
    "y0": (lambda: E.y0("v"), f"2 / pi() * ((ln(v / 2) + {_GAMMA}) * {_J0.format('v')} - list_sum([pow(-1, k) * {_HARMONIC.format('k')} * pow(v * v / 4, k) / pow(gamma(k + 1), 2) FOR k IN range(1, 50)]))"),
    "y1": (lambda: E.y1("v"), f"-2 / (pi() * v) + 2 / pi() * ln(v / 2) * {_J1.format('v')} - 1 / pi() * list_sum([pow(-1, k) * (-2 * {_GAMMA} + {_HARMONIC.format('k')} + {_HARMONIC.format('(k + 1)')}) * pow(v / 2, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2)) FOR k IN range(50)])"),
    "nextafter": (lambda: (E.nextafter("x", "v") - F.col("x")) * 1e16, "(nextafter(x, v) - x) * 1e16"),
    "spacing": (lambda: E.spacing("v") * 1e16, "(nextafter(v, CAST('Infinity' AS DOUBLE)) - v) * 1e16"),
}
_POINTS = "SELECT o_orderkey, (o_orderkey % 1001) / 200.0::DOUBLE - 2.5 AS x, (o_orderkey % 1001) / 200.0::DOUBLE + 0.5 AS v FROM orders"

#: Derivative of 1 P0 + 2 P1 + 3 P2 + 4 P3 and, from 0, integral of 1 P0 + 2 P1 + 3 P2 of each basis, in powers of x.
_SLOPES = {
    "polynomial": ("2 + 6 * x + 12 * x * x", "x + x * x + x * x * x"),
    "chebyshev": ("2 + 12 * x + 4 * (12 * x * x - 3)", "x + x * x + 2 * x * x * x - 3 * x"),
    "legendre": ("2 + 9 * x + 2 * (15 * x * x - 3)", "x + x * x + (3 * x * x * x - 3 * x) / 2"),
    "hermite": ("4 + 24 * x + 4 * (24 * x * x - 12)", "x + 2 * x * x + 4 * x * x * x - 6 * x"),
    "hermite_e": ("2 + 6 * x + 4 * (3 * x * x - 3)", "x + x * x + x * x * x - 3 * x"),
    "laguerre": ("-2 + 3 * (x - 2) + 4 * (-3 * x * x + 18 * x - 18) / 6", "x + 2 * x - x * x + x * x * x / 2 - 3 * x * x + 3 * x"),
}
_V = "1 + 2 * x + 3 * x * x"
#: Coefficients of powers, evaluated at the orders' prices in millions.
POLYNOMIALS = {
    "add": (lambda: P.val("x", P.add([1, 2], [3, 4, 5])), "4 + 6 * x + 5 * x * x"),
    "sub": (lambda: P.val("x", P.sub([1, 2], [3, 4, 5])), "-2 - 2 * x - 5 * x * x"),
    "mulx": (lambda: P.val("x", P.mulx([1, 2, 3])), f"x * ({_V})"),
    "mul": (lambda: P.val("x", P.mul([1, 2, 3], [2, 1])), f"({_V}) * (2 + x)"),
    "mul_chebyshev": (lambda: P.val("x", P.mul([1, 2], [0, 3], "chebyshev"), "chebyshev"), "(1 + 2 * x) * 3 * x"),
    "div": (lambda: P.val("x", P.div([2, 5, 8, 3], [2, 1])[0]) * (2 + F.col("x")) + P.val("x", P.div([2, 5, 8, 3], [2, 1])[1]), "2 + 5 * x + 8 * x * x + 3 * x * x * x"),
    "pow": (lambda: P.val("x", P.pow([1, 2], 3)), "pow(1 + 2 * x, 3)"),
    "line": (lambda: P.val("x", P.line(2.0, 3.0)), "2 + 3 * x"),
    "fromroots": (lambda: P.val("x", P.fromroots([1.0, -2.0])), "(x - 1) * (x + 2)"),
    "roots": (lambda: P.valfromroots("x", [r.real for r in P.roots([-2.0, 1.0, 1.0])]), "(x - 1) * (x + 2)"),
    "companion": (lambda: F.lit(float(P.companion([-2.0, 1.0, 1.0]).trace())) + F.col("x") * 0, "-1 + 0 * x"),
    "trim": (lambda: P.val("x", P.trim([1.0, 2.0, 3.0, 0.0])), _V),
    "to_power": (lambda: P.val("x", P.to_power([1, 2, 3], "chebyshev")), "1 + 2 * x + 3 * (2 * x * x - 1)"),
    "from_power": (lambda: P.val("x", P.from_power([1, 2, 3], "legendre"), "legendre"), _V),
    "gauss": (lambda: F.lit(float((P.gauss(5, "legendre")[0] ** 4 * P.gauss(5, "legendre")[1]).sum())) + F.col("x") * 0, "0.4 + 0 * x"),
    "weight_chebyshev": (lambda: P.weight("x", "chebyshev"), "1 / sqrt(1 - x * x)"),
    "weight_hermite": (lambda: P.weight("x", "hermite"), "exp(-x * x)"),
    "weight_laguerre": (lambda: P.weight("x", "laguerre"), "exp(-x)"),
    "chebpts1": (lambda: F.lit(float(P.chebpts1(5)[4])) + F.col("x") * 0, "cos(pi() / 10) + 0 * x"),
    "chebpts2": (lambda: F.lit(float(P.chebpts2(5)[3])) + F.col("x") * 0, "cos(pi() / 4) + 0 * x"),
    "chebinterpolate": (lambda: P.val("x", P.chebinterpolate(lambda v: v**3 - v, 3), "chebyshev"), "x * x * x - x"),
    "val3d": (lambda: P.val3d("x", F.col("x") * 2, F.lit(1.0), [[[1.0, 2.0]], [[3.0, 4.0]]]), "3 + 7 * x"),
    "vander2d": (lambda: P.vander2d("x", F.col("x") * 2, (1, 1))[3], "x * 2 * x"),
    "vander3d": (lambda: P.vander3d("x", F.col("x") * 2, F.lit(3.0), (1, 1, 1))[7], "x * 2 * x * 3"),
    "polyadd": (lambda: P.polyval(P.polyadd([2, 1], [5, 4, 3]), "x"), "4 + 6 * x + 5 * x * x"),
    "polysub": (lambda: P.polyval(P.polysub([2, 1], [5, 4, 3]), "x"), "-2 - 2 * x - 5 * x * x"),
    "polymul": (lambda: P.polyval(P.polymul([3, 2, 1], [1, 2]), "x"), f"({_V}) * (2 + x)"),
    "polyder": (lambda: P.polyval(P.polyder([4, 3, 2, 1]), "x"), "2 + 6 * x + 12 * x * x"),
    "polyint": (lambda: P.polyval(P.polyint([3, 2, 1]), "x"), "x + x * x + x * x * x"),
    "polydiv": (lambda: P.polyval(P.polydiv([3, 8, 5, 2], [1, 2])[0], "x") * (2 + F.col("x")) + P.polyval(P.polydiv([3, 8, 5, 2], [1, 2])[1], "x"), "2 + 5 * x + 8 * x * x + 3 * x * x * x"),
    "poly": (lambda: P.polyval(P.poly([1.0, -2.0]), "x"), "(x - 1) * (x + 2)"),
    "poly1d": (lambda: P.poly1d([3, 2, 1]).deriv()("x"), "2 + 6 * x"),
}

_PI2 = math.pi**2
#: Mean and standard deviation of each sampler of the queries, and the part of the latter that an estimate may be off by. None: not held.
LAWS = {
    "random": (0.5, 12**-0.5, 0.03), "uniform": (2.5, 12**-0.5, 0.03), "integers": (3.5, (35 / 12) ** 0.5, 0.03), "standard_normal": (0.0, 1.0, 0.03), "normal": (5.0, 2.0, 0.03),
    "lognormal": (math.exp(0.125), ((math.exp(0.25) - 1) * math.exp(0.25)) ** 0.5, 0.08), "exponential": (2.0, 2.0, 0.05), "weibull": (math.gamma(1.5), (1 - math.gamma(1.5) ** 2) ** 0.5, 0.04),
    "rayleigh": ((math.pi / 2) ** 0.5, (2 - math.pi / 2) ** 0.5, 0.04), "power": (0.75, (3 / 80) ** 0.5, 0.04), "pareto": (0.25, (5 / 48) ** 0.5, 0.25), "laplace": (0.0, 2**0.5, 0.05),
    "logistic": (0.0, math.pi / 3**0.5, 0.05), "gumbel": (0.5772156649, math.pi / 6**0.5, 0.05), "standard_cauchy": (0.0, math.pi / 12**0.5, 0.03), "triangular": (4 / 3, (7 / 18) ** 0.5, 0.03),
    "geometric": (1 / 0.3, 0.7**0.5 / 0.3, 0.05), "choice": (3.3, (0.2 + 1.2 + 12.5 - 3.3**2) ** 0.5, 0.03), "poisson": (4.0, 2.0, 0.03), "binomial": (3.0, 2.1**0.5, 0.03), "beta": (0.4, 0.2, 0.03),
    "gamma": (3.0, 1.5 * 2**0.5, 0.05), "chisquare": (3.0, 6**0.5, 0.06), "f": (1.2, (2 * 144 * 15 / (5 * 100 * 8)) ** 0.5, 0.3), "standard_t": (0.0, (8 / 6) ** 0.5, 0.06),
    "vonmises": (0.0, None, 0.0), "wald": (1.0, 0.5**0.5, 0.1), "negative_binomial": (4.5, (3 * 0.6) ** 0.5 / 0.4, 0.05), "hypergeometric": (2.0, (5 * 0.4 * 0.6 * 20 / 24) ** 0.5, 0.03),
    "logseries": (0.5 / (0.5 * math.log(2)), None, 0.0), "zipf": (_PI2 / 6 / 1.2020569, None, 0.0), "noncentral_chisquare": (4.0, 10**0.5, 0.06), "noncentral_f": (12 / 10 * 6 / 5, None, 0.0),
    "multivariate_normal": (1.0, 2**0.5, 0.03), "dirichlet": (1 / 6, (5 / 36 / 7) ** 0.5, 0.05), "multinomial": (4.0, 0.8**0.5, 0.03), "bytes": (4.0, 0.0, 0.0), "standard_gamma": (2.0, 2**0.5, 0.05),
}


def _law(name: str):
    mean, std, off = LAWS[name]

    def query(spark, sf_dir):
        drawn = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i")).distinct()
        found = drawn.select(SAMPLERS[name](default_rng(7)).cast("double").alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
        # Six standard errors; half a unit of spread stands in where the law's own is not stated.
        near = F.abs(F.col("mean") - mean) <= 6 * (F.col("std") if std is None else F.lit(std)) / F.sqrt("n") + 0.002
        return found.select("n", near.alias("mean_fits"), (F.lit(True) if std is None else F.abs(F.col("std") - std) <= off * std + 1e-9).alias("spread_fits"))

    return query


def _written(write, read):
    """What `read` gives of what `write` has written to a folder of its own."""

    def query(spark, sf_dir):
        path = scratch(spark, "round-trip")
        write(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path)
        return read(spark, path)

    return query


_ORDERS = "SELECT o_orderkey, o_totalprice FROM orders"


def _texts(df, path):
    text.savetxt(df, [F.col("o_orderkey").cast("double"), "o_totalprice"], path, "%.4f", ",", "orders and prices")


def _priced(a: GridArray):
    """Rows of (key, price) from a two-column array read back, in any order of lines."""
    return a.df.groupBy("i0").agg(F.max(F.when(F.col("i1") == 0, F.col("x"))).cast("long").alias("o_orderkey"), F.max(F.when(F.col("i1") == 1, F.col("x"))).alias("o_totalprice")).drop("i0")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


_SUMS = "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"


def _summed(df, column):
    return df.select("vec_id", F.round(F.aggregate(column, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _raw(spark, sf_dir):
    """Vectors as raw 8-byte numbers."""
    return _vectors(spark, sf_dir).select("vec_id", npy.raw("embedding").alias("data"))


SOURCES = {
    "savetxt": (_written(_texts, lambda s, p: s.read.text(p).filter("value not like '#%'").select(F.split("value", ",")[0].cast("double").cast("long").alias("o_orderkey"), F.split("value", ",")[1].cast("double").alias("o_totalprice"))), _ORDERS),
    "loadtxt": (_written(_texts, lambda s, p: _priced(text.loadtxt(s, p, delimiter=","))), _ORDERS),
    "genfromtxt": (_written(_texts, lambda s, p: _priced(text.genfromtxt(s, p, delimiter=","))), _ORDERS),
    "savez": (_written(lambda df, p: text.savez(p, a=df), lambda s, p: text.NpzFile(s, p, ["a"])["a"]), _ORDERS),
    "savez_compressed": (_written(lambda df, p: text.savez_compressed(p, a=df, b=df.limit(0)), lambda s, p: text.NpzFile(s, p, ["a", "b"]).a), _ORDERS),
    "NpzFile": (_written(lambda df, p: text.savez(p, a=df, b=df), lambda s, p: text.NpzFile(s, p, ["a", "b"]).b), _ORDERS),
    "save": (lambda s, d: _summed(npy.frombuffer(npy.save(_vectors(s, d), "embedding"), "data", offset=128), "values"), _SUMS),
    "frombuffer": (lambda s, d: _summed(npy.frombuffer(_raw(s, d), "data"), "values"), _SUMS),
    "fromstring": (lambda s, d: _out(text.fromstring(s, "1.5, 2, -3e2", ",")), "SELECT CAST(i AS BIGINT) AS i0, x FROM (VALUES (0, 1.5::DOUBLE), (1, 2.0::DOUBLE), (2, -300.0::DOUBLE)) v(i, x)"),
    "fromiter": (lambda s, d: _out(gs.fromiter(s, (k * k for k in range(5)))), "SELECT CAST(k AS BIGINT) AS i0, (k * k)::DOUBLE AS x FROM unnest(range(5)) u(k)"),
}

_FACTS = [("int32", "float32", "float64"), ("int8", "uint8", "int16"), ("int64", "uint64", "float64"), ("float32", "complex64", "complex64"), ("bool", "int8", "int8"), ("float16", "float32", "float32"), ("int64", "float32", "float64")]
_FACTS_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _FACTS)


def _types(f):
    return lambda s, d: s.createDataFrame([(a, b, f(a, b)) for a, b, _ in _FACTS], "a string, b string, c string")


TYPES = {
    "promote_types": (_types(T.promote_types), f"SELECT * FROM (VALUES {_FACTS_SQL}) v(a, b, c)"),
    "result_type": (_types(T.result_type), f"SELECT * FROM (VALUES {_FACTS_SQL}) v(a, b, c)"),
    "find_common_type": (_types(lambda a, b: gs.find_common_type(a, b)), f"SELECT * FROM (VALUES {_FACTS_SQL}) v(a, b, c)"),
    "can_cast": (lambda s, d: s.createDataFrame([(a, b, T.can_cast(a, b)) for a, b in (("int32", "int64"), ("int64", "int32"), ("int64", "float64"), ("float64", "float32"), ("float32", "complex64"))], "a string, b string, c boolean"), "SELECT * FROM (VALUES ('int32', 'int64', true), ('int64', 'int32', false), ('int64', 'float64', true), ('float64', 'float32', false), ('float32', 'complex64', true)) v(a, b, c)"),
    "min_scalar_type": (lambda s, d: s.createDataFrame([(str(v), T.min_scalar_type(v)) for v in (10, 300, -10, 70000, True)], "v string, t string"), "SELECT * FROM (VALUES ('10', 'uint8'), ('300', 'uint16'), ('-10', 'int8'), ('70000', 'uint32'), ('True', 'bool')) v(v, t)"),
    "issubdtype": (lambda s, d: s.createDataFrame([(a, b, T.issubdtype(a, b)) for a, b in (("int32", "integer"), ("float32", "integer"), ("float64", "floating"))], "a string, b string, c boolean"), "SELECT * FROM (VALUES ('int32', 'integer', true), ('float32', 'integer', false), ('float64', 'floating', true)) v(a, b, c)"),
    "iinfo": (lambda s, d: s.createDataFrame([(t, int(T.iinfo.of(t).max)) for t in ("int8", "int16", "int32")], "t string, high long"), "SELECT t, h::BIGINT AS high FROM (VALUES ('int8', 127), ('int16', 32767), ('int32', 2147483647)) v(t, h)"),
    "finfo": (lambda s, d: s.createDataFrame([(t, float(T.finfo.of(t).eps)) for t in ("float32", "float64")], "t string, eps double"), "SELECT t, pow(2.0::DOUBLE, k) AS eps FROM (VALUES ('float32', -23), ('float64', -52)) v(t, k)"),
}

_GRAM = f"WITH e AS ({_EMB}), g AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS x FROM e a JOIN e b USING (i) GROUP BY 1, 2)"


def _gram(spark, sf_dir):
    e = _embedding(spark, sf_dir)
    return e.T @ e


LINEAR = {
    "pinv": (lambda g: (g @ L.pinv(g)) @ g, f"{_GRAM} SELECT i AS i0, j AS i1, {_R4.format('x')} FROM g"),
    "matrix_rank": (lambda g: L.matrix_rank(g), f"{_GRAM} SELECT least(64, count(DISTINCT i))::DOUBLE AS x FROM e"),
    "matrix_power": (lambda g: L.matrix_power(g.apply(lambda x: x / 100), 2), f"{_GRAM} SELECT a.i AS i0, b.j AS i1, {_R4.format('sum(a.x * b.x / 10000)')} FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2"),
    "multi_dot": (lambda g: L.multi_dot([g.apply(lambda x: x / 100), g.apply(lambda x: x / 100)]), f"{_GRAM} SELECT a.i AS i0, b.j AS i1, {_R4.format('sum(a.x * b.x / 10000)')} FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2"),
    "matmul": (lambda g: g.matmul(g[0]), f"{_GRAM} SELECT a.i AS i0, {_R4.format('sum(a.x * b.x)')} FROM g a JOIN g b ON a.j = b.j AND b.i = 0 GROUP BY 1"),
    "eigh": (lambda g: L.eigh(g)[0].sum(), f"{_GRAM} SELECT {_R4.format('sum(x)')} FROM g WHERE i = j"),
    "eigvals": (lambda g: L.eigvals(g).sum(0)[0], f"{_GRAM} SELECT {_R4.format('sum(x)')} FROM g WHERE i = j"),
    "svd": (lambda g: L.svd(g)[1].sum(), f"{_GRAM} SELECT {_R4.format('sum(x)')} FROM g WHERE i = j"),
    "cond": (lambda g: L.cond(g.apply(lambda x: x * 0)[:2, :2] + G.array(g.df.sparkSession, [[4.0, 0.0], [0.0, 2.0]])), "SELECT 2.0::DOUBLE AS x"),
    "matrix_norm": (lambda g: L.norm(g, "fro"), f"{_GRAM} SELECT round(sqrt(sum(x * x)), 4) AS x FROM g"),
    "vector_norm": (lambda g: L.norm(g[0], 2), f"{_GRAM} SELECT round(sqrt(sum(x * x)), 4) AS x FROM g WHERE i = 0"),
    "tensorsolve": (lambda g: g @ L.tensorsolve(g, g[0]), f"{_GRAM} SELECT j AS i0, {_R4.format('x')} FROM g WHERE i = 0"),
}


# Of all embeddings as one tall matrix.


def _with_sum(e):
    """A further column, the sum of the first two: no full rank."""
    return G.concatenate([e, (e[:, :1] + e[:, 1:2])], 1)


def _fitted_moments(e):
    """Moments of the least-squares fit to column 5 by the other columns and one that depends on them: those of column 5 itself."""
    a, y = _with_sum(e[:, :5]), e[:, 5]
    return a.T.dot(a.dot(L.lstsq_small(a, y)))


def _qr_product(e):
    q, r = L.qr(e)
    return q @ r


def _qr_gram(e):
    q = L.qr(e)[0]
    return q.T @ q


def _triangle_gram(e):
    r = L.qr(e)[1]
    return r.T @ r


def _svd_product(e):
    u, s, vt = L.svd(e, full_matrices=False)
    return (u * s) @ vt


_UNIT = "SELECT a.j AS i0, b.j AS i1, CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM (SELECT DISTINCT j FROM e) a, (SELECT DISTINCT j FROM e) b"

TALL = {
    "qr_tall": (_qr_product, f"{_GRAM} SELECT i AS i0, j AS i1, {_R4.format('x')} FROM e"),
    "qr_tall_orthogonal": (_qr_gram, f"{_GRAM} {_UNIT}"),
    "qr_tall_triangle": (_triangle_gram, f"{_GRAM} SELECT i AS i0, j AS i1, {_R4.format('x')} FROM g"),
    "svd_tall": (_svd_product, f"{_GRAM} SELECT i AS i0, j AS i1, {_R4.format('x')} FROM e"),
    "svdvals_tall": (lambda e: L.svdvals(e).apply(lambda x: F.pow(x / 10, 4.0)).sum(), f"{_GRAM} SELECT {_R4.format('sum(x * x / 10000)')} FROM g"),
    "pinv_tall": (lambda e: L.pinv(e) @ e, f"{_GRAM} {_UNIT}"),
    "matrix_rank_tall": (lambda e: L.matrix_rank(_with_sum(e)), f"{_GRAM} SELECT count(DISTINCT j)::DOUBLE AS x FROM e"),
    "lstsq_tall": (_fitted_moments, f"{_GRAM} SELECT i AS i0, {_R4.format('x')} FROM g WHERE i < 5 AND j = 5 UNION ALL SELECT 5, {_R4.format('sum(x)')} FROM g WHERE i < 2 AND j = 5"),
}


# Square matrices with a row and a column for each embedding, of more tiles than one from 257 embeddings on.


def _kernel(e, f):
    """Products of all pairs of rows, each cell changed by f(x, row, column)."""
    k = e @ e.T
    return GridArray(k.df.withColumn("x", f(F.col("x"), F.col("i0"), F.col("i1"))), k.shape)


def _lower(e):
    """A lower triangle of products with a positive diagonal."""
    n = e.shape[0]
    return _kernel(e, lambda x, i, j: F.when(i > j, x / n).when(i == j, 1 + x / n).otherwise(0.0))


def _updated(e):
    """A diagonal and a product of two columns, rows turned upside down: nothing in it is symmetric and each pivot lies in another tile, but inverse and determinant have a closed form."""
    n = e.shape[0]
    return gs.flipud(_kernel(e, lambda x, i, j: F.when(i == j, 1 + x / n).otherwise(0.0)) + abs(e[:, :1]) @ abs(e[:, 1:2]).T)


_LOWER = f"WITH e AS ({_EMB}), n AS (SELECT count(DISTINCT i) AS n FROM e), k AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS x FROM e a JOIN e b USING (j) WHERE a.i >= b.i GROUP BY 1, 2)"
#: d: the diagonal; u, v: the two columns; c: one and the sum of their products by the diagonal.
_UPDATED = f"WITH e AS ({_EMB}), n AS (SELECT count(DISTINCT i) AS n FROM e), r AS (SELECT i, 1 + sum(x * x) / any_value(n) AS d, sum(abs(x)) FILTER (j = 0) AS u, sum(abs(x)) FILTER (j = 1) AS v, sum(x) FILTER (j = 2) AS b FROM e, n GROUP BY 1), c AS (SELECT 1 + sum(u * v / d) AS c FROM r)"
_SIGN = "CASE WHEN (n * (n - 1) // 2) % 2 = 0 THEN 1.0 ELSE -1.0 END * sign(c)"


def _rebuilt(e):
    """All products of rows from the eigenvalues and vectors of their matrix, of which no more than the columns differ from zero."""
    w, v = L.eigh_leading((e, e.T), e.shape[1])
    return (v * w) @ v.T


def _vector_products(e):
    v = L.eigh_leading((e, e.T), e.shape[1])[1]
    return v.T @ v


BLOCKED = {
    "eigh_leading": (_rebuilt, f"WITH e AS ({_EMB}) SELECT a.i AS i0, b.i AS i1, {_R4.format('sum(a.x * b.x)')} FROM e a JOIN e b USING (j) GROUP BY 1, 2"),
    "eigh_leading_vectors": (_vector_products, f"{_GRAM} {_UNIT}"),
    "eigh_leading_values": (lambda e: L.eigh_leading((e, e.T), e.shape[1])[0].apply(lambda x: F.pow(x, 2.0)).sum(), f"{_GRAM} SELECT {_R4.format('sum(x * x)')} FROM g"),
    "cholesky_blocked": (lambda e: L.cholesky((lambda t: t @ t.T)(_lower(e))), f"{_LOWER} SELECT a.i AS i0, b.i AS i1, {_R4.format('CASE WHEN a.i < b.i THEN 0 WHEN a.i = b.i THEN 1 + x / n ELSE x / n END')} FROM (SELECT DISTINCT i FROM e) a CROSS JOIN (SELECT DISTINCT i FROM e) b CROSS JOIN n LEFT JOIN k ON k.i = a.i AND k.j = b.i"),
    "inv_blocked": (lambda e: L.inv(_updated(e)).apply(lambda x: x * 1000), f"{_UPDATED} SELECT a.i AS i0, n - 1 - b.i AS i1, {_R4.format('1000 * (CASE WHEN a.i = b.i THEN 1 / a.d ELSE 0 END - a.u / a.d * (b.v / b.d) / c)')} FROM r a CROSS JOIN r b CROSS JOIN n CROSS JOIN c"),
    "solve_blocked": (lambda e: L.solve(_updated(e), e[:, 2]), f"{_UPDATED}, t AS (SELECT r.i, r.d, r.u, r.v, s.b FROM r CROSS JOIN n JOIN r s ON s.i = n - 1 - r.i), w AS (SELECT sum(v * b / d) AS w FROM t) SELECT i AS i0, {_R4.format('b / d - u / d * w / c')} FROM t CROSS JOIN w CROSS JOIN c"),
    "det_blocked": (lambda e: L.det(_updated(e)), f"{_UPDATED} SELECT {_R4.format(f'exp((SELECT sum(ln(d)) FROM r)) * abs(c) * {_SIGN}')} FROM n CROSS JOIN c"),
    "slogdet_blocked": (lambda e: L.slogdet(_updated(e)), f"{_UPDATED} SELECT 0::BIGINT AS i0, {_R4.format(_SIGN)} FROM n CROSS JOIN c UNION ALL SELECT 1, {_R4.format('(SELECT sum(ln(d)) FROM r) + ln(abs(c))')} FROM c"),
}


def _grid_query(f):
    def query(spark, sf_dir):
        found = f(grid(_series(spark, sf_dir)))
        return _out(found) if isinstance(found, GridArray) else found

    return query


def entries():
    found = {}
    for name, (f, sql) in GRID.items():
        found[f"shape_{name}"] = _grid_query(f), sql
    for name, (f, sql) in SERIES.items():
        found[f"array_{name}"] = (lambda s, d, f=f: _out(f(_series(s, d)))), sql
    for name, (f, sql) in MADE.items():
        found[name if name == "kaiser" else f"made_{name}"] = (lambda s, d, f=f: _out(f(s))), sql
    for name, (f, sql) in TRANSFORMS.items():
        found[name] = (lambda s, d, f=f: _out(f(_embedding(s, d)))), sql
    for name, parts in LONG.items():
        found[name] = _long(*parts)
    for name, parts in CONVOLVED.items():
        found[name] = _convolved(*parts)
    for name, (f, sql) in LINEAR.items():
        found[f"linalg_{name}"] = (lambda s, d, f=f: _out(f(_gram(s, d)))), sql
    for name, (f, sql) in (TALL | BLOCKED).items():
        found[f"linalg_{name}"] = (lambda s, d, f=f: _out(f(_embedding(s, d)))), sql
    for name, (make, sql) in SPECIAL.items():
        points = lambda s, d: table(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 1001) / 200 - 2.5).alias("x"), ((F.col("o_orderkey") % 1001) / 200 + 0.5).alias("v"))
        found[f"elementwise_{name}"] = (lambda s, d, make=make, points=points: points(s, d).select("o_orderkey", (F.round(make(), 6) + F.lit(0.0)).alias("value"))), f"SELECT o_orderkey, round(CAST({sql} AS DOUBLE), 6) + 0.0 AS value FROM ({_POINTS})"
    for kind, (slope, area) in _SLOPES.items():
        found[f"polynomial_{kind}_der"] = _px(lambda kind=kind: P.val("x", P.der([1, 2, 3, 4], 1, kind), kind)), _px_sql(slope)
        at_zero = lambda kind: P.val("x", P.integral([1, 2, 3], 1, (), kind), kind) - P.val(F.lit(0.0), P.integral([1, 2, 3], 1, (), kind), kind)
        found[f"polynomial_{kind}_int"] = _px(lambda kind=kind, at_zero=at_zero: at_zero(kind)), _px_sql(area)
    for name, (make, sql) in POLYNOMIALS.items():
        # x has 8 decimals: rounded to 9, lines have no ties; of higher powers the ninth place is often a tie or within the error of doubles.
        digits = 9 if name in ("line", "poly1d", "val3d") else 6
        found[f"polynomial_{name}"] = _px(make, digits), _px_sql(sql, digits)
    for name in LAWS:
        found[f"random_{name}"] = _law(name), "SELECT count(*) AS n, true AS mean_fits, true AS spread_fits FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"
    for name, (query, sql) in SOURCES.items():
        found[f"source_{name}"] = query, sql
    for name, (query, sql) in TYPES.items():
        found[f"types_{name}"] = query, sql
    found["histogramdd"] = (
        lambda s, d: B.histogramdd(table(s, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], [5, 2, 2], [(0.0, 50.0), (0.0, 0.08), (0.0, 0.1)]),
        "SELECT CAST(least(floor(l_quantity / 10.0), 4) AS BIGINT) AS b0, CAST(least(floor(l_tax / 0.04), 1) AS BIGINT) AS b1, CAST(least(floor(l_discount / 0.05), 1) AS BIGINT) AS b2, count(*) AS count FROM lineitem GROUP BY 1, 2, 3",
    )
    found["sort_complex"] = (
        lambda s, d: gs.sort_complex(table(s, d, "orders").select("o_orderkey", E.complex_(F.floor(F.col("o_totalprice") / 1e5), "o_custkey").alias("z")), "z", "o_orderkey").select("o_orderkey", "place"),
        "SELECT o_orderkey, row_number() OVER (ORDER BY floor(o_totalprice / 1e5), o_custkey, o_orderkey) - 1 AS place FROM orders",
    )
    found["record_append_fields"] = (
        lambda s, d: gs.append_fields(table(s, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_totalprice").alias("r")), "r", double=F.col("r.o_totalprice") * 2).select("o_orderkey", F.col("r.o_custkey").alias("c"), F.round("r.double", 4).alias("double")),
        "SELECT o_orderkey, o_custkey AS c, round(o_totalprice * 2, 4) AS double FROM orders",
    )
    found["unravel_index"] = (
        lambda s, d: table(s, d, "orders").select("o_orderkey", *(c.alias(f"a{k}") for k, c in enumerate(gs.unravel_index(F.col("o_custkey"), [1 << 20, 7, 5])))),
        "SELECT o_orderkey, o_custkey // 35 AS a0, o_custkey // 5 % 7 AS a1, o_custkey % 5 AS a2 FROM orders",
    )
    found["ravel_multi_index"] = (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", gs.ravel_multi_index([F.col("l_orderkey"), F.col("l_linenumber")], [1 << 40, 10]).cast("long").alias("flat")),
        "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS flat FROM lineitem",
    )
    return found
