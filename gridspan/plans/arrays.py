"""Ordered, set, binning, shape and linear algebra operators over whole tables, each with its SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspan import array as G
from gridspan.array import GridArray
from gridspan.functions import polynomials as P
from gridspan.layout import ranked
from gridspan.operators import binning as B
from gridspan.operators import linalg as L
from gridspan.operators import masked as M
from gridspan.operators import sets as U
from gridspan.operators import spectral as FT
from gridspan.operators import ufunc as UF
from gridspan.session import table

# Inputs: events as lanes (one a user, in order of ts and event_id), orders as one long array by o_orderkey's rank,
# embeddings as a matrix, lineitem's columns.


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["ts", "event_id"], "k", ["user_id"])


_LANES = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events"


def _over_lane(value) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("k")
        rows = _lanes(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
        return rows.select("event_id", value(w).alias("value")).filter("value is not null").select("event_id", F.round("value", 5).alias("value"))

    return query


def _lane_sql(expr: str) -> str:
    return f"SELECT event_id, round(v, 5) AS value FROM (SELECT event_id, {expr} AS v FROM ({_LANES}) WINDOW w AS (PARTITION BY user_id ORDER BY k)) WHERE v IS NOT NULL"


def _series(spark: SparkSession, sf_dir: str) -> GridArray:
    """o_totalprice by order key: one array of any length, o_orderkey being dense from 1 or 0."""
    df = table(spark, sf_dir, "orders")
    return GridArray(ranked(df, ["o_orderkey"], "i0").select("i0", F.col("o_totalprice").alias("x")), [df.count()])


_SERIES = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, o_totalprice AS x, count(*) OVER () AS n FROM orders"


def _out(a: GridArray) -> DataFrame:
    """Cells rounded, NULL and all."""
    kind = a.dtype
    value = F.round(F.col("x").cast("double"), 4) + F.lit(0.0) if kind in ("double", "float", "int", "bigint") or kind.startswith("decimal") else F.col("x")
    return a.df.select(*(F.col(c).cast("long").alias(c) for c in a.axes), value.alias("x"))


def grid(a: GridArray) -> GridArray:
    """The whole array as rows of 100, the last one filled up with zeros."""
    return (a.pad(0, -a.size % 100) if a.size % 100 else a).reshape(-1, 100)


def grid_sql() -> str:
    """(i, j, x) of `grid` of the series."""
    return f"SELECT i0 // 100 AS i, i0 % 100 AS j, x FROM ({_SERIES}) UNION ALL SELECT (n + r) // 100, (n + r) % 100, 0.0 FROM (SELECT count(*) AS n FROM orders), unnest(range((100 - n % 100) % 100)) u(r)"


def _on_series(f) -> object:
    return lambda spark, sf_dir: _out(f(_series(spark, sf_dir)))


def _series_sql(expr: str, where: str = "true", i: str = "i0") -> str:
    return f"WITH t AS ({_SERIES}) SELECT * FROM (SELECT CAST({i} AS BIGINT) AS i0, round(CAST({expr} AS DOUBLE), 4) AS x FROM t WHERE {where} WINDOW w AS (ORDER BY i0))"


SERIES: dict[str, tuple[object, str]] = {
    "cumsum": (lambda a: a.cumsum(), _series_sql("sum(x) OVER w")),
    "cumprod": (lambda a: a.apply(lambda x: 1 + x / 1e9).cumprod(), _series_sql("exp(sum(ln(1 + x / 1e9)) OVER w)")),
    "nancumsum": (lambda a: a.apply(lambda x: F.when(x < 5e4, 0.0).otherwise(x)).cumsum(), _series_sql("sum(CASE WHEN x < 5e4 THEN 0 ELSE x END) OVER w")),
    "maximum_accumulate": (lambda a: a.maximum_accumulate(), _series_sql("max(x) OVER w")),
    "diff": (lambda a: a.diff(), f"WITH t AS ({_SERIES}) SELECT i0, round(d, 4) AS x FROM (SELECT i0, lead(x) OVER (ORDER BY i0) - x AS d FROM t) WHERE d IS NOT NULL"),
    "diff2": (lambda a: a.diff(2), f"WITH t AS ({_SERIES}) SELECT i0, round(d, 4) AS x FROM (SELECT i0, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d FROM t WINDOW w AS (ORDER BY i0)) WHERE d IS NOT NULL"),
    "gradient": (lambda a: a.gradient(), _series_sql("CASE WHEN i0 = 0 THEN lead(x) OVER w - x WHEN i0 = n - 1 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END")),
    "cumulative_trapezoid": (
        lambda a: a.cumulative_trapezoid(),
        f"WITH t AS ({_SERIES}), h AS (SELECT i0, (x + lead(x) OVER (ORDER BY i0)) / 2 AS d FROM t) SELECT i0, round(sum(d) OVER (ORDER BY i0), 4) AS x FROM h WHERE d IS NOT NULL",
    ),
    "sort": (lambda a: a.sort(), f"WITH t AS ({_SERIES}) SELECT row_number() OVER (ORDER BY x, i0) - 1 AS i0, round(x, 4) AS x FROM t"),
    "argsort": (lambda a: a.argsort(), f"WITH t AS ({_SERIES}) SELECT row_number() OVER (ORDER BY x, i0) - 1 AS i0, CAST(i0 AS DOUBLE) AS x FROM t"),
    "partition": (lambda a: a.partition(10, ordered=True), f"WITH t AS ({_SERIES}) SELECT row_number() OVER (ORDER BY x, i0) - 1 AS i0, round(x, 4) AS x FROM t"),
    "partition_kth": (
        lambda a: a.partition(a.size // 3),
        f"WITH t AS ({_SERIES}), v AS (SELECT x AS v FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, n FROM t) WHERE r = n // 3) SELECT row_number() OVER (ORDER BY x >= v, x > v, i0) - 1 AS i0, round(x, 4) AS x FROM t, v",
    ),
    "flip": (lambda a: a.flip(), _series_sql("x", i="n - 1 - i0")),
    "roll": (lambda a: a.roll(5), _series_sql("x", i="(i0 + 5) % n")),
    "repeat": (lambda a: a.repeat(2), f"WITH t AS ({_SERIES}) SELECT i0 * 2 + r AS i0, round(x, 4) AS x FROM t, (VALUES (0), (1)) v(r)"),
    "tile": (lambda a: a.tile(2), f"WITH t AS ({_SERIES}) SELECT i0 + r * n AS i0, round(x, 4) AS x FROM t, (VALUES (0), (1)) v(r)"),
    "slice": (lambda a: a[10:-10:3], _series_sql("x", "i0 >= 10 AND i0 < n - 10 AND (i0 - 10) % 3 = 0", "(i0 - 10) // 3")),
    "slice_back": (lambda a: a[::-2], _series_sql("x", "(n - 1 - i0) % 2 = 0", "(n - 1 - i0) // 2")),
    "mask_select": (lambda a: a[a > 2e5], f"WITH t AS ({_SERIES}) SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, round(x, 4) AS x FROM t WHERE x > 2e5"),
    "flatnonzero": (lambda a: a.apply(lambda x: (x > 4e5).cast("double")).flatnonzero(), f"WITH t AS ({_SERIES}) SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, CAST(i0 AS DOUBLE) AS x FROM t WHERE x > 4e5"),
    "delete": (lambda a: a.delete([0, 7, -1]), _series_sql("x", "i0 NOT IN (0, 7, n - 1)", "i0 - 1 - CASE WHEN i0 > 7 THEN 1 ELSE 0 END")),
    "append": (lambda a: G.append(a, a), f"WITH t AS ({_SERIES}) SELECT i0 + r * n AS i0, round(x, 4) AS x FROM t, (VALUES (0), (1)) v(r)"),
    "insert": (lambda a: a.insert(3, a[:2]), f"WITH t AS ({_SERIES}) SELECT CASE WHEN i0 < 3 THEN i0 ELSE i0 + 2 END AS i0, round(x, 4) AS x FROM t UNION ALL SELECT i0 + 3, round(x, 4) FROM t WHERE i0 < 2"),
    "take": (lambda a: a.take(G.arange(a.df.sparkSession, 0, a.size, 7)), f"WITH t AS ({_SERIES}) SELECT i0 // 7 AS i0, round(x, 4) AS x FROM t WHERE i0 % 7 = 0"),
    "where": (lambda a: G.where(a > 2e5, a, -1.0), _series_sql("CASE WHEN x > 2e5 THEN x ELSE -1 END")),
    "select": (lambda a: G.select([a > 3e5, a > 1e5], [a, 1.0], 0.0), _series_sql("CASE WHEN x > 3e5 THEN x WHEN x > 1e5 THEN 1 ELSE 0 END")),
    "choose": (lambda a: G.choose(a.apply(lambda x: F.floor(x / 1e4) % 3), [a, 0.0, a]), _series_sql("CASE CAST(floor(x / 1e4) AS BIGINT) % 3 WHEN 1 THEN 0 ELSE x END")),
    "piecewise": (lambda a: G.piecewise(a, [a > 1e5, a > 3e5], [lambda x: x / 2, 0.0], 1.0), _series_sql("CASE WHEN x > 3e5 THEN 0 WHEN x > 1e5 THEN x / 2 ELSE 1 END")),
    "put": (lambda a: a.set(slice(2, 5), 0.0), _series_sql("CASE WHEN i0 BETWEEN 2 AND 4 THEN 0 ELSE x END")),
    "putmask": (lambda a: a.putmask(a > 1e5, 7.0), _series_sql("CASE WHEN x > 1e5 THEN 7 ELSE x END")),
    "reshape": (lambda a: grid(a), f"SELECT i AS i0, j AS i1, round(x, 4) AS x FROM ({grid_sql()})"),
    "transpose": (lambda a: grid(a).T, f"SELECT j AS i0, i AS i1, round(x, 4) AS x FROM ({grid_sql()})"),
    "rot90": (lambda a: grid(a).rot90(), f"SELECT 99 - j AS i0, i AS i1, round(x, 4) AS x FROM ({grid_sql()})"),
    "sum_axis0": (lambda a: grid(a).sum(0), f"SELECT j AS i0, round(sum(x), 4) AS x FROM ({grid_sql()}) GROUP BY 1"),
    "argmax_axis1": (lambda a: grid(a).argmax(1), f"SELECT i AS i0, CAST(arg_max(j, x) AS DOUBLE) AS x FROM ({grid_sql()}) GROUP BY 1"),
    "broadcast": (lambda a: (lambda g: g - g.mean(0))(grid(a)), f"SELECT i AS i0, j AS i1, round(x - avg(x) OVER (PARTITION BY j), 4) + 0.0 AS x FROM ({grid_sql()})"),
    "stack": (lambda a: G.stack([a, a * 2.0]), f"WITH t AS ({_SERIES}) SELECT CAST(r AS BIGINT) AS i0, i0 AS i1, round(x * (r + 1), 4) AS x FROM t, (VALUES (0), (1)) v(r)"),
    "split": (lambda a: G.array_split(a, 3)[1], f"WITH t AS ({_SERIES}) SELECT i0 - (n // 3 + CASE WHEN n % 3 > 0 THEN 1 ELSE 0 END) AS i0, round(x, 4) AS x FROM t WHERE i0 >= n // 3 + CASE WHEN n % 3 > 0 THEN 1 ELSE 0 END AND i0 < 2 * (n // 3) + least(n % 3, 2)"),
    "pad_edge": (lambda a: a.pad(2, 1, 0, "edge"), f"WITH t AS ({_SERIES}) SELECT i0 + 2 AS i0, round(x, 4) AS x FROM t UNION ALL SELECT r, round(x, 4) FROM t, (VALUES (0), (1)) v(r) WHERE i0 = 0 UNION ALL SELECT n + 2, round(x, 4) FROM t WHERE i0 = n - 1"),
    "pad_wrap": (lambda a: a.pad(2, 0, 0, "wrap"), f"WITH t AS ({_SERIES}) SELECT i0 + 2 AS i0, round(x, 4) AS x FROM t UNION ALL SELECT i0 - n + 2, round(x, 4) FROM t WHERE i0 >= n - 2"),
    "sliding_window_view": (lambda a: a.sliding_window_view(3).mean(1), f"WITH t AS ({_SERIES}) SELECT i0, round(m, 4) AS x FROM (SELECT i0, n, avg(x) OVER (ORDER BY i0 ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM t) WHERE i0 <= n - 3"),
    "convolve": (
        lambda a: FT.convolve(a, [0.25, 0.5, 0.25]),
        f"WITH t AS ({_SERIES}) SELECT i0 + j AS i0, round(sum(x * w), 4) AS x FROM t, (VALUES (0, 0.25), (1, 0.5), (2, 0.25)) k(j, w) GROUP BY 1",
    ),
    "correlate": (lambda a: FT.correlate(a, [1.0, -1.0], "full"), f"WITH t AS ({_SERIES}) SELECT i0 + j AS i0, round(sum(x * w), 4) AS x FROM t, (VALUES (0, -1.0), (1, 1.0)) k(j, w) GROUP BY 1"),
    "add_reduceat": (lambda a: a.add_reduceat([0, 100, 250]), f"WITH t AS ({_SERIES}) SELECT CAST(CASE WHEN i0 < 100 THEN 0 WHEN i0 < 250 THEN 1 ELSE 2 END AS BIGINT) AS i0, round(sum(x), 4) AS x FROM t GROUP BY 1"),
    "ufunc_outer": (lambda a: UF.UFUNCS["subtract"].outer(a, G.arange(a.df.sparkSession, 4)), f"WITH t AS ({_SERIES}) SELECT i0, CAST(k AS BIGINT) AS i1, round(x - k, 4) AS x FROM t, unnest(range(4)) u(k)"),
    "ufunc_where": (lambda a: UF.UFUNCS["sqrt"](a, where_=a > 1e5, out=a), _series_sql("CASE WHEN x > 1e5 THEN sqrt(x) ELSE x END")),
    "ma_masked_where": (lambda a: M.masked_greater(a, 2e5), _series_sql("CASE WHEN x > 2e5 THEN NULL ELSE x END")),
    "ma_filled": (lambda a: M.filled(M.masked_less(a, 1e5), -1.0), _series_sql("CASE WHEN x < 1e5 THEN -1 ELSE x END")),
    "ma_compressed": (lambda a: M.masked_inside(a, 1e5, 3e5).compressed(), f"WITH t AS ({_SERIES}) SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, round(x, 4) AS x FROM t WHERE x < 1e5 OR x > 3e5"),
    "ma_log": (lambda a: M.log(a - 1e5), _series_sql("CASE WHEN x > 1e5 THEN ln(x - 1e5) END")),
    "ma_divide": (lambda a: M.divide(a, a.apply(lambda x: F.floor(x) % 2)), _series_sql("CASE WHEN CAST(floor(x) AS BIGINT) % 2 <> 0 THEN x END")),
    "ma_anom": (lambda a: M.masked_greater(a, 2e5).anom(), f"WITH t AS ({_SERIES}) SELECT i0, round(CASE WHEN x <= 2e5 THEN x - (SELECT avg(x) FROM t WHERE x <= 2e5) END, 4) AS x FROM t"),
    "ma_cumsum": (lambda a: M.masked_greater(a, 2e5).cumsum(), _series_sql("CASE WHEN x <= 2e5 THEN sum(CASE WHEN x <= 2e5 THEN x END) OVER w END")),
    "fftshift": (lambda a: FT.fftshift(a), _series_sql("x", i="(i0 + n // 2) % n")),
    "ifftshift": (lambda a: FT.ifftshift(a), _series_sql("x", i="(i0 - n // 2 + n) % n")),
}


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _embedding(spark: SparkSession, sf_dir: str) -> GridArray:
    df = table(spark, sf_dir, "embeddings")
    return G.from_rows(df, "embedding", "vec_id", df.count(), 64)


_EMB = "SELECT vec_id AS i, CAST(unnest(range(64)) AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


def _tenths(spark: SparkSession) -> GridArray:
    """3 x 64 cells: the row and the tenth of the column."""
    return G.fromfunction(spark, lambda i, j: i + j / 10, [3, 64])


def _clumps(spark, sf_dir):
    return M.clump_unmasked(M.masked_greater(_series(spark, sf_dir), 2e5))


def _lstsq(spark, sf_dir):
    rows = _lineitem(spark, sf_dir)
    return L.lstsq(rows, [F.lit(1.0), F.col("l_quantity")], F.col("l_extendedprice")).select("term", F.round("coefficient", 4).alias("coefficient"))


def _interp(spark, sf_dir):
    knots = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("xp")).agg(F.avg("p_retailprice").alias("fp"))
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return B.interp(rows, "value", knots, "xp", "fp").select("event_id", F.round("interp", 2).alias("interp"))


_KNOTS = "SELECT CAST(p_size AS DOUBLE) AS xp, avg(p_retailprice) AS fp FROM part GROUP BY 1"
_INTERP = f"""
WITH k AS (SELECT xp, fp, lead(xp) OVER (ORDER BY xp) AS x1, lead(fp) OVER (ORDER BY xp) AS f1 FROM ({_KNOTS})),
     e AS (SELECT min_by(fp, xp) AS f_first FROM k)
SELECT event_id, round(CASE WHEN xp IS NULL THEN f_first WHEN x1 IS NULL THEN fp ELSE fp + (f1 - fp) * (value - xp) / (x1 - xp) END, 2) AS interp
FROM events ASOF LEFT JOIN k ON events.value >= k.xp, e
"""

_VAL = "1 + 2 * {0} + 3 * {1} + 4 * {2}"
#: P_1 .. P_3 of each basis in SQL over x.
_POLY = {
    "polynomial": ("x", "x * x", "x * x * x"),
    "chebyshev": ("x", "(2 * x * x - 1)", "(4 * x * x * x - 3 * x)"),
    "legendre": ("x", "((3 * x * x - 1) / 2)", "((5 * x * x * x - 3 * x) / 2)"),
    "hermite": ("(2 * x)", "(4 * x * x - 2)", "(8 * x * x * x - 12 * x)"),
    "hermite_e": ("x", "(x * x - 1)", "(x * x * x - 3 * x)"),
    "laguerre": ("(1 - x)", "((x * x - 4 * x + 2) / 2)", "((-x * x * x + 9 * x * x - 18 * x + 6) / 6)"),
}
_PX = "SELECT o_orderkey, o_totalprice / 1e6 AS x FROM orders"


def _px(make, digits: int = 6):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("x"))
        return rows.select("o_orderkey", (F.round(make(), digits) + F.lit(0.0)).alias("value"))

    return query


def _px_sql(expr: str, digits: int = 6) -> str:
    return f"SELECT o_orderkey, round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS value FROM ({_PX})"


SAMPLERS = {
    "random": lambda g: g.random("i"), "uniform": lambda g: g.uniform("i", 2.0, 3.0), "integers": lambda g: g.integers("i", 1, 7), "standard_normal": lambda g: g.standard_normal("i"), "normal": lambda g: g.normal("i", 5.0, 2.0),
    "lognormal": lambda g: g.lognormal("i", 0.0, 0.5), "exponential": lambda g: g.exponential("i", 2.0), "weibull": lambda g: g.weibull("i", 2.0), "rayleigh": lambda g: g.rayleigh("i", 1.0), "power": lambda g: g.power("i", 3.0),
    "pareto": lambda g: g.pareto("i", 5.0), "laplace": lambda g: g.laplace("i"), "logistic": lambda g: g.logistic("i"), "gumbel": lambda g: g.gumbel("i"), "standard_cauchy": lambda g: F.atan(g.standard_cauchy("i")),
    "triangular": lambda g: g.triangular("i", 0.0, 1.0, 3.0), "geometric": lambda g: g.geometric("i", 0.3), "choice": lambda g: g.choice("i", [1, 2, 5], [0.2, 0.3, 0.5]), "poisson": lambda g: g.poisson("i", 4.0),
    "binomial": lambda g: g.binomial("i", 10, 0.3), "beta": lambda g: g.beta("i", 2.0, 3.0), "gamma": lambda g: g.gamma("i", 2.0, 1.5), "chisquare": lambda g: g.chisquare("i", 3.0), "f": lambda g: g.f("i", 5.0, 12.0),
    "standard_t": lambda g: g.standard_t("i", 8.0), "vonmises": lambda g: g.vonmises("i", 0.0, 2.0), "wald": lambda g: g.wald("i", 1.0, 2.0), "negative_binomial": lambda g: g.negative_binomial("i", 3, 0.4),
    "hypergeometric": lambda g: g.hypergeometric("i", 10, 15, 5), "logseries": lambda g: g.logseries("i", 0.5), "zipf": lambda g: F.least(g.zipf("i", 3.0), F.lit(1000)), "noncentral_chisquare": lambda g: g.noncentral_chisquare("i", 3.0, 1.0),
    "noncentral_f": lambda g: g.noncentral_f("i", 5.0, 12.0, 1.0), "multivariate_normal": lambda g: g.multivariate_normal("i", [0.0, 1.0], [[1.0, 0.5], [0.5, 2.0]])[1],
    "dirichlet": lambda g: g.dirichlet("i", [1.0, 2.0, 3.0])[0], "multinomial": lambda g: g.multinomial("i", 5, [0.2, 0.8])[1], "bytes": lambda g: F.octet_length(g.bytes("i", 4)), "standard_gamma": lambda g: g.standard_gamma("i", 2.0),
}


def _t(name):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def entries():
    found: dict[str, tuple[object, str | None]] = {
        "lane_cumsum": (_over_lane(lambda w: F.sum("value").over(w)), _lane_sql("sum(value) OVER w")),
        "lane_diff": (_over_lane(lambda w: F.col("value") - F.lag("value").over(w)), _lane_sql("value - lag(value) OVER w")),
        "lane_gradient": (
            _over_lane(lambda w: F.when(F.col("k") == 0, F.lead("value").over(w) - F.col("value")).when(F.col("k") == F.col("n") - 1, F.col("value") - F.lag("value").over(w)).otherwise((F.lead("value").over(w) - F.lag("value").over(w)) / 2)),
            _lane_sql("CASE WHEN k = 0 THEN lead(value) OVER w - value WHEN k = n - 1 THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END"),
        ),
        "lane_rank": (lambda s, d: _lanes(s, d).select("event_id", "k"), f"SELECT event_id, k FROM ({_LANES})"),
        "trapezoid": (lambda s, d: _out(_series(s, d).trapezoid()), f"WITH t AS ({_SERIES}) SELECT round(sum(CASE WHEN i0 = 0 OR i0 = n - 1 THEN x / 2 ELSE x END), 4) AS x FROM t"),
        "searchsorted": (
            lambda s, d: _out(_series(s, d).searchsorted(G.from_column(ranked(table(s, d, "events"), ["event_id"], "k"), F.col("value") * 1000, "k"))),
            "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, CAST((SELECT count(*) FROM orders o WHERE o.o_totalprice < e.value * 1000) AS DOUBLE) AS x FROM events e",
        ),
        "interp": (_interp, _INTERP),
        "digitize": (
            lambda s, d: _lineitem(s, d).groupBy(B.digitize("l_quantity", [5, 10, 20, 40]).cast("long").alias("bin")).agg(F.count("*").alias("n")),
            "SELECT CAST((l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
        ),
        "histogram": (
            lambda s, d: B.histogram(_lineitem(s, d), "l_quantity", 7, 1.0, 50.0).select("bin", "count"),
            "WITH b AS (SELECT unnest(range(7)) AS bin), c AS (SELECT least(floor((l_quantity - 1) / 7.0), 6) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bin)",
        ),
        "histogram_density": (
            lambda s, d: B.histogram(_lineitem(s, d), "l_quantity", [0.0, 10.0, 25.0, 50.0], density=True).select("bin", F.round("count", 8).alias("density")),
            "SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS BIGINT) AS bin, round(count(*) / (SELECT count(*) FROM lineitem) / max(CASE WHEN l_quantity < 10 THEN 10.0 WHEN l_quantity < 25 THEN 15.0 ELSE 25.0 END), 8) AS density FROM lineitem GROUP BY 1",
        ),
        "histogram_weights": (
            lambda s, d: B.histogram(_lineitem(s, d), "l_discount", 4, 0.0, 0.12, "l_quantity").select("bin", F.round("count", 4).alias("count")),
            "WITH b AS (SELECT unnest(range(4)) AS bin), c AS (SELECT least(floor((l_discount - 0.0) / 0.03), 3) AS bin, sum(l_quantity) AS n FROM lineitem GROUP BY 1) SELECT b.bin, round(coalesce(n, 0), 4) AS count FROM b LEFT JOIN c USING (bin)",
        ),
        "histogram_bin_edges": (
            lambda s, d: s.createDataFrame([(k, round(e, 6)) for k, e in enumerate(B.histogram_bin_edges(_lineitem(s, d), "l_quantity", "sturges"))], "k long, edge double"),
            "WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(ceil((log2(count(*)) + 1)) AS BIGINT) AS n FROM lineitem) SELECT k, round(lo + k * (hi - lo) / n, 6) AS edge FROM r, unnest(range(n + 1)) u(k)",
        ),
        "histogram2d": (
            lambda s, d: B.histogram2d(_lineitem(s, d), "l_quantity", "l_tax", (5, 2), ((0.0, 50.0), (0.0, 0.08))),
            "SELECT CAST(least(floor(l_quantity / 10.0), 4) AS BIGINT) AS b0, CAST(least(floor(l_tax / 0.04), 1) AS BIGINT) AS b1, count(*) AS count FROM lineitem GROUP BY 1, 2",
        ),
        "bincount": (
            lambda s, d: B.bincount(_lineitem(s, d), "l_linenumber", minlength=10),
            "WITH b AS (SELECT unnest(range(greatest(10, (SELECT max(l_linenumber) + 1 FROM lineitem)))) AS value), c AS (SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT b.value, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (value)",
        ),
        "unique": (lambda s, d: U.unique(table(s, d, "part"), "p_brand"), "SELECT DISTINCT p_brand AS x FROM part"),
        "unique_values": (lambda s, d: U.unique_values(_lineitem(s, d), "l_quantity"), "SELECT DISTINCT l_quantity AS x FROM lineitem"),
        "unique_counts": (lambda s, d: U.unique_counts(table(s, d, "part"), "p_brand"), "SELECT p_brand AS x, count(*) AS count FROM part GROUP BY 1"),
        "unique_all": (lambda s, d: U.unique_all(table(s, d, "part"), "p_brand", "p_partkey"), "SELECT p_brand AS x, min(p_partkey) AS index, count(*) AS count, row_number() OVER (ORDER BY p_brand) - 1 AS rank FROM part GROUP BY 1"),
        "unique_inverse": (lambda s, d: U.unique_inverse(table(s, d, "part"), "p_brand", "p_partkey").select("p_partkey", "inverse"), "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS inverse FROM part"),
        "union1d": (lambda s, d: U.union1d(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey"), "SELECT c_custkey AS x FROM customer UNION SELECT o_custkey FROM orders"),
        "intersect1d": (lambda s, d: U.intersect1d(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey"), "SELECT c_custkey AS x FROM customer INTERSECT SELECT o_custkey FROM orders"),
        "setdiff1d": (lambda s, d: U.setdiff1d(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey"), "SELECT c_custkey AS x FROM customer EXCEPT SELECT o_custkey FROM orders"),
        "setxor1d": (lambda s, d: U.setxor1d(table(s, d, "part"), "p_partkey", table(s, d, "orders"), "o_orderkey"), "(SELECT p_partkey AS x FROM part EXCEPT SELECT o_orderkey FROM orders) UNION ALL (SELECT o_orderkey FROM orders EXCEPT SELECT p_partkey FROM part)"),
        "isin": (lambda s, d: U.isin(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey").select("c_custkey", "isin"), "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS isin FROM customer"),
        "isin_invert": (lambda s, d: U.isin(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", invert=True).select("c_custkey", "isin"), "SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS isin FROM customer"),
        "lexsort": (
            lambda s, d: U.lexsort(table(s, d, "orders"), ("o_totalprice", "o_custkey"), "o_orderkey").select("o_orderkey", "place"),
            "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_totalprice, o_orderkey) - 1 AS place FROM orders",
        ),
        "top_k": (lambda s, d: U.partition_smallest(table(s, d, "orders"), "o_totalprice", "o_orderkey", 25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25"),
        "linalg_norm": (lambda s, d: _out(L.norm(_embedding(s, d), axis=1)), f"SELECT i AS i0, round(sqrt(sum(x * x)), 4) AS x FROM ({_EMB}) GROUP BY 1"),
        "linalg_norm_1": (lambda s, d: _out(L.norm(_embedding(s, d), 1, axis=1)), f"SELECT i AS i0, round(sum(abs(x)), 4) AS x FROM ({_EMB}) GROUP BY 1"),
        "linalg_norm_fro": (lambda s, d: _out(L.norm(_embedding(s, d))), f"SELECT round(sqrt(sum(x * x)), 4) AS x FROM ({_EMB})"),
        "linalg_norm_inf": (lambda s, d: _out(L.norm(_embedding(s, d), float("inf"))), f"SELECT round(max(v), 4) AS x FROM (SELECT i, sum(abs(x)) AS v FROM ({_EMB}) GROUP BY 1)"),
        "matmul_gram": (lambda s, d: _out((lambda e: e.T @ e)(_embedding(s, d))), f"WITH e AS ({_EMB}) SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x), 4) AS x FROM e a JOIN e b USING (i) GROUP BY 1, 2"),
        "dot": (lambda s, d: _out(L.dot(_embedding(s, d), _embedding(s, d)[0])), f"WITH e AS ({_EMB}) SELECT a.i AS i0, round(sum(a.x * b.x), 4) AS x FROM e a JOIN e b ON a.j = b.j AND b.i = 0 GROUP BY 1"),
        "inner": (lambda s, d: _out(L.inner(_embedding(s, d), _tenths(s))), f"WITH e AS ({_EMB}) SELECT i AS i0, CAST(k AS BIGINT) AS i1, round(sum(x * (k + j / 10.0)), 4) AS x FROM e, unnest(range(3)) u(k) GROUP BY 1, 2"),
        "outer": (lambda s, d: _out(L.outer(_embedding(s, d)[0], _embedding(s, d)[1])), f"WITH e AS ({_EMB}) SELECT a.j AS i0, b.j AS i1, round(a.x * b.x, 4) AS x FROM e a, e b WHERE a.i = 0 AND b.i = 1"),
        "vdot": (lambda s, d: _out(L.vdot(_embedding(s, d), _embedding(s, d))), f"SELECT round(sum(x * x), 4) AS x FROM ({_EMB})"),
        "einsum": (lambda s, d: _out(L.einsum("ij,ij,j->i", _embedding(s, d), _embedding(s, d), _embedding(s, d)[0])), f"WITH e AS ({_EMB}) SELECT a.i AS i0, round(sum(a.x * a.x * b.x), 4) AS x FROM e a JOIN e b ON a.j = b.j AND b.i = 0 GROUP BY 1"),
        "tensordot": (lambda s, d: _out(L.tensordot(_embedding(s, d), _embedding(s, d), ([0], [0]))), f"WITH e AS ({_EMB}) SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x), 4) AS x FROM e a JOIN e b USING (i) GROUP BY 1, 2"),
        "kron": (lambda s, d: _out(L.kron(_embedding(s, d), G.array(s, [[1.0, 2.0], [3.0, 4.0]]))), f"WITH e AS ({_EMB}) SELECT i * 2 + p AS i0, j * 2 + q AS i1, round(x * (1 + q + 2 * p), 4) AS x FROM e, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(p, q)"),
        "cross": (
            lambda s, d: _out(L.cross(_embedding(s, d)[:, :3], _embedding(s, d)[:, 3:6])),
            "SELECT vec_id AS i0, CAST(k AS BIGINT) AS i1, round(e[(k + 1) % 3 + 1] * e[(k + 2) % 3 + 4] - e[(k + 2) % 3 + 1] * e[(k + 1) % 3 + 4], 4) + 0.0 AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), unnest(range(3)) u(k)",
        ),
        "trace": (lambda s, d: _out(_embedding(s, d).trace()), f"SELECT round(sum(x), 4) AS x FROM ({_EMB}) WHERE i = j"),
        "diagonal": (lambda s, d: _out(_embedding(s, d).diagonal(2)), f"SELECT i AS i0, round(x, 4) AS x FROM ({_EMB}) WHERE j = i + 2"),
        "tril": (lambda s, d: _out(_embedding(s, d).tril()), f"SELECT i AS i0, j AS i1, round(CASE WHEN j <= i THEN x ELSE 0 END, 4) AS x FROM ({_EMB})"),
        "triu": (lambda s, d: _out(_embedding(s, d).triu(1)), f"SELECT i AS i0, j AS i1, round(CASE WHEN j > i THEN x ELSE 0 END, 4) AS x FROM ({_EMB})"),
        "lstsq": (_lstsq, "SELECT 0::BIGINT AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 1, round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem"),
        "polyfit": (lambda s, d: P.polyfit(_lineitem(s, d), "l_quantity", "l_extendedprice", 1).select("power", F.round("coefficient", 4).alias("coefficient")), "SELECT 0::BIGINT AS power, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 1, round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem"),
        "polyval": (_px(lambda: P.polyval([4, 3, 2, 1], "x")), _px_sql(_VAL.format(*_POLY["polynomial"]))),
        "valfromroots": (_px(lambda: P.valfromroots("x", [1.0, -2.0])), _px_sql("(x - 1) * (x + 2)")),
        "val2d": (_px(lambda: P.val2d("x", F.col("x") * 2, [[1, 2], [3, 4]])), _px_sql("1 + 2 * (2 * x) + 3 * x + 4 * x * (2 * x)")),
        "clump_unmasked": (_clumps, f"WITH t AS ({_SERIES}), m AS (SELECT i0, i0 - row_number() OVER (ORDER BY i0) AS g FROM t WHERE x <= 2e5) SELECT min(i0) AS start, max(i0) + 1 AS stop FROM m GROUP BY g"),
        "notmasked_edges": (lambda s, d: M.flatnotmasked_edges(M.masked_greater(_series(s, d), 2e5)), f"WITH t AS ({_SERIES}) SELECT min(i0) AS first, max(i0) AS last FROM t WHERE x <= 2e5"),
        "linspace": (lambda s, d: _out(G.linspace(s, 0.0, 1.0, 11)), "SELECT CAST(k AS BIGINT) AS i0, round(k / 10.0, 4) AS x FROM unnest(range(11)) u(k)"),
        "arange": (lambda s, d: _out(G.arange(s, 3, 30, 4)), "SELECT CAST((k - 3) // 4 AS BIGINT) AS i0, CAST(k AS DOUBLE) AS x FROM unnest(range(3, 30, 4)) u(k)"),
        "logspace": (lambda s, d: _out(G.logspace(s, 0.0, 2.0, 5)), "SELECT CAST(k AS BIGINT) AS i0, round(pow(10.0, k / 2.0), 4) AS x FROM unnest(range(5)) u(k)"),
        "eye": (lambda s, d: _out(G.eye(s, 4, 5, 1)), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CASE WHEN j - i = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM unnest(range(4)) a(i), unnest(range(5)) b(j)"),
        "tri": (lambda s, d: _out(G.tri(s, 4)), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CASE WHEN j <= i THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM unnest(range(4)) a(i), unnest(range(4)) b(j)"),
        "hanning": (lambda s, d: _out(FT.hanning(s, 32)), "SELECT CAST(k AS BIGINT) AS i0, round(0.5 - 0.5 * cos(2 * pi() * k / 31), 4) AS x FROM unnest(range(32)) u(k)"),
        "hamming": (lambda s, d: _out(FT.hamming(s, 32)), "SELECT CAST(k AS BIGINT) AS i0, round(0.54 - 0.46 * cos(2 * pi() * k / 31), 4) AS x FROM unnest(range(32)) u(k)"),
        "blackman": (lambda s, d: _out(FT.blackman(s, 32).apply(lambda x: x + 1.0)), "SELECT CAST(k AS BIGINT) AS i0, round(1.42 - 0.5 * cos(2 * pi() * k / 31) + 0.08 * cos(4 * pi() * k / 31), 4) AS x FROM unnest(range(32)) u(k)"),
        "bartlett": (lambda s, d: _out(FT.bartlett(s, 32)), "SELECT CAST(k AS BIGINT) AS i0, round(1 - abs(2.0 * k / 31 - 1), 4) AS x FROM unnest(range(32)) u(k)"),
        "fft_round_trip": (lambda s, d: _out(FT.irfft(FT.rfft(_embedding(s, d)))), f"SELECT i AS i0, j AS i1, round(x, 4) + 0.0 AS x FROM ({_EMB})"),
        "fftfreq": (lambda s, d: _out(FT.fftfreq(s, 9)), "SELECT CAST(k AS BIGINT) AS i0, round((CASE WHEN k < 5 THEN k ELSE k - 9 END) / 9.0, 4) AS x FROM unnest(range(9)) u(k)"),
        "inv": (lambda s, d: _out((lambda g: L.inv(g) @ g)(_gram(s, d))), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM unnest(range(64)) a(i), unnest(range(64)) b(j)"),
        "svdvals": (lambda s, d: _out(L.svdvals(_gram(s, d)).apply(lambda x: x * x).sum()), f"WITH e AS ({_EMB}), g AS (SELECT a.j, b.j AS k, sum(a.x * b.x) AS x FROM e a JOIN e b USING (i) GROUP BY 1, 2) SELECT round(sum(x * x), 4) AS x FROM g"),
        "eigvalsh": (lambda s, d: _out(L.eigvalsh(_gram(s, d)).sum()), f"SELECT round(sum(x * x), 4) AS x FROM ({_EMB})"),
        "det": (lambda s, d: _out(L.det(_gram(s, d)[:2, :2])), f"WITH e AS ({_EMB}), m AS (SELECT sum(p.x * p.x) AS a, sum(p.x * q.x) AS b, sum(q.x * q.x) AS c FROM e p JOIN e q USING (i) WHERE p.j = 0 AND q.j = 1) SELECT round(a * c - b * b, 4) AS x FROM m"),
        "solve": (lambda s, d: _out((lambda g: g @ L.solve(g, g[0]))(_gram(s, d))), f"WITH e AS ({_EMB}) SELECT b.j AS i0, round(sum(a.x * b.x), 4) AS x FROM e a JOIN e b USING (i) WHERE a.j = 0 GROUP BY 1"),
        "cholesky": (lambda s, d: _out((lambda c: c @ c.T)(L.cholesky(_gram(s, d)))), f"WITH e AS ({_EMB}) SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x), 4) AS x FROM e a JOIN e b USING (i) GROUP BY 1, 2"),
        "qr": (lambda s, d: _out((lambda q: q[0] @ q[1])(L.qr(_gram(s, d)))), f"WITH e AS ({_EMB}) SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x), 4) AS x FROM e a JOIN e b USING (i) GROUP BY 1, 2"),
        "apply_along_axis": (lambda s, d: _out(UF.apply_along_axis(lambda v: float((v**2).sum()), 1, _embedding(s, d))), f"SELECT i AS i0, round(sum(x * x), 4) AS x FROM ({_EMB}) GROUP BY 1"),
        "vectorize": (lambda s, d: table(s, d, "orders").select("o_orderkey", UF.vectorize(lambda a, b: a * 2 + b, "long")("o_orderkey", "o_custkey").alias("value")), "SELECT o_orderkey, o_orderkey * 2 + o_custkey AS value FROM orders"),
    }
    for name, (f, sql) in SERIES.items():
        found[f"array_{name}"] = _on_series(f), sql
    for kind, terms in _POLY.items():
        found[f"polynomial_{kind}_val"] = _px(lambda kind=kind: P.val("x", [1, 2, 3, 4], kind)), _px_sql(_VAL.format(*terms))
        found[f"polynomial_{kind}_vander"] = _px(lambda kind=kind: P.vander("x", 3, kind)[3]), _px_sql(terms[2])
    return found


def _gram(spark: SparkSession, sf_dir: str) -> GridArray:
    e = _embedding(spark, sf_dir)
    return e.T @ e
