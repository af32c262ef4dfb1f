"""Elementwise functions over every row of lineitem, each with its SQL."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.functions import elementwise as E
from gridspan.functions.semantics import NAN
from gridspan.session import table

KEY = ["l_orderkey", "l_partkey", "l_extendedprice"]

#: Inputs: x in -2.4 .. 2.5, u in 0 .. 1, w with zeros, z with NaN, m with NULL, whole numbers i and j, booleans by comparison.
_INPUTS = """
SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity AS q, l_linenumber AS n, l_discount AS d, l_tax AS t,
       (l_quantity - 25) / 10.0 AS x, l_discount * 10 AS u, CAST(l_linenumber - 3 AS DOUBLE) AS w,
       CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE (l_quantity - 25) / 10.0 END AS z,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE (l_quantity - 25) / 10.0 END AS m,
       CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j
FROM lineitem
"""


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    x = (q - 25) / 10.0
    return table(spark, sf_dir, "lineitem").select(
        *KEY, q.alias("q"), F.col("l_linenumber").alias("n"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), x.alias("x"), (F.col("l_discount") * 10).alias("u"),
        (F.col("l_linenumber") - 3).cast("double").alias("w"), F.when(F.col("l_linenumber") == 3, NAN).otherwise(x).alias("z"), F.when(F.col("l_linenumber") != 4, x).alias("m"),
        F.col("l_partkey").cast("long").alias("i"), F.col("l_suppkey").cast("long").alias("j"),
    )


_FLOOR = "floor({0} / {1})"
_MOD = "({0} - floor({0} / {1}) * {1})"
_NN = "CASE WHEN isnan({0}) OR isnan({1}) THEN false ELSE {0} {2} {1} END"
_TRUE = "(isnan({0}) OR {0} <> 0)"


def _cmp(op: str) -> str:
    return _NN.format("z", "w", op)


#: Name to (expression, SQL): doubles, rounded on both sides.
DOUBLES: dict[str, tuple[Column | object, str]] = {
    "add": (lambda: E.add("q", "x"), "q + x"),
    "subtract": (lambda: E.subtract("q", "x"), "q - x"),
    "multiply": (lambda: E.multiply("q", "x"), "q * x"),
    "divide": (lambda: E.divide("x", "w"), "x / w"),
    "true_divide": (lambda: E.true_divide("q", "x"), "q / x"),
    "floor_divide": (lambda: E.floor_divide("q", F.lit(-7.0)), _FLOOR.format("q", "-7.0")),
    "remainder": (lambda: E.remainder(F.col("q") - 25, F.lit(7.0)), _MOD.format("(q - 25)", "7.0")),
    "remainder_negative": (lambda: E.remainder("q", F.lit(-7.0)), _MOD.format("q", "-7.0")),
    "fmod": (lambda: E.fmod(F.col("q") - 25, F.lit(7.0)), "(q - 25) - trunc((q - 25) / 7.0) * 7.0"),
    "divmod_quotient": (lambda: E.divmod_("q", F.lit(4.0))["quotient"], _FLOOR.format("q", "4.0")),
    "divmod_remainder": (lambda: E.divmod_("q", F.lit(4.0))["remainder"], _MOD.format("q", "4.0")),
    "negative": (lambda: E.negative("x"), "-x"),
    "positive": (lambda: E.positive("x"), "+x"),
    "power": (lambda: E.power("q", F.lit(1.5)), "pow(q, 1.5)"),
    "float_power": (lambda: E.float_power("q", "x"), "pow(q, x)"),
    "square": (lambda: E.square("x"), "x * x"),
    "reciprocal": (lambda: E.reciprocal("q"), "1.0 / q"),
    "abs": (lambda: E.abs_("x"), "abs(x)"),
    "fabs": (lambda: E.fabs("x"), "abs(x)"),
    "sign": (lambda: E.sign("x"), "CAST(sign(x) AS DOUBLE)"),
    "sqrt": (lambda: E.sqrt("q"), "sqrt(q)"),
    "cbrt": (lambda: E.cbrt("x"), "cbrt(x)"),
    "exp": (lambda: E.exp("x"), "exp(x)"),
    "exp2": (lambda: E.exp2("x"), "pow(2.0, x)"),
    "expm1": (lambda: E.expm1("x"), "exp(x) - 1"),
    "log": (lambda: E.log("q"), "ln(q)"),
    "log_of_zero": (lambda: E.log("u"), "CASE WHEN u = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ln(CASE WHEN u > 0 THEN u END) END"),
    "log2": (lambda: E.log2("q"), "log2(q)"),
    "log10": (lambda: E.log10("q"), "log10(q)"),
    "log1p": (lambda: E.log1p("u"), "ln(1 + u)"),
    "logaddexp": (lambda: E.logaddexp("x", "u"), "ln(exp(x) + exp(u))"),
    "logaddexp2": (lambda: E.logaddexp2("x", "u"), "log2(pow(2.0, x) + pow(2.0, u))"),
    "sin": (lambda: E.sin("x"), "sin(x)"),
    "cos": (lambda: E.cos("x"), "cos(x)"),
    "tan": (lambda: E.tan("u"), "tan(u)"),
    "arcsin": (lambda: E.arcsin("u"), "asin(least(u, 1.0))"),
    "arccos": (lambda: E.arccos("u"), "acos(least(u, 1.0))"),
    "arctan": (lambda: E.arctan("x"), "atan(x)"),
    "arctan2": (lambda: E.arctan2("x", "u"), "atan2(x, u)"),
    "sinh": (lambda: E.sinh("x"), "(exp(x) - exp(-x)) / 2"),
    "cosh": (lambda: E.cosh("x"), "(exp(x) + exp(-x)) / 2"),
    "tanh": (lambda: E.tanh("x"), "(exp(2 * x) - 1) / (exp(2 * x) + 1)"),
    "arcsinh": (lambda: E.arcsinh("x"), "asinh(x)"),
    "arccosh": (lambda: E.arccosh("q"), "acosh(q)"),
    "arctanh": (lambda: E.arctanh(F.col("u") / 2), "atanh(u / 2)"),
    "hypot": (lambda: E.hypot("x", "u"), "sqrt(x * x + u * u)"),
    "deg2rad": (lambda: E.deg2rad("q"), "radians(q)"),
    "radians": (lambda: E.radians("x"), "radians(x)"),
    "rad2deg": (lambda: E.rad2deg("x"), "degrees(x)"),
    "degrees": (lambda: E.degrees("u"), "degrees(u)"),
    "sinc": (lambda: E.sinc("x"), "CASE WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) / (pi() * x) END"),
    "floor": (lambda: E.floor("x"), "floor(x)"),
    "ceil": (lambda: E.ceil("x"), "ceil(x)"),
    "trunc": (lambda: E.trunc("x"), "trunc(x)"),
    "fix": (lambda: E.fix("x"), "trunc(x)"),
    "rint": (lambda: E.rint(F.col("q") / 2), "round_even(q / 2, 0)"),
    "around": (lambda: E.around(F.col("q") / 2), "round_even(q / 2, 0)"),
    "around_tens": (lambda: E.around("q", -1), "round_even(q / 10.0, 0) * 10.0"),
    "modf_fraction": (lambda: E.modf("x")["fraction"], "x - trunc(x)"),
    "modf_whole": (lambda: E.modf("x")["whole"], "trunc(x)"),
    "frexp_mantissa": (lambda: E.frexp("q")["mantissa"], "q / pow(2.0, floor(log2(q)) + 1)"),
    "ldexp": (lambda: E.ldexp("x", "n"), "x * pow(2.0, n)"),
    "copysign": (lambda: E.copysign("q", "x"), "CASE WHEN x < 0 THEN -abs(q) ELSE abs(q) END"),
    "heaviside": (lambda: E.heaviside("x", F.lit(0.5)), "CASE WHEN x < 0 THEN 0.0 WHEN x > 0 THEN 1.0 ELSE 0.5 END::DOUBLE"),
    "clip": (lambda: E.clip("x", F.lit(-1.0), F.lit(1.5)), "least(greatest(x, -1.0), 1.5)"),
    "nan_to_num": (lambda: E.nan_to_num("z", 7.0), "CASE WHEN isnan(z) THEN 7.0 ELSE z END"),
    "maximum": (lambda: E.maximum("z", "u"), "CASE WHEN isnan(z) THEN z ELSE greatest(z, u) END"),
    "minimum": (lambda: E.minimum("z", "u"), "CASE WHEN isnan(z) THEN z ELSE least(z, u) END"),
    "fmax": (lambda: E.fmax("z", "u"), "CASE WHEN isnan(z) THEN u ELSE greatest(z, u) END"),
    "fmin": (lambda: E.fmin("z", "u"), "CASE WHEN isnan(z) THEN u ELSE least(z, u) END"),
    "real": (lambda: E.real(E.complex_("x", "u")), "x"),
    "imag": (lambda: E.imag(E.complex_("x", "u")), "u"),
    "conj": (lambda: E.conj(E.complex_("x", "u"))["im"], "-u"),
    "angle": (lambda: E.angle(E.complex_("x", "u")), "atan2(u, x)"),
    "complex_abs": (lambda: E.complex_abs(E.complex_("x", "u")), "sqrt(x * x + u * u)"),
    "complex_multiply": (lambda: E.complex_multiply(E.complex_("x", "u"), E.complex_("q", "x"))["re"], "x * q - u * x"),
    "complex_divide": (lambda: E.complex_divide(E.complex_("x", "u"), E.complex_("q", "x"))["im"], "(u * q - x * x) / (q * q + x * x)"),
    "complex_exp": (lambda: E.complex_exp(E.complex_("x", "u"))["re"], "exp(x) * cos(u)"),
    "real_if_close": (lambda: E.real_if_close(E.complex_("x", F.col("u") * 1e-16))["im"], "0.0"),
    "scimath_sqrt_im": (lambda: E.scimath_sqrt("x")["im"], "CASE WHEN x < 0 THEN sqrt(-x) ELSE 0.0 END"),
    "scimath_log_im": (lambda: E.scimath_log("x")["im"], "CASE WHEN x < 0 THEN pi() ELSE 0.0 END"),
    "scimath_log2_re": (lambda: E.scimath_log2(F.col("q") * -1)["re"], "log2(q)"),
    "scimath_log10_im": (lambda: E.scimath_log10(F.col("q") * -1)["im"], "pi() / ln(10) + 0 * q"),
    "scimath_power_re": (lambda: E.scimath_power(F.col("q") * -1, F.lit(0.25))["re"], "pow(q, 0.25) * cos(pi() / 4)"),
    "scimath_arccos_re": (lambda: E.scimath_arccos("q")["re"], "CASE WHEN q > 1 THEN 0.0 ELSE acos(CASE WHEN q <= 1 THEN q END) END"),
    "scimath_arcsin_im": (lambda: E.scimath_arcsin("q")["im"], "CASE WHEN q > 1 THEN -acosh(q) ELSE 0.0 END"),
    "masked_add": (lambda: E.add("m", "q"), "m + q"),
    "masked_maximum": (lambda: E.maximum("m", "u"), "CASE WHEN m IS NULL THEN NULL ELSE greatest(m, u) END"),
}
WHOLE: dict[str, tuple[object, str]] = {
    "gcd": (lambda: E.gcd("i", "j"), "gcd(i, j)"),
    "lcm": (lambda: E.lcm("i", "j"), "lcm(i, j)"),
    "frexp_exponent": (lambda: E.frexp("q")["exponent"], "floor(log2(q)) + 1"),
    "bitwise_and": (lambda: E.bitwise_and("i", "j"), "i & j"),
    "bitwise_or": (lambda: E.bitwise_or("i", "j"), "i | j"),
    "bitwise_xor": (lambda: E.bitwise_xor("i", "j"), "xor(i, j)"),
    "bitwise_not": (lambda: E.bitwise_not("i"), "~i"),
    "bitwise_count": (lambda: E.bitwise_count("i"), "bit_count(i)"),
    "left_shift": (lambda: E.left_shift("i", "n"), "i << n"),
    "right_shift": (lambda: E.right_shift("i", "n"), "i >> n"),
    "astype": (lambda: F.col("x").cast("long"), "trunc(x)"),
    "packbits": (lambda: E.packbits(F.array(*((F.shiftright("n", k) % 2) for k in range(8))))[0], "list_sum([((n >> k) % 2) * (1 << (7 - k)) for k in range(8)])"),
    "unpackbits": (lambda: E.unpackbits(F.array("n"))[6], "(n >> 1) % 2"),
}
LOGIC: dict[str, tuple[object, str]] = {
    "isnan": (lambda: E.isnan("z"), "isnan(z)"),
    "isfinite": (lambda: E.isfinite(E.divide("x", "w")), "isfinite(x / w)"),
    "isinf": (lambda: E.isinf(E.divide("x", "w")), "isinf(x / w)"),
    "isposinf": (lambda: E.isposinf(E.divide("x", "w")), "x / w = CAST('Infinity' AS DOUBLE)"),
    "isneginf": (lambda: E.isneginf(E.divide("x", "w")), "x / w = CAST('-Infinity' AS DOUBLE)"),
    "isreal": (lambda: E.isreal(E.complex_("x", "u")), "u = 0"),
    "iscomplex": (lambda: E.iscomplex(E.complex_("x", "u")), "u <> 0"),
    "signbit": (lambda: E.signbit("x"), "x < 0"),
    "equal": (lambda: E.equal("z", "w"), _cmp("=")),
    "not_equal": (lambda: E.not_equal("z", "w"), f"NOT ({_cmp('=')})"),
    "greater": (lambda: E.greater("z", "w"), _cmp(">")),
    "greater_equal": (lambda: E.greater_equal("z", "w"), _cmp(">=")),
    "less": (lambda: E.less("z", "w"), _cmp("<")),
    "less_equal": (lambda: E.less_equal("z", "w"), _cmp("<=")),
    "isclose": (lambda: E.isclose("x", "u", 0.1, 0.1), "abs(x - u) <= 0.1 + 0.1 * abs(u)"),
    "logical_and": (lambda: E.logical_and("z", "w"), f"{_TRUE.format('z')} AND {_TRUE.format('w')}"),
    "logical_or": (lambda: E.logical_or("z", "w"), f"{_TRUE.format('z')} OR {_TRUE.format('w')}"),
    "logical_xor": (lambda: E.logical_xor("z", "w"), f"{_TRUE.format('z')} <> {_TRUE.format('w')}"),
    "logical_not": (lambda: E.logical_not("z"), f"NOT {_TRUE.format('z')}"),
}
TEXT: dict[str, tuple[object, str]] = {
    "binary_repr": (lambda: E.binary_repr("i"), "bin(i)"),
    "base_repr": (lambda: E.base_repr("i", 16), "hex(i)"),
}


def entries():
    found = {}

    def add(name: str, make, sql: str, spark_kind: str, sql_kind: str) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            value = make()
            value = F.round(value.cast("double"), 6) if spark_kind == "double" else value.cast(spark_kind)
            return _inputs(spark, sf_dir).select(*KEY, value.alias("value"))

        told = f"round(CAST({sql} AS DOUBLE), 6)" if sql_kind == "DOUBLE" else f"CAST({sql} AS {sql_kind})"
        found[f"elementwise_{name}"] = query, f"WITH t AS ({_INPUTS}) SELECT {', '.join(KEY)}, {told} AS value FROM t"

    for kind, (spark_kind, sql_kind) in ((DOUBLES, ("double", "DOUBLE")), (WHOLE, ("long", "BIGINT")), (LOGIC, ("boolean", "BOOLEAN")), (TEXT, ("string", "VARCHAR"))):
        for name, (make, sql) in kind.items():
            add(name, make, sql, spark_kind, sql_kind)
    return found
