"""String and date functions over customers, parts and orders, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.functions import dates as D
from gridspan.functions import strings as S
from gridspan.session import table

_A = "p_type || ' ' || p_brand"


def _pad(n: str) -> str:
    return f"repeat('*', greatest(CAST({n} AS BIGINT), 0))"


#: Over a = p_type, a blank and p_brand; b = p_name. Result kind string, long or boolean.
STRINGS: dict[str, tuple[str, object, str]] = {
    "add": ("string", lambda: S.add("a", F.col("b")), "a || b"),
    "multiply": ("string", lambda: S.multiply("b", 2), "repeat(b, 2)"),
    "center": ("string", lambda: S.center("a", 31, "*"), f"CASE WHEN length(a) >= 31 THEN a ELSE {_pad('((31 - length(a)) // 2) + ((31 - length(a)) % 2)')} || a || {_pad('(31 - length(a)) // 2')} END"),
    "ljust": ("string", lambda: S.ljust("a", 30, "*"), f"a || {_pad('30 - length(a)')}"),
    "rjust": ("string", lambda: S.rjust("a", 30, "*"), f"{_pad('30 - length(a)')} || a"),
    "zfill": ("string", lambda: S.zfill(F.col("k").cast("string"), 8), "lpad(CAST(k AS VARCHAR), 8, '0')"),
    "upper": ("string", lambda: S.upper("a"), "upper(a)"),
    "lower": ("string", lambda: S.lower("a"), "lower(a)"),
    "swapcase": ("string", lambda: S.swapcase("a"), "translate(a, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"),
    "capitalize": ("string", lambda: S.capitalize("a"), "upper(a[1]) || lower(substr(a, 2))"),
    "title": ("string", lambda: S.title("a"), "list_aggregate([upper(w[1]) || lower(substr(w, 2)) for w in regexp_extract_all(a, '[A-Za-z]+|[^A-Za-z]+')], 'string_agg', '')"),
    "replace": ("string", lambda: S.replace("a", "a", "_"), "replace(a, 'a', '_')"),
    "replace_first": ("string", lambda: S.replace("a", "a", "_", 1), "regexp_replace(a, 'a', '_')"),
    "strip": ("string", lambda: S.strip(F.concat(F.lit("  "), "a", F.lit(" "))), "trim('  ' || a || ' ')"),
    "lstrip": ("string", lambda: S.lstrip("a", "PAES"), "ltrim(a, 'PAES')"),
    "rstrip": ("string", lambda: S.rstrip("a", "0123456789"), "rtrim(a, '0123456789')"),
    "split": ("string", lambda: S.split("a", " ")[1], "string_split(a, ' ')[2]"),
    "rsplit": ("string", lambda: S.rsplit("a", " ", 1)[0], "regexp_replace(a, ' [^ ]*$', '')"),
    "splitlines": ("string", lambda: S.splitlines(F.replace("a", F.lit(" "), F.lit("\n")))[0], "string_split(a, ' ')[1]"),
    "join": ("string", lambda: S.join("-", S.split("a", " ")), "replace(a, ' ', '-')"),
    "count": ("long", lambda: S.count("a", "a"), "length(a) - length(replace(a, 'a', ''))"),
    "find": ("long", lambda: S.find("a", "B"), "instr(a, 'B') - 1"),
    "rfind": ("long", lambda: S.rfind("a", "a"), "CASE WHEN instr(reverse(a), 'a') = 0 THEN -1 ELSE length(a) - instr(reverse(a), 'a') END"),
    "index": ("long", lambda: S.index("a", " "), "instr(a, ' ') - 1"),
    "rindex": ("long", lambda: S.rindex("a", " "), "length(a) - instr(reverse(a), ' ')"),
    "startswith": ("boolean", lambda: S.startswith("a", "S"), "starts_with(a, 'S')"),
    "endswith": ("boolean", lambda: S.endswith("a", "1"), "ends_with(a, '1')"),
    "encode": ("long", lambda: F.length(S.encode("a")), "strlen(a)"),
    "decode": ("string", lambda: S.decode(S.encode("a")), "a"),
    "isalpha": ("boolean", lambda: S.isalpha("b"), "regexp_full_match(b, '[A-Za-z]+')"),
    "isdigit": ("boolean", lambda: S.isdigit(F.col("k").cast("string")), "regexp_full_match(CAST(k AS VARCHAR), '[0-9]+')"),
    "isdecimal": ("boolean", lambda: S.isdecimal("a"), "regexp_full_match(a, '[0-9]+')"),
    "isnumeric": ("boolean", lambda: S.isnumeric(F.col("k").cast("string")), "regexp_full_match(CAST(k AS VARCHAR), '[0-9]+')"),
    "isalnum": ("boolean", lambda: S.isalnum("b"), "regexp_full_match(b, '[A-Za-z0-9]+')"),
    "isspace": ("boolean", lambda: S.isspace("a"), "regexp_full_match(a, '\\s+')"),
    "isupper": ("boolean", lambda: S.isupper("a"), "upper(a) = a AND regexp_matches(a, '[A-Z]')"),
    "islower": ("boolean", lambda: S.islower("b"), "lower(b) = b AND regexp_matches(b, '[a-z]')"),
    "istitle": ("boolean", lambda: S.istitle("b"), "regexp_matches(b, '[A-Z]') AND NOT regexp_matches(b, '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]')"),
    "partition": ("string", lambda: S.partition("a", " ")["tail"], "substr(a, instr(a, ' ') + 1)"),
    "rpartition": ("string", lambda: S.rpartition("a", " ")["head"], "regexp_replace(a, ' [^ ]*$', '')"),
    "expandtabs": ("string", lambda: S.expandtabs(F.replace("a", F.lit(" "), F.lit("\t")), 4), "CASE WHEN true THEN list_aggregate([CASE WHEN j < len(string_split(a, ' ')) THEN rpad(w, CAST((length(w) // 4 + 1) * 4 AS INTEGER), ' ') ELSE w END for w, j in string_split(a, ' ')], 'string_agg', '') END"),
    "mod": ("string", lambda: S.mod("%05d", F.col("k")), "printf('%05d', k)"),
    "equal": ("boolean", lambda: S.equal("a", F.concat("a", F.lit("  "))), "a = a"),
    "not_equal": ("boolean", lambda: S.not_equal("a", F.col("b")), "rtrim(a) <> rtrim(b)"),
    "greater": ("boolean", lambda: S.greater("a", F.col("b")), "rtrim(a) > rtrim(b)"),
    "greater_equal": ("boolean", lambda: S.greater_equal("a", F.col("b")), "rtrim(a) >= rtrim(b)"),
    "less": ("boolean", lambda: S.less("a", F.col("b")), "rtrim(a) < rtrim(b)"),
    "less_equal": ("boolean", lambda: S.less_equal("a", F.col("b")), "rtrim(a) <= rtrim(b)"),
    "compare_chararrays": ("boolean", lambda: S.compare_chararrays("a", F.col("b"), "<"), "rtrim(a) < rtrim(b)"),
    "str_len": ("long", lambda: S.str_len("a"), "length(a)"),
    "translate": ("string", lambda: S.translate("a", {"A": "4", "E": "3"}, "#"), "translate(a, 'AE#', '43')"),
    "format_float_scientific": ("string", lambda: S.format_float_scientific("k", 3), "printf('%.3e', CAST(k AS DOUBLE))"),
}
_HOLIDAYS = [date(1995, 5, 1), date(1996, 12, 25), date(1997, 1, 1)]
_BEFORE = "(floor(datediff('day', DATE '1970-01-05', {0}) / 7.0) * 5 + least(((datediff('day', DATE '1970-01-05', {0}) % 7) + 7) % 7, 5))"


_O = "CAST(o_orderdate AS DATE)"
_S = f"({_O} + CAST(o_custkey % 60 - 20 AS INTEGER))"
_BACK = f"CAST({_BEFORE.format(f'({_S} + 1)')} - {_BEFORE.format(f'({_O} + 1)')} AS BIGINT)"
_AHEAD = f"CAST({_BEFORE.format(_S)} - {_BEFORE.format(_O)} AS BIGINT)"
_FORWARD = f"({_O} + CASE isodow({_O}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)"


def _day():
    return F.col("o_orderdate").cast("date")


def _other():
    return F.date_add(_day(), (F.col("o_custkey") % 60 - 20).cast("int"))


DATES: dict[str, tuple[object, str]] = {
    "datetime64": (lambda: D.datetime64("o_orderdate", "M").cast("string"), f"CAST(CAST(date_trunc('month', {_O}) AS DATE) AS VARCHAR)"),
    "timedelta64": (lambda: D.timedelta64(_other(), _day(), "D").cast("long"), f"CAST(datediff('day', {_O}, {_S}) AS BIGINT)"),
    "isnat": (lambda: D.isnat(F.when(F.col("o_custkey") % 3 != 0, _day())), "o_custkey % 3 = 0"),
    "is_busday": (lambda: D.is_busday(_day()), f"isodow({_O}) <= 5"),
    "is_busday_holidays": (lambda: D.is_busday(_day(), D.busdaycalendar("1111100", _HOLIDAYS)), f"isodow({_O}) <= 5 AND {_O} NOT IN (DATE '1995-05-01', DATE '1996-12-25', DATE '1997-01-01')"),
    "busday_count": (lambda: D.busday_count(_day(), _other()), f"CASE WHEN {_S} >= {_O} THEN {_AHEAD} ELSE {_BACK} END"),
    "busday_offset": (lambda: D.busday_offset(_day(), 7, "forward").cast("string"), f"CAST({_FORWARD} + CASE WHEN isodow({_FORWARD}) + 2 > 5 THEN 11 ELSE 9 END AS VARCHAR)"),
    "busday_roll": (lambda: D.busday_offset(_day(), 0, "backward").cast("string"), f"CAST({_O} - CASE isodow({_O}) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS VARCHAR)"),
    "datetime_as_string": (lambda: D.datetime_as_string("o_orderdate", "s"), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
}
_KINDS = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN"}


def entries():
    found = {}
    for name, (kind, make, sql) in STRINGS.items():

        def query(spark: SparkSession, sf_dir: str, make=make, kind=kind) -> DataFrame:
            rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("a"), F.col("p_name").alias("b"), F.col("p_partkey").alias("k"))
            return rows.select("p_partkey", make().cast(kind).alias("value"))

        found[f"strings_{name}"] = query, f"WITH t AS (SELECT p_partkey, {_A} AS a, p_name AS b, p_partkey AS k FROM part) SELECT p_partkey, CAST({sql} AS {_KINDS[kind]}) AS value FROM t"
    for name, (make, sql) in DATES.items():

        def dated(spark: SparkSession, sf_dir: str, make=make) -> DataFrame:
            return table(spark, sf_dir, "orders").select("o_orderkey", make().alias("value"))

        found[f"dates_{name}"] = dated, f"SELECT o_orderkey, {sql} AS value FROM orders"
    return found
