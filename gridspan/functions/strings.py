"""String functions with array semantics, as column expressions. White space is what Python strips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import ColumnOrValue, col

_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0]"


def _literal(x: ColumnOrValue) -> Column:
    """A text argument is a constant, not a column's name."""
    return x if isinstance(x, Column) else F.lit(x)


def add(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return F.concat(col(a), _literal(b))


def multiply(a: ColumnOrValue, n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("repeat", col(a), F.greatest(n, F.lit(0)))


def _gap(a: Column, width: int) -> Column:
    return F.greatest(F.lit(width) - F.length(a), F.lit(0))


def ljust(a: ColumnOrValue, width: int, fill: str = " ") -> Column:
    return F.concat(col(a), multiply(F.lit(fill), _gap(col(a), width)))


def rjust(a: ColumnOrValue, width: int, fill: str = " ") -> Column:
    return F.concat(multiply(F.lit(fill), _gap(col(a), width)), col(a))


def center(a: ColumnOrValue, width: int, fill: str = " ") -> Column:
    """The odd place goes left where both the gap and the width are odd, as Python has it."""
    gap = _gap(col(a), width)
    left = F.floor(gap / 2).cast("int") + F.when((gap % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    return F.concat(multiply(F.lit(fill), left), col(a), multiply(F.lit(fill), gap - left))


def zfill(a: ColumnOrValue, width: int) -> Column:
    a = col(a)
    signed = F.substring(a, 1, 1).isin("+", "-")
    body = F.when(signed, a.substr(F.lit(2), F.length(a))).otherwise(a)
    head = F.when(signed, F.substring(a, 1, 1)).otherwise("")
    return F.concat(head, multiply(F.lit("0"), _gap(a, width)), body)


def upper(a: ColumnOrValue) -> Column:
    return F.upper(col(a))


def lower(a: ColumnOrValue) -> Column:
    return F.lower(col(a))


def capitalize(a: ColumnOrValue) -> Column:
    return F.concat(F.upper(F.substring(col(a), 1, 1)), F.lower(col(a).substr(F.lit(2), F.length(col(a)))))


def title(a: ColumnOrValue) -> Column:
    """A capital after everything that is no letter: splits before and after runs of letters."""
    parts = F.split(F.lower(col(a)), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def swapcase(a: ColumnOrValue) -> Column:
    chars = F.split(col(a), "")
    return F.array_join(F.transform(chars, lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def replace(a: ColumnOrValue, old: str, new: str, count: int = -1) -> Column:
    a = col(a)
    if count < 0:
        return F.replace(a, F.lit(old), F.lit(new))
    parts = F.split(a, _quote(old), count + 1)
    return F.array_join(parts, new)


def _quote(x: str) -> str:
    return r"\Q" + x.replace(r"\E", r"\E\\E\Q") + r"\E"


def _class(chars: str | None) -> str:
    return _SPACE if chars is None else "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"


def lstrip(a: ColumnOrValue, chars: str | None = None) -> Column:
    return F.regexp_replace(col(a), rf"\A{_class(chars)}+", "")


def rstrip(a: ColumnOrValue, chars: str | None = None) -> Column:
    return F.regexp_replace(col(a), rf"{_class(chars)}+\z", "")


def strip(a: ColumnOrValue, chars: str | None = None) -> Column:
    return rstrip(lstrip(a, chars), chars)


def split(a: ColumnOrValue, sep: str | None = None, maxsplit: int = -1) -> Column:
    """array<string>; without sep, at runs of white space, ends stripped."""
    limit = -1 if maxsplit < 0 else maxsplit + 1
    if sep is not None:
        return F.split(col(a), _quote(sep), limit)
    inner = strip(a)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{_SPACE}+", limit))


def rsplit(a: ColumnOrValue, sep: str, maxsplit: int = -1) -> Column:
    parts = F.split(col(a), _quote(sep), -1)
    if maxsplit < 0:
        return parts
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, F.greatest(n - maxsplit, F.lit(1))), sep)
    return F.when(n <= maxsplit + 1, parts).otherwise(F.concat(F.array(head), F.slice(parts, n - maxsplit + 1, maxsplit)))


def splitlines(a: ColumnOrValue) -> Column:
    parts = F.split(col(a), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def join(sep: str, a: Column) -> Column:
    """Of an array of strings; of a string, between its characters."""
    return F.array_join(a, sep)


def count(a: ColumnOrValue, sub: str) -> Column:
    """Non-overlapping occurrences; of the empty string one more than characters."""
    if not sub:
        return F.length(col(a)) + 1
    return F.size(F.split(col(a), _quote(sub), -1)) - 1


def find(a: ColumnOrValue, sub: str) -> Column:
    return F.instr(col(a), sub) - 1


def rfind(a: ColumnOrValue, sub: str) -> Column:
    at = F.instr(F.reverse(col(a)), sub[::-1])
    return F.when(at == 0, -1).otherwise(F.length(col(a)) - at + 1 - len(sub))


def _found(at: Column) -> Column:
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def index(a: ColumnOrValue, sub: str) -> Column:
    return _found(find(a, sub))


def rindex(a: ColumnOrValue, sub: str) -> Column:
    return _found(rfind(a, sub))


def startswith(a: ColumnOrValue, prefix: str) -> Column:
    return col(a).startswith(prefix)


def endswith(a: ColumnOrValue, suffix: str) -> Column:
    return col(a).endswith(suffix)


def encode(a: ColumnOrValue, charset: str = "UTF-8") -> Column:
    return F.encode(col(a), charset)


def decode(a: ColumnOrValue, charset: str = "UTF-8") -> Column:
    return F.decode(col(a), charset)


def isalpha(a: ColumnOrValue) -> Column:
    return col(a).rlike(r"\A\p{L}+\z")


def isdigit(a: ColumnOrValue) -> Column:
    return col(a).rlike("\\A[\\p{Nd}²³¹⁰-⁹₀-₉]+\\z")


def isdecimal(a: ColumnOrValue) -> Column:
    return col(a).rlike(r"\A\p{Nd}+\z")


def isnumeric(a: ColumnOrValue) -> Column:
    return col(a).rlike(r"\A\p{N}+\z")


def isalnum(a: ColumnOrValue) -> Column:
    return col(a).rlike(r"\A[\p{L}\p{N}]+\z")


def isspace(a: ColumnOrValue) -> Column:
    return col(a).rlike(rf"\A{_SPACE}+\z")


def isupper(a: ColumnOrValue) -> Column:
    a = col(a)
    return a.rlike(r"[\p{Lu}\p{Lt}]") & ~a.rlike(r"\p{Ll}")


def islower(a: ColumnOrValue) -> Column:
    a = col(a)
    return a.rlike(r"\p{Ll}") & ~a.rlike(r"[\p{Lu}\p{Lt}]")


def istitle(a: ColumnOrValue) -> Column:
    """Capitals only after what is no letter, small letters only after letters."""
    a = col(a)
    return a.rlike(r"[\p{Lu}\p{Lt}]") & ~a.rlike(r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]")


def partition(a: ColumnOrValue, sep: str) -> Column:
    """struct<head, sep, tail>."""
    a, at = col(a), find(a, sep)
    head = F.when(at < 0, a).otherwise(a.substr(F.lit(1), at))
    tail = F.when(at < 0, "").otherwise(a.substr(at + 1 + len(sep), F.length(a)))
    return F.struct(head.alias("head"), F.when(at < 0, "").otherwise(sep).alias("sep"), tail.alias("tail"))


def rpartition(a: ColumnOrValue, sep: str) -> Column:
    a, at = col(a), rfind(a, sep)
    head = F.when(at < 0, "").otherwise(a.substr(F.lit(1), at))
    tail = F.when(at < 0, a).otherwise(a.substr(at + 1 + len(sep), F.length(a)))
    return F.struct(head.alias("head"), F.when(at < 0, "").otherwise(sep).alias("sep"), tail.alias("tail"))


def expandtabs(a: ColumnOrValue, size: int = 8) -> Column:
    """Each tab fills up to the next stop of its line."""

    def line(x: Column) -> Column:
        parts = F.split(x, "\t", -1)
        last = F.element_at(parts, -1)
        fill = lambda p: F.concat(p, multiply(F.lit(" "), F.lit(size) - F.length(p) % size)) if size else p
        return F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), fill), ""), last)

    return F.array_join(F.transform(F.split(col(a), "\n", -1), line), "\n")


def mod(a: ColumnOrValue, *values: ColumnOrValue) -> Column:
    """printf formatting."""
    return F.printf(_literal(a), *(col(v) for v in values))


def str_len(a: ColumnOrValue) -> Column:
    return F.length(col(a))


def translate(a: ColumnOrValue, table: dict[str, str], delete: str = "") -> Column:
    """Characters mapped to characters, or deleted."""
    return F.translate(col(a), "".join(table) + delete, "".join(table.values()))


def equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return rstrip(a) == rstrip(_literal(b))


def not_equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return ~equal(a, b)


def less(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return rstrip(a) < rstrip(_literal(b))


def less_equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return rstrip(a) <= rstrip(_literal(b))


def greater(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return rstrip(a) > rstrip(_literal(b))


def greater_equal(a: ColumnOrValue, b: ColumnOrValue) -> Column:
    return rstrip(a) >= rstrip(_literal(b))


def compare_chararrays(a: ColumnOrValue, b: ColumnOrValue, op: str, strip_ends: bool = True) -> Column:
    x, y = (rstrip(a), rstrip(_literal(b))) if strip_ends else (col(a), _literal(b))
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def format_float_positional(x: ColumnOrValue) -> Column:
    """The shortest text that reads back as the number, without exponent."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.format_float_positional(v))

    return F.pandas_udf(run, "string")(col(x).cast("double"))


def format_float_scientific(a: ColumnOrValue, precision: int) -> Column:
    """Of a double, as C prints it: its exact value is rounded, a tie to the even digit, where Java rounds the shortest text half up."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([f"{v:.{precision}e}" for v in x.tolist()], dtype=object)

    x = col(a).cast("double")
    return F.when(x.isNotNull(), run(x))
