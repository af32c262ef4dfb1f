"""Types: what array dtypes are in Spark, and how they promote. Driver-side."""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

#: dtype to (kind, bits, Spark type).
DTYPES = {
    "bool": ("b", 8, "boolean"), "int8": ("i", 8, "tinyint"), "int16": ("i", 16, "smallint"), "int32": ("i", 32, "int"), "int64": ("i", 64, "bigint"),
    "uint8": ("u", 8, "smallint"), "uint16": ("u", 16, "int"), "uint32": ("u", 32, "bigint"), "uint64": ("u", 64, "decimal(20,0)"),
    "float16": ("f", 16, "float"), "float32": ("f", 32, "float"), "float64": ("f", 64, "double"),
    "complex64": ("c", 64, "struct<re:float,im:float>"), "complex128": ("c", 128, "struct<re:double,im:double>"),
    "str": ("U", 0, "string"), "bytes": ("S", 0, "binary"), "datetime64[D]": ("M", 64, "date"), "datetime64[us]": ("M", 64, "timestamp_ntz"), "timedelta64[us]": ("m", 64, "interval day to second"),
}
ALIASES = {
    "intp": "int64", "int_": "int64", "long": "int64", "longlong": "int64", "intc": "int32", "short": "int16", "byte": "int8", "uint": "uint64", "uintp": "uint64", "ulong": "uint64",
    "ulonglong": "uint64", "uintc": "uint32", "ushort": "uint16", "ubyte": "uint8", "half": "float16", "single": "float32", "double": "float64", "longdouble": "float64", "float_": "float64",
    "longfloat": "float64", "csingle": "complex64", "cdouble": "complex128", "clongdouble": "complex128", "complex_": "complex128", "float": "float64", "int": "int64", "complex": "complex128", "bool_": "bool", "str_": "str",
}


def canonical(dtype: str) -> str:
    name = ALIASES.get(dtype, dtype)
    if name not in DTYPES:
        raise TypeError(f"unknown dtype {dtype}")
    return name


def spark_type(dtype: str) -> str:
    return DTYPES[canonical(dtype)][2]


def promote_types(a: str, b: str) -> str:
    """The smallest type that holds both."""
    a, b = canonical(a), canonical(b)
    if a == b:
        return a
    (p, m, _), (q, n, _) = DTYPES[a], DTYPES[b]
    order = "buifc"
    if p not in order or q not in order:
        if "U" in (p, q):
            return "str"
        raise TypeError(f"no common type of {a} and {b}")
    if order.index(p) > order.index(q):
        (p, m, a), (q, n, b) = (q, n, b), (p, m, a)
    if p == "b":
        return b
    if p == q:
        return a if m >= n else b
    if p == "u" and q == "i":
        return b if n > m else "float64" if m == 64 else f"int{2 * m}"
    if q == "f":
        return f"float{max(n, min(64, {8: 16, 16: 32}.get(m, 64)))}"
    need = {8: 32, 16: 32}.get(m, 64) if p in "iu" else max(m, 32)
    return f"complex{max(n, 2 * need)}"


def result_type(*dtypes: str) -> str:
    out = canonical(dtypes[0])
    for d in dtypes[1:]:
        out = promote_types(out, d)
    return out


find_common_type = result_type


def common_type(*dtypes: str) -> str:
    """As result_type, but inexact."""
    out = result_type(*dtypes)
    return "float64" if DTYPES[out][0] in "bui" else out


def can_cast(source: str, target: str, casting: str = "safe") -> bool:
    a, b = canonical(source), canonical(target)
    if casting == "unsafe" or a == b:
        return True
    if casting in ("no", "equiv"):
        return False
    p, q = DTYPES[a][0], DTYPES[b][0]
    try:
        safe = promote_types(a, b) == b
    except TypeError:
        safe = False
    if casting == "safe":
        return safe
    order = "buifc"
    return safe or (p in order and q in order and order.index(p) <= order.index(q)) or p == q


def min_scalar_type(x: float | int | bool | complex | str) -> str:
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, int):
        kinds = (("uint", 0, 1),) if x >= 0 else (("int", 1, 0),)
        for name, signed, _ in kinds:
            for bits in (8, 16, 32, 64):
                if (-(1 << (bits - 1)) <= x < (1 << (bits - 1))) if signed else x < (1 << bits):
                    return f"{name}{bits}"
        raise OverflowError(x)
    if isinstance(x, float):
        return "float16" if x != x or abs(x) in (0.0, float("inf")) or 6e-8 <= abs(x) < 65000 else "float32" if abs(x) < 3.4e38 else "float64"
    return "complex64" if isinstance(x, complex) else "str"


def mintypecode(codes: str, typeset: str = "GDFgdf", default: str = "d") -> str:
    found = [c for c in codes if c in typeset]
    if not found:
        return default
    return "D" if "F" in found and "d" in found else min(found, key=typeset.index)


def issubdtype(a: str, b: str) -> bool:
    groups = {"generic": "buifcUSMm", "number": "uifc", "integer": "ui", "signedinteger": "i", "unsignedinteger": "u", "inexact": "fc", "floating": "f", "complexfloating": "c", "character": "US", "flexible": "US"}
    kind = DTYPES[canonical(a)][0]
    return kind in groups[b] if b in groups else canonical(a) == canonical(b)


issubclass_ = issctype = issubdtype


def isdtype(dtype: str, kind: str | tuple[str, ...]) -> bool:
    names = {"bool": "b", "signed integer": "i", "unsigned integer": "u", "integral": "iu", "real floating": "f", "complex floating": "c", "numeric": "iufc"}
    kinds = (kind,) if isinstance(kind, str) else kind
    return any(DTYPES[canonical(dtype)][0] in names[k] if k in names else canonical(dtype) == canonical(k) for k in kinds)


class finfo(NamedTuple):  # noqa: N801
    bits: int
    eps: float
    max: float
    min: float
    tiny: float

    @classmethod
    def of(cls, dtype: str) -> finfo:
        if canonical(dtype) in ("float32", "complex64", "float16"):
            most = (2 - 2.0**-23) * 2.0**127
            return cls(32, 2.0**-23, most, -most, 2.0**-126)
        f = sys.float_info
        return cls(64, f.epsilon, f.max, -f.max, f.min)


class iinfo(NamedTuple):  # noqa: N801
    bits: int
    min: int
    max: int

    @classmethod
    def of(cls, dtype: str) -> iinfo:
        kind, bits, _ = DTYPES[canonical(dtype)]
        if kind not in "iu":
            raise ValueError(f"{dtype} is no integer type")
        return cls(bits, 0, (1 << bits) - 1) if kind == "u" else cls(bits, -(1 << (bits - 1)), (1 << (bits - 1)) - 1)


def struct_of(fields: list[tuple[str, str]]) -> str:
    """The Spark schema of a structured dtype: [(name, dtype)]."""
    if any(not re.fullmatch(r"\w+", n) for n, _ in fields):
        raise ValueError("field names are words")
    return ", ".join(f"{n} {spark_type(d)}" for n, d in fields)
