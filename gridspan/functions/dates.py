"""Dates, durations and business days, as column expressions and one calendar table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import ColumnOrValue, col

UNITS = {"Y": "YEAR", "M": "MONTH", "W": "WEEK", "D": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND"}
_MONDAY = date(1970, 1, 5)
_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def datetime64(x: ColumnOrValue, unit: str = "us") -> Column:
    """A timestamp cut to the unit; a date for D, W, M and Y."""
    t = col(x).cast("timestamp_ntz")
    if unit in ("us", "ns", "ms"):
        return t if unit != "ms" else F.date_trunc("MILLISECOND", t)
    cut = F.date_trunc(UNITS[unit], t)
    return cut.cast("date") if unit in "DWMY" else cut


def timedelta64(a: ColumnOrValue, b: ColumnOrValue, unit: str = "D") -> Column:
    """a - b in whole units, towards zero."""
    return F.timestamp_diff(UNITS[unit], col(b).cast("timestamp_ntz"), col(a).cast("timestamp_ntz"))


def isnat(x: ColumnOrValue) -> Column:
    return col(x).isNull()


def datetime_as_string(x: ColumnOrValue, unit: str = "s") -> Column:
    pattern = {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd", "h": "yyyy-MM-dd'T'HH", "m": "yyyy-MM-dd'T'HH:mm", "s": "yyyy-MM-dd'T'HH:mm:ss", "ms": "yyyy-MM-dd'T'HH:mm:ss.SSS", "us": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}[unit]
    return F.date_format(col(x).cast("timestamp_ntz"), pattern)


def datetime_data(unit: str) -> tuple[str, int]:
    """(unit, count) of a unit such as "25s"."""
    digits = "".join(c for c in unit if c.isdigit())
    return unit[len(digits) :], int(digits or 1)


def _mask(weekmask: str | Sequence[int]) -> list[int]:
    if not isinstance(weekmask, str):
        return [int(bool(x)) for x in weekmask]
    if set(weekmask) <= {"0", "1"} and len(weekmask) == 7:
        return [int(c) for c in weekmask]
    named = weekmask.replace(",", " ").split()
    if not named or any(n not in _DAYS for n in named):
        raise ValueError(f"no weekmask: {weekmask}")
    return [int(d in named) for d in _DAYS]


@dataclass
class busdaycalendar:  # noqa: N801
    """Working days of a week, and holidays."""

    weekmask: str | Sequence[int] = "1111100"
    holidays: Sequence[date] = field(default_factory=tuple)

    def __post_init__(self):
        self.mask = _mask(self.weekmask)
        if not any(self.mask):
            raise ValueError("a week needs a working day")
        self.free = sorted({h for h in self.holidays if self.mask[h.weekday()]})


def _weekday(d: Column) -> Column:
    """0 for Monday."""
    return F.pmod(F.datediff(d, F.lit(_MONDAY)), F.lit(7))


def is_busday(d: ColumnOrValue, calendar: busdaycalendar | None = None) -> Column:
    calendar = calendar or busdaycalendar()
    d = col(d).cast("date")
    works = F.element_at(F.array(*map(F.lit, calendar.mask)), _weekday(d).cast("int") + 1) == 1
    return works & ~d.isin(list(calendar.free)) if calendar.free else works


def _before(d: Column, calendar: busdaycalendar) -> Column:
    """Working days from 1970-01-05 to the day before d."""
    t = F.datediff(d, F.lit(_MONDAY))
    sums = [sum(calendar.mask[:k]) for k in range(7)]
    weeks = F.floor(t / 7) * sum(calendar.mask)
    days = weeks + F.element_at(F.array(*map(F.lit, sums)), F.pmod(t, F.lit(7)).cast("int") + 1)
    if calendar.free:
        free = F.array(*(F.lit(h) for h in calendar.free))
        days = days - F.size(F.filter(free, lambda h: h < d)) + sum(h < _MONDAY for h in calendar.free)
    return days


def busday_count(a: ColumnOrValue, b: ColumnOrValue, calendar: busdaycalendar | None = None) -> Column:
    """Working days from a to the day before b; backwards, from the day after b to a, negative."""
    calendar = calendar or busdaycalendar()
    a, b = col(a).cast("date"), col(b).cast("date")
    back = _before(F.date_add(b, 1), calendar) - _before(F.date_add(a, 1), calendar)
    return F.when(b >= a, _before(b, calendar) - _before(a, calendar)).otherwise(back).cast("long")


def roll_to_busday(d: ColumnOrValue, roll: str, calendar: busdaycalendar | None = None) -> Column:
    """A day that is none moved: forward, backward, modifiedfollowing, modifiedpreceding, nat (NULL) or raise."""
    calendar = calendar or busdaycalendar()
    d = col(d).cast("date")
    reach = 7 + len(calendar.free)
    ahead = F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.date_add(d, k)), lambda x: is_busday(x, calendar))[0]
    back = F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.date_sub(d, k)), lambda x: is_busday(x, calendar))[0]
    moved = {
        "forward": ahead,
        "following": ahead,
        "backward": back,
        "preceding": back,
        "modifiedfollowing": F.when(F.month(ahead) == F.month(d), ahead).otherwise(back),
        "modifiedpreceding": F.when(F.month(back) == F.month(d), back).otherwise(ahead),
        "nat": F.lit(None).cast("date"),
        "raise": F.raise_error(F.lit("not a working day")).cast("date"),
    }[roll]
    return F.when(d.isNull(), None).when(is_busday(d, calendar), d).otherwise(moved)


def busday_offset(d: ColumnOrValue, n: int | Column, roll: str = "raise", calendar: busdaycalendar | None = None) -> Column:
    """n working days on from d, d first rolled to one. Whole weeks by division, the rest by a table."""
    calendar = calendar or busdaycalendar()
    start = roll_to_busday(d, roll, calendar)
    n = n if isinstance(n, Column) else F.lit(n)
    if calendar.free:
        reach = F.abs(n) * 7 + 7 * (len(calendar.free) + 1)
        days = lambda sign: F.filter(F.transform(F.sequence(F.lit(0), reach.cast("int")), lambda k: F.date_add(start, (k * sign).cast("int"))), lambda x: is_busday(x, calendar))
        return F.when(n >= 0, F.get(days(1), n.cast("int"))).otherwise(F.get(days(-1), F.abs(n).cast("int")))
    per = sum(calendar.mask)
    work = [k for k in range(7) if calendar.mask[k]]
    rank = F.element_at(F.array(*(F.lit(work.index(k) if k in work else 0) for k in range(7))), _weekday(start).cast("int") + 1)
    target = rank + n
    day = F.element_at(F.array(*map(F.lit, work)), F.pmod(target, F.lit(per)).cast("int") + 1)
    return F.date_add(F.date_sub(start, _weekday(start).cast("int")), (F.floor(target / per) * 7 + day).cast("int"))

