"""Dates and times of day in lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.base import field, let, missing, plain_digits

#: Patterns of dates and times of day; months by the first letters of their names.
ISO = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
NUMERIC = r"(?U)\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
NAMED = r"(?U)\b(\d{1,2})\s+([A-Za-z]+)\.?\s+(\d{2,4})\b|\b([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{2,4})\b"
TIME = r"(?U)\b(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\b"
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: What a lower-cased line with a date has at least: a cheap test before the patterns.  Beyond ASCII they decide alone.
_MAYBE = r"[^\x00-\x7F]|[0-9][/.\-][0-9]{1,2}[/.\-][0-9]|(?:" + "|".join(MONTHS) + r")[a-z]*\.?\s+[0-9]"


def _int(digits: Column) -> Column:
    """A number, null for the empty text of a group that is absent: casting that raises an exception inside, which is slow."""
    return F.nullif(plain_digits(digits), F.lit("")).try_cast("int")


def _group(text: Column, pattern: str, k: int) -> Column:
    return _int(F.regexp_extract(text, pattern, k))


def _valid(year: Column, month: Column, day: Column) -> Column:
    y = F.when(year < 100, year + 2000).otherwise(year)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(month.between(1, 12) & (day >= 1) & (day <= last), F.lit(False))


def _iso(year: Column, month: Column, day: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day))


def _full(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def _parts(**parts: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def _of_line(x: Column) -> Column:
    """The date field of one line, null if it has none; only the first kind of date that matches is tried."""
    t, i = x["t"], F.array(x["i"])

    def dated(p: Column) -> Column:
        return F.when(_valid(p["y"], p["m"], p["d"]), field("ok", _iso(p["y"], p["m"], p["d"]), confidence=0.9, evidence=i))

    iso = let(_parts(y=_group(t, ISO, 1), m=_group(t, ISO, 2), d=_group(t, ISO, 3)), dated)

    def month(name: Column) -> Column:
        return F.coalesce(*(F.when(F.startswith(name, F.lit(start)), F.lit(number)) for start, number in MONTHS.items()))

    day_first = F.regexp_extract(t, NAMED, 2) != ""
    pick = lambda a, b: F.when(day_first, F.regexp_extract(t, NAMED, a)).otherwise(F.regexp_extract(t, NAMED, b))
    named = let(_parts(y=let(_int(pick(3, 6)), _full), m=let(F.lower(pick(2, 4)), month), d=_int(pick(1, 5))), dated)

    def either(p: Column) -> Column:
        a, b, y = p["a"], p["b"], p["y"]
        both = _parts(a=a, b=b, y=y, dm=_valid(y, b, a), md=_valid(y, a, b), day=_iso(y, b, a), month=_iso(y, a, b))
        return let(
            both,
            lambda q: F.when(q["dm"] & q["md"] & (q["a"] != q["b"]), field("uncertain", candidates=F.array(q["day"], q["month"]), confidence=0.4, evidence=i))
            .when(q["dm"], field("ok", q["day"], confidence=0.85, evidence=i))
            .when(q["md"], field("ok", q["month"], confidence=0.85, evidence=i)),
        )

    numeric = let(_parts(a=_group(t, NUMERIC, 1), b=_group(t, NUMERIC, 2), y=let(_group(t, NUMERIC, 3), _full)), either)
    return F.when(x["l"].rlike(_MAYBE), F.when(t.rlike(ISO), iso).when(t.rlike(NAMED), named).when(t.rlike(NUMERIC), numeric))


def date(lines: Column) -> Column:
    found = F.get(F.filter(F.transform(lines, _of_line), lambda f: f.isNotNull()), F.lit(0))
    return F.coalesce(found, missing())


def _time_of_line(x: Column) -> Column:
    t = x["t"]

    def read(p: Column) -> Column:
        h = p["h"]
        return F.when(p["half"] == "", F.when(h <= 23, h)).when(h.between(1, 12), h % 12 + F.when(p["half"] == "pm", 12).otherwise(0))

    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    parts = _parts(h=_group(t, TIME, 1), m=_group(t, TIME, 2), s=F.coalesce(_group(t, TIME, 3), F.lit(0)), half=F.lower(F.regexp_extract(t, TIME, 4)))
    whole = lambda p: let(_parts(h=read(p), m=p["m"], s=p["s"]), lambda q: F.when(q["h"].isNotNull() & (q["m"] <= 59) & (q["s"] <= 59), field("ok", F.concat_ws(":", two(q["h"]), two(q["m"]), two(q["s"])), confidence=0.85, evidence=F.array(x["i"]))))
    return F.when(F.contains(t, F.lit(":")) & t.rlike(TIME), let(parts, whole))


def time_of_day(lines: Column) -> Column:
    found = F.get(F.filter(F.transform(lines, _time_of_line), lambda f: f.isNotNull()), F.lit(0))
    return F.coalesce(found, missing())
