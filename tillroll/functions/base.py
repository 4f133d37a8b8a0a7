"""The field struct, numbered lines and small column helpers that the extractors share.

A field is struct<status, value, num, candidates, confidence, evidence>: text in ``value``, a
number in ``num``, the possible readings of an uncertain one in ``candidates``, and the indices
of the lines it came from in ``evidence``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9][0-9.,]*[0-9]|[0-9]"
FIELD = "struct<status:string,value:string,num:double,candidates:array<string>,confidence:double,evidence:array<int>>"
#: Zeros of the decimal digit blocks that \d also matches.
_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040, 0x17E0, 0x1810, 0xFF10)


def field(status: str, value: Column | None = None, num: Column | None = None, candidates: Column | None = None, confidence: float | None = None, evidence: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(status).alias("status"), (null if value is None else value).cast("string").alias("value"), (null if num is None else num).cast("double").alias("num"),
        (null if candidates is None else candidates).cast("array<string>").alias("candidates"), F.lit(confidence).cast("double").alias("confidence"), (null if evidence is None else evidence).cast("array<int>").alias("evidence"),
    )


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: bound as the only element of an array.

    A Column used twice is planned and evaluated twice, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def missing() -> Column:
    return field("missing")


def numbered(lines: Column) -> Column:
    """array<struct<i, t, l>>: index, text and lower-cased text of each line; a null line is empty, and so is a null array."""
    lines = F.coalesce(lines, F.array().cast("array<string>"))
    return F.transform(lines, lambda t, i: F.struct(i.alias("i"), F.coalesce(t, F.lit("")).alias("t"), F.lower(F.coalesce(t, F.lit(""))).alias("l")))


def strip(text: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the text has one of the words; a word that contains another one tells nothing more."""
    low = list(dict.fromkeys(w.lower() for w in words))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in low if not any(v in w for v in low if v != w)))


def first(lines: Column, test) -> Column:
    """The first numbered line that passes, or null."""
    return F.get(F.filter(lines, test), F.lit(0))


def all_lines(lines: Column, words: Iterable[str]) -> Column:
    """Indices of the numbered lines that contain one of the words."""
    return F.transform(F.filter(lines, lambda x: contains_any(x["l"], words)), lambda x: x["i"])


def plain_digits(text: Column) -> Column:
    """ASCII digits for those of other scripts."""
    return F.translate(text, "".join(chr(z + d) for z in _ZEROS for d in range(10)), "0123456789" * len(_ZEROS))


def union_of(*indices: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*indices)))
