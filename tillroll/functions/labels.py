"""Currency, merchant, payment method and receipt number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions import keywords
from tillroll.functions.base import contains_any, field, first, let, missing, strip

_CODE = r"(?U)\b(" + "|".join(keywords.CURRENCY_CODES) + r")\b"
_VALUE = r"(?U)[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-/]{2,})\s*$"


def _hits(lines: Column, marks: tuple[tuple[str, object], ...], some: str) -> Column:
    """(code, line) of every mark a line has, lines and marks in order; lines with a mark match some."""
    of_line = lambda x: F.array_compact(F.array(*(F.when(F.contains(x["t"], F.lit(mark)), F.struct(F.lit(code if isinstance(code, str) else ",".join(code)).alias("code"), x["i"].alias("i"))) for mark, code in marks)))
    return F.flatten(F.transform(F.filter(lines, lambda x: x["t"].rlike(some)), of_line))


def _vote(hits: Column) -> Column:
    """The code with most lines, the first seen of several: struct(code, evidence), null without hits."""

    def best(h: Column) -> Column:
        codes = F.array_distinct(F.transform(h, lambda x: x["code"]))
        counted = F.transform(codes, lambda c, k: F.struct((-F.size(F.filter(h, lambda x: x["code"] == c))).alias("n"), k.alias("k"), c.alias("code")))
        return let(F.array_min(counted)["code"], lambda c: F.struct(c.alias("code"), F.transform(F.filter(h, lambda x: x["code"] == c), lambda x: x["i"]).alias("evidence")))

    return let(hits, lambda h: F.when(F.size(h) > 0, best(h)))


def currency(lines: Column) -> Column:
    """A code beats a sign, a sign of one currency a shared one."""
    code = _vote(F.filter(F.transform(F.filter(lines, lambda x: x["t"].rlike("[A-Z]{3}")), lambda x: F.struct(F.regexp_extract(x["t"], _CODE, 1).alias("code"), x["i"].alias("i"))), lambda h: h["code"] != ""))
    sign, shared = _vote(_hits(lines, keywords.DOLLARS + keywords.SIGNS, r"[$]|[^\x00-\x7F]")), _vote(_hits(lines, keywords.SHARED_SIGNS, r"Rs|[^\x00-\x7F]"))
    found = let(code, lambda c: F.when(c.isNotNull(), field("ok", c["code"], confidence=0.95, evidence=c["evidence"])))
    signed = let(sign, lambda c: F.when(c.isNotNull(), field("ok", c["code"], confidence=0.85, evidence=c["evidence"])))
    open_ = let(shared, lambda c: F.when(c.isNotNull(), field("uncertain", candidates=F.split(c["code"], ","), confidence=0.3, evidence=c["evidence"])))
    return F.coalesce(found, signed, open_, missing())


def merchant(lines: Column) -> Column:
    """Of the first five lines, the first that is text and no heading; never more than a guess."""

    def names(x: Column) -> Column:
        return let(strip(x["t"]), lambda s: (F.length(s) >= 2) & ~s.rlike(r"(?U)^[\d\s\-.,:/]+$") & ~s.rlike(keywords.NOISE))

    at = first(F.slice(lines, 1, 5), names)
    return let(at, lambda x: F.when(x.isNull(), missing()).otherwise(field("uncertain", strip(x["t"]), confidence=0.35, evidence=F.array(x["i"]))))


def payment_method(lines: Column) -> Column:
    every = tuple(w for _, words in keywords.PAYMENT for w in words)
    at = first(lines, lambda x: contains_any(x["l"], every))
    method = lambda l: F.coalesce(*(F.when(contains_any(l, words), F.lit(name)) for name, words in keywords.PAYMENT))
    return let(at, lambda x: F.when(x.isNull(), missing()).otherwise(field("ok", method(x["l"]), confidence=0.75, evidence=F.array(x["i"]))))


def receipt_number(lines: Column) -> Column:
    """What follows the first label at the end of its line, or else the end of the next line."""
    at = first(lines, lambda x: contains_any(x["l"], keywords.RECEIPT_NUMBER))

    def read(x: Column) -> Column:
        rest = F.coalesce(*(F.when(F.contains(x["l"], F.lit(k)), F.substring(x["t"], F.instr(x["l"], k) + len(k), F.length(x["t"]))) for k in keywords.RECEIPT_NUMBER))
        values = F.struct(F.regexp_extract(rest, _VALUE, 1).alias("own"), F.regexp_extract(strip(F.get(lines, x["i"] + 1)["t"]), _VALUE, 1).alias("after"))
        return let(
            values,
            lambda v: F.when(v["own"] != "", field("ok", v["own"], confidence=0.8, evidence=F.array(x["i"])))
            .when(v["after"] != "", field("ok", v["after"], confidence=0.7, evidence=F.array(x["i"], x["i"] + 1)))
            .otherwise(field("uncertain", evidence=F.array(x["i"]))),
        )

    return let(at, lambda x: F.when(x.isNull(), missing()).otherwise(read(x)))
