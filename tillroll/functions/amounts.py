"""Numbers in text: finding them, and reading them where separators say enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions import keywords
from tillroll.functions.base import NUMBER, contains_any, field, first, let, missing, strip, union_of

#: Tokens that amount_value takes as they are.
_SIMPLE = r"^[0-9]+([.][0-9]{1,2})?\z"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def find_amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _number(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def amount_value(token: Column) -> Column:
    """The token as a number, or null where its separators leave it open (``1,234``) or it is none.

    With both separators the later one is decimal.  With one kind: a single one is decimal unless
    three digits follow; several are thousands if every later group has three digits.
    """
    def read(c: Column) -> Column:
        commas, dots = F.regexp_count(c, F.lit(",")), F.regexp_count(c, F.lit(r"\."))
        dot_last = F.instr(F.reverse(c), ".") < F.instr(F.reverse(c), ",")
        tail = F.length(F.regexp_extract(c, r"[.,]([^.,]*)$", 1))
        plain = (
            F.when((commas > 0) & (dots > 0), F.when(dot_last, F.replace(c, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
            .when(commas + dots == 1, F.when(tail == 3, F.lit(None)).when(tail.isin(1, 2, 4, 5, 6), F.replace(c, F.lit(","), F.lit("."))).otherwise(c))
            .when(commas + dots > 1, F.when(c.rlike(r"^[^.,]*([.,][^.,]{3})+$"), F.regexp_replace(c, "[.,]", "")))
            .otherwise(c)
        )
        return let(plain, _number)

    full = lambda t: let(F.replace(strip(t), F.lit(" "), F.lit("")), read)
    return let(token, lambda t: F.when(t.rlike(_SIMPLE), t.try_cast("double")).otherwise(full(t)))


def parse_amount(token: Column) -> Column:
    value = amount_value(token)
    return F.struct(value.alias("value"), value.isNull().alias("ambiguous"), strip(token).alias("raw"))


def labeled_amount(lines: Column, words: tuple[str, ...], but_not: tuple[str, ...] = ()) -> Column:
    """The last number on the first line that has one of the words, or else on the line after it."""
    def read(at: Column) -> Column:
        own, after = F.try_element_at(find_amounts(at["t"]), F.lit(-1)), F.try_element_at(find_amounts(F.get(lines, at["i"] + 1)["t"]), F.lit(-1))
        return let(F.struct(at["i"].alias("i"), own.alias("own"), after.alias("after")), valued)

    def valued(x: Column) -> Column:
        used = F.when(x["own"].isNull() & x["after"].isNotNull(), x["i"] + 1).otherwise(x["i"])
        found = F.struct(amount_value(F.coalesce(x["own"], x["after"])).alias("value"), union_of(F.array(x["i"]), F.array(used)).alias("evidence"))
        return let(found, lambda y: F.when(y["value"].isNotNull(), field("ok", num=y["value"], confidence=0.8, evidence=y["evidence"])).otherwise(field("uncertain", evidence=y["evidence"])))

    at = first(lines, lambda x: contains_any(x["l"], words) & (~contains_any(x["l"], but_not) if but_not else F.lit(True)))
    return let(at, lambda x: F.when(x.isNull(), missing()).otherwise(read(x)))


def subtotal(lines: Column) -> Column:
    return labeled_amount(lines, keywords.SUBTOTAL)


def tax(lines: Column) -> Column:
    return labeled_amount(lines, keywords.TAX)


def discount(lines: Column) -> Column:
    return labeled_amount(lines, keywords.DISCOUNT)


def total(lines: Column) -> Column:
    return labeled_amount(lines, keywords.TOTAL, keywords.SUBTOTAL)


def with_inferred_total(total: Column, subtotal: Column, tax: Column, discount: Column) -> Column:
    """The total, or where it is missing what subtotal, tax and discount come to."""
    can = (total["status"] == "missing") & (subtotal["status"] == "ok") & (tax["status"] == "ok")
    known = discount["status"] == "ok"
    value = F.round(subtotal["num"] + tax["num"] - F.when(known, discount["num"]).otherwise(0.0), 2)
    none = F.array().cast("array<int>")
    evidence = union_of(subtotal["evidence"], tax["evidence"], F.when(known, discount["evidence"]).otherwise(none))
    return F.when(can, field("inferred_field", num=value, confidence=0.6, evidence=evidence)).otherwise(total)
