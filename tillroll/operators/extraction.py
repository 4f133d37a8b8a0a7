"""From lines to fields: every extractor in one projection, without a shuffle or Python."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import amounts, dates, items, labels
from tillroll.functions.base import missing, numbered
from tillroll.operators.layout import reading_order

SCALARS = ("merchant", "merchant_address", "date", "time", "currency", "subtotal", "tax", "discounts", "total", "payment_method", "receipt_number")
PARTS = ("status", "value", "num", "candidates", "confidence", "evidence")


def _in_order(f: Column, order: Column) -> Column:
    """The field with lines as given; ``f`` is a column of its own, for each part reads it."""
    return F.when(f.isNotNull(), F.struct(*(f[c].alias(c) for c in PARTS if c != "evidence"), F.transform(f["evidence"], lambda i: F.get(order, i)).alias("evidence")))


@lru_cache(maxsize=4)
def _columns(application: str) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The extractors over column _lines; building them takes longer than planning them, so it is done once a session."""
    n = F.col("_lines")
    sums = {"_subtotal": amounts.subtotal(n), "_tax": amounts.tax(n), "_discounts": amounts.discount(n), "_total": amounts.total(n)}
    found = {
        "merchant": labels.merchant(n), "merchant_address": missing(), "date": dates.date(n), "time": dates.time_of_day(n), "currency": labels.currency(n),
        "subtotal": F.col("_subtotal"), "tax": F.col("_tax"), "discounts": F.col("_discounts"), "total": amounts.with_inferred_total(F.col("_total"), F.col("_subtotal"), F.col("_tax"), F.col("_discounts")),
        "payment_method": labels.payment_method(n), "receipt_number": labels.receipt_number(n),
    }
    return sums, found, items.line_items(n)


def extract_fields(df: DataFrame, lines_col: str = "lines", out_col: str = "fields") -> DataFrame:
    """Add a struct of all fields and ``line_items`` from an array of texts, or of structs (text, x, y, width, height, optional rtl).

    Boxes are put in reading order first; evidence refers to the lines as given.
    """
    kind = df.schema[lines_col].dataType.elementType
    boxed = hasattr(kind, "names")
    lines = F.col(lines_col)
    order = None
    if boxed:
        df = df.withColumn("_order", reading_order(lines, "rtl" if "rtl" in kind.names else None))
        order = F.col("_order")
        df = df.withColumn("_lines", numbered(F.transform(order, lambda i: F.get(lines, i)["text"])))
    else:
        df = df.withColumn("_lines", numbered(lines))
    sums, found, rows = _columns(df.sparkSession.sparkContext.applicationId)
    df = df.withColumns(sums)
    if order is not None:
        own = [k for k in SCALARS if f"_{k}" not in sums or k == "total"]
        df = df.withColumns({f"_found_{k}": found[k] for k in own})
        found = {k: _in_order(F.col(f"_found_{k}" if k in own else f"_{k}"), order) for k in SCALARS}
        rows = F.transform(rows, lambda r: r.withField("line", F.get(order, r["line"])))
    # Order matters to nested pruning: each field stays a plain struct member.
    df = df.withColumn(out_col, F.struct(*(found[k].alias(k) for k in SCALARS), rows.alias("line_items")))
    return df.drop("_lines", "_order", "_subtotal", "_tax", "_discounts", "_total", *(f"_found_{k}" for k in SCALARS))


def exploded_items(df: DataFrame, keep: list[str], lines_col: str = "lines") -> DataFrame:
    """One row for each line item."""
    return df.select(*keep, F.explode(items.line_items(numbered(F.col(lines_col)))).alias("x")).select(*keep, "x.*")
