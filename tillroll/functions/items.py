"""Line items: lines with a description and numbers that are no summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions import keywords
from tillroll.functions.amounts import amount_value, find_amounts
from tillroll.functions.base import contains_any, let, strip


def line_items(lines: Column) -> Column:
    """array<struct<line, status, description, quantity, quantity_status, unit_price, item_total>> in order of lines.

    Quantity and unit price are read where the last three numbers multiply; else the quantity is
    an inferred 1, and the item is uncertain if there were three.
    """
    read = lambda x: F.struct(x["i"].alias("line"), x["t"].alias("t"), x["l"].alias("l"), find_amounts(x["t"]).alias("tokens"))
    value = lambda x: F.struct(x["line"], x["t"], x["tokens"], F.transform(x["tokens"], amount_value).alias("n"))
    rows = F.filter(F.transform(lines, read), lambda x: (F.size(x["tokens"]) > 0) & ~contains_any(x["l"], keywords.SUMMARY))
    rows = F.filter(F.transform(rows, value), lambda x: ~F.exists(x["n"], lambda v: v.isNull()))

    def item(x: Column) -> Column:
        last = lambda k: F.try_element_at(x["n"], F.lit(-k))
        text = strip(F.substring(x["t"], F.lit(1), F.instr(x["t"], F.get(x["tokens"], F.lit(0))) - 1))
        fits = F.coalesce(F.abs(last(3) * last(2) - last(1)) < 0.02, F.lit(False))
        parts = F.struct(x["line"], text.alias("text"), last(3).alias("q"), last(2).alias("u"), last(1).alias("t"), (F.size(x["n"]) >= 3).alias("three"), fits.alias("fits"))
        return let(
            parts,
            lambda p: F.struct(
                p["line"].alias("line"), F.when(p["three"] & ~p["fits"], "uncertain").otherwise("ok").alias("status"), p["text"].alias("description"), F.when(p["fits"], p["q"]).otherwise(1.0).alias("quantity"),
                F.when(p["fits"], "ok").otherwise("inferred_field").alias("quantity_status"), p["u"].alias("unit_price"), p["t"].alias("item_total"),
            ),
        )

    return F.filter(F.transform(rows, item), lambda r: r["description"] != "")
