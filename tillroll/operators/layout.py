"""Reading order of line boxes, as a fold over an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.base import let


def _overlaps(a: Column, b: Column) -> Column:
    """The vertical overlap is more than half of the lower height."""
    lower = F.least(a["height"], b["height"])
    return F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]) > 0.5 * F.when(lower == 0, 1.0).otherwise(lower)


def reading_order(boxes: Column, rtl: Column | str | None = None) -> Column:
    """Indices of boxes (array<struct<x, y, width, height>>) in reading order.

    From top to bottom by centre, each box joins the first row whose last box it overlaps, or
    begins a row; rows read from the left, or from the right if most of their boxes do: ``rtl``
    is an array of flags or the name of a box's own.  Ties keep the order of the array.  Where each
    box begins below the one before, every row is one box and nothing is folded.
    """
    flag = lambda b, i: F.lit(False) if rtl is None else F.coalesce(b[rtl] if isinstance(rtl, str) else F.get(rtl, i), F.lit(False))
    box = lambda b, i: F.struct((b["y"] + b["height"] / 2.0).cast("double").alias("c"), i.alias("i"), *(b[n].cast("double").alias(n) for n in ("x", "y", "width", "height")), flag(b, i).alias("rtl"))
    ordered = F.sort_array(F.transform(boxes, box))
    none = F.array().cast("array<array<struct<c:double,i:int,x:double,y:double,width:double,height:double,rtl:boolean>>>")

    def place(rows: Column, b: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda r: _overlaps(F.element_at(r, -1), b)), True)
        grown = F.transform(rows, lambda r, k: F.when(k == at - 1, F.array_append(r, b)).otherwise(r))
        return F.when(at > 0, grown).otherwise(F.array_append(rows, F.array(b)))

    def across(row: Column) -> Column:
        right = 2 * F.size(F.filter(row, lambda b: b["rtl"])) > F.size(row)
        keyed = F.transform(row, lambda b, k: F.struct(F.when(right, -b["x"]).otherwise(b["x"]).alias("x"), k.alias("k"), b["i"].alias("i")))
        return F.transform(F.array_sort(keyed), lambda b: b["i"])

    def apart(bs: Column) -> Column:
        below = lambda b, k: (b["height"] >= 0) & (F.abs(b["y"]) + b["height"] < float("inf")) & ((k == 0) | (b["y"] >= F.get(bs, k - 1)["y"] + F.get(bs, k - 1)["height"]))
        return F.coalesce(F.forall(F.transform(bs, below), lambda x: x), F.lit(False))

    return let(ordered, lambda bs: F.when(apart(bs), F.transform(bs, lambda b: b["i"])).otherwise(F.flatten(F.transform(F.aggregate(bs, none, place), across))))


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], band: float = 50.0) -> DataFrame:
    """Pairs of boxes (keys, id, y, height) on one page whose vertical overlap is more than half of the lower height: (keys, id, other).

    An interval join without a cross join: each box goes to the bands of so many units that it
    touches, boxes meet in bands, and a pair counts in the first band that both touch.  A box of no
    height touches one band.
    """
    box = F.struct("y", "height")

    def spread(df: DataFrame, name: str) -> DataFrame:
        first, last = F.floor(F.col("y") / band), F.floor((F.col("y") + F.col("height")) / band)
        return df.select(*keys, F.col("id").alias(name), box.alias(f"{name}_box"), first.alias(f"{name}_first"), F.explode(F.sequence(first, last)).alias("band"))

    met = spread(left, "id").join(spread(right, "other"), [*keys, "band"])
    return met.where((F.col("band") == F.greatest("id_first", "other_first")) & _overlaps(F.col("id_box"), F.col("other_box"))).select(*keys, "id", "other")


def remap(evidence: Column, order: Column) -> Column:
    """Positions in reading order as indices of the original lines."""
    return F.transform(evidence, lambda i: F.get(order, i))
