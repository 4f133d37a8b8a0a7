"""Pairs of names within an edit bound, without comparing all.

Names of similarity 0.8 differ by at most k edits, a fifth of the longer one's length.  Of k + 1
pieces of the longer name one is untouched, so it occurs in the shorter one, at most k places
aside; the join on that piece misses no pair.  Emitted keys grow with the cube of a name's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import metrics
from tillroll.functions.base import strip

#: Piece i of a longer name of ``size`` runs from i * size div (k + 1) up to the next one's start.
_PIECES = """flatten(transform(sequence({least}, {most}), size -> flatten(transform(sequence(0, size div 5), i -> transform(
    filter(sequence(-(size div 5), size div 5), s -> {shift} and i * size div (size div 5 + 1) + s >= 0 and (i + 1) * size div (size div 5 + 1) + s <= length(t)),
    s -> struct(size, i, substring(t, i * size div (size div 5 + 1) + s + 1, (i + 1) * size div (size div 5 + 1) - i * size div (size div 5 + 1)) as piece))))))"""


def fuzzy_join(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """(a, b) of the different values of col in left and in right with ``fuzzy_match``, equal ones included."""
    x, y = (df.select(F.col(col)).where(F.col(col).isNotNull()).distinct() for df in (left, right))
    pairs = similar_pairs(x.union(y), col)
    mixed = pairs.join(x.select(F.col(col).alias("a")), "a", "left_semi").join(y.select(F.col(col).alias("b")), "b", "left_semi").select("a", "b")
    return mixed.union(x.join(y, col).select(F.col(col).alias("a"), F.col(col).alias("b")))


def similar_pairs(names: DataFrame, col: str) -> DataFrame:
    """(a, b) of all different values of ``col`` with ``fuzzy_match``, in both orders; null has no pair."""
    t = names.select(F.col(col).alias("a")).where("a is not null").distinct().withColumn("t", F.lower(strip(F.col("a"))))
    longer = t.select("a", F.explode(F.expr(_PIECES.format(least="length(t)", most="length(t)", shift="s = 0"))).alias("k"))
    shorter = t.select(F.col("a").alias("b"), F.explode(F.expr(_PIECES.format(least="length(t)", most="length(t) * 5 div 4", shift="true"))).alias("k"))
    found = longer.join(shorter, "k").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = found.where(metrics.fuzzy_match(F.col("a"), F.col("b")))
    return near.union(near.select("b", "a"))
