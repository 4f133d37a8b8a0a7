"""Connected components of an edge table, by alternating star contraction.

Large stars link each node's larger neighbours to its smallest one, small stars its smaller
ones; both keep components whole, and in a logarithmic number of rounds every node hangs on
its component's least node.  Rounds are staged in the shared folder.  Minima are pre-aggregated
and joined back, so a node with millions of neighbours never sits in one task's memory; the
optimizer splits such a key in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import discard, staged


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return pairs.join(least, "a").withColumn("m", F.least("a", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a > b."""
    linked = _with_least(edges)
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", "b")).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, from edges (a, b); root is the component's least node, which has no row of its own.

    Self-links, repeated edges and either direction are fine; null ends are dropped.
    """
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _print(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, edges = edges, staged(_small_star(_large_star(edges)), "edges")
        discard(last)
        now = _print(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
