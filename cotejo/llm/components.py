"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.llm.common import Shelf


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it knows."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of these; edges are (larger, smaller)."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, root): the smallest node of its component for every node of `edges` (a, b) that has a neighbour.

    Neighbourhoods are never gathered: each step is a mergeable minimum and a join. Edges don't get more, and rounds grow with the
    logarithm of the longest path. Each round is written down and the one before it deleted; the end is reached when a round changes nothing.
    """
    shelf = shelf or Shelf(edges.sparkSession, "components")
    left = shelf.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        old, left = left, shelf.put(_small_star(_large_star(left)))
        shelf.drop(old)
        now = left.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == before:
            break
        before = now
    roots = left.select("b").distinct()
    return left.unionAll(roots.select(F.col("b").alias("a"), "b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
