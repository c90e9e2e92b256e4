"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotcheck.llm.frames import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (columns a, b): root is the smallest id linked to it.

    Each turn hangs every node's larger neighbours, then its smaller ones, on its smallest
    neighbour; the number of turns grows with the logarithm of the longest path.  Minima are
    pre-aggregated, and a node with very many neighbours is a row count, never a list.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u != v")
        before, edges = edges, materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        # done when every id hangs on one other, which hangs on none
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > least").limit(1).count():
            break
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
