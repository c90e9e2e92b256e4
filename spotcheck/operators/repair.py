"""Assignments mended after rows are withdrawn or linked by hand, only where the change can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotcheck.operators.assign import assign
from spotcheck.sources.staging import discard, materialize


def regions(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``edges`` with ``region``, a number that edges share if any path of edges connects them.

    Rows of different regions never compete, so a region is as far as a change can reach.  It
    is the least node of a component (left ids doubled, right ids doubled plus one), found by
    alternating stars: each turn hangs a node's larger and then its smaller neighbours on its
    least one.  Turns grow with the logarithm of the longest path; a node with very many
    neighbours is a row count, never a list.  Edges taken away later leave the regions valid.
    """
    ends = edges.select((F.col(left) * 2).alias("a"), (F.col(right) * 2 + 1).alias("b"))
    star = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        outer = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = outer.groupBy("u").agg(F.min("v").alias("m"))
        inner = outer.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u != v")
        before, star = star, materialize(inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        # every node hangs on one other, and that one on none
        hooks = star.groupBy("u").agg(F.count("*").alias("n"))
        chained = star.select(F.col("v").alias("u")).join(hooks, "u", "left_semi")
        if not hooks.filter("n > 1").select("u").unionByName(chained).limit(1).count():
            break
    roots = star.select("u", F.col("v").alias("region")).unionByName(star.select(F.col("v").alias("u"), F.col("v").alias("region")).distinct())
    return edges.withColumn("u", F.col(left) * 2).join(roots, "u").drop("u")


def reached(pairs: DataFrame, left: str, right: str, gone_left: DataFrame | None = None, gone_right: DataFrame | None = None) -> DataFrame:
    """The regions that lose a pair; a withdrawn row that had none was of no consequence."""
    hit = None
    for key, gone in ((left, gone_left), (right, gone_right)):
        if gone is not None:
            lost = pairs.join(gone.select(key).distinct(), key, "left_semi").select("region")
            hit = lost if hit is None else hit.unionByName(lost)
    return hit.distinct()


def repaired(edges: DataFrame, pairs: DataFrame, left: str, right: str, order: list[Column], gone_left: DataFrame | None = None, gone_right: DataFrame | None = None, by_hand: DataFrame | None = None) -> DataFrame:
    """(left, right) as a full assignment gives them without the withdrawn rows, with the pairs ``by_hand`` as given.

    ``edges`` is what ``regions`` wrote, ``pairs`` the assignment of them by ``order`` with its
    ``region``.  Regions that lost a pair are assigned anew, all others stay as they are.  A
    pair by hand withdraws both its rows; the caller sees to it that no row is in two of them.
    """
    if by_hand is not None:
        more = lambda gone, key: by_hand.select(key) if gone is None else gone.select(key).unionByName(by_hand.select(key))
        gone_left, gone_right = more(gone_left, left), more(gone_right, right)
    if gone_left is None and gone_right is None:
        return pairs.select(left, right)
    touched = materialize(reached(pairs, left, right, gone_left, gone_right))
    again = edges.join(touched, "region", "left_semi")
    for key, gone in ((left, gone_left), (right, gone_right)):
        if gone is not None:
            again = again.join(gone.select(key).distinct(), key, "left_anti")
    out = pairs.join(touched, "region", "left_anti").select(left, right).unionByName(assign(again, left, right, order).select(left, right))
    return out if by_hand is None else out.unionByName(by_hand.select(left, right))
