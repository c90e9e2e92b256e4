"""One-to-one assignment in priority order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.operators.settle import settle, wish
from spotcheck.sources.staging import materialize


def assign(edges: DataFrame, left: str, right: str, order: list[Column], scope: list[str] | None = None) -> DataFrame:
    """The pairs that taking ``edges`` one by one in ``order`` gives, each row used once at most.

    Serial greedy over a total order of edges is the only stable matching of that order, so it
    is found by deferred acceptance: each left row asks down its own edges, each right row
    keeps the best that asks.  The edges are ranked and written once; rounds move one row for
    each left row.  ``left`` and ``right`` name the id columns; they end every tie.

    ``scope`` names columns of ``edges`` that are left out of the result.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    columns = [c for c in edges.columns if c not in (scope or [])]
    keyed = edges.withColumn("_key", key).withColumn("_pos", F.row_number().over(Window.partitionBy(left).orderBy("_key")).cast("long") - 1)
    keyed = materialize(keyed)
    wishes = keyed.groupBy(F.col(left).alias("left")).agg(F.lit(0).alias("lo"), F.max("_pos").alias("hi"))
    wishes = wishes.select("left", F.array(wish(0, "left", F.lit(0))).alias("wishes"))
    lists = keyed.select(F.col(left).alias("list"), F.col("_pos").alias("pos"), F.col(right).alias("right"), F.col("_key").alias("key"))
    got = settle(wishes, lists, shared=False).select(F.col("left").alias(left), F.col("right").alias(right))
    return keyed.join(got, [left, right]).select(columns).dropDuplicates([left])


def assign_in_turn(left: DataFrame, right: DataFrame, group: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """First to first within groups that share all candidates: the closed form of greedy in turn."""
    number = lambda df, order: df.withColumn("_turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*group, "_turn"]).drop("_turn")


def assign_by_scope(edges: DataFrame, left: str, right: str, order: list[str], scope: list[str]) -> DataFrame:
    """The same pairs by a plain loop within each scope; a cross-check for tests, not for large scopes."""

    def loop(group):
        group = group.sort_values([*order, left, right], kind="stable")
        seen_left, seen_right, keep = set(), set(), []
        for a, b in zip(group[left], group[right], strict=True):
            take = a not in seen_left and b not in seen_right
            keep.append(take)
            if take:
                seen_left.add(a)
                seen_right.add(b)
        return group[keep]

    return edges.groupBy(*scope).applyInPandas(loop, edges.schema)
