"""Overlapping periods cut into disjoint spans, each with the period that wins it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: Days of a bin by which spans and dated rows meet.
BIN = 32


def winning_spans(periods: DataFrame, keys: list[str], id_: str, start: str, end: str) -> DataFrame:
    """keys, from_day, to_day (inclusive) and the least ``id_`` of the periods that cover the span; spans without a period are left out.

    The starts and the days after the ends of a key cut its time into elementary spans,
    numbered in order.  A period covers a run of numbers, which is a union of few aligned
    blocks of powers of two; a span lies in one block of each size.  So the winner of each
    span is the least over its blocks, without a row for each period and span that meet:
    n log n rows for n periods of a key, however they overlap.  Keys may be null; periods
    that end before they start, or lack a day, are left out.
    """
    p = periods.filter(F.col(start) <= F.col(end)).select(*keys, F.col(id_).alias("_id"), F.col(start).cast("date").alias("_a"), F.date_add(F.col(end).cast("date"), 1).alias("_b"))
    cuts = p.select(*keys, "_a").union(p.select(*keys, "_b")).toDF(*keys, "_day").distinct()
    line = Window.partitionBy(*keys).orderBy("_day")
    cuts = cuts.withColumns({"_n": F.row_number().over(line).cast("long") - 1, "_next": F.lead("_day").over(line), "_top": F.count("*").over(Window.partitionBy(*keys))})
    same = lambda a, b: F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))

    def ranked(df: DataFrame, day: str, name: str) -> DataFrame:
        c = cuts.select(*keys, F.col("_day").alias(day), F.col("_n").alias(name), *(["_top"] if name == "_i" else []))
        met = df.alias("x").join(c.alias("y"), same("x", "y") & (F.col(f"x.{day}") == F.col(f"y.{day}")))
        return met.select("x.*", f"y.{name}", *(["y._top"] if name == "_i" else []))

    runs = ranked(ranked(p, "_a", "_i"), "_b", "_j")
    level = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_top"))).cast("int"))).alias("_l")
    runs = runs.select(*keys, "_id", "_i", "_j", level)
    size = F.pow(F.lit(2), F.col("_l"))
    runs = runs.withColumns({"_left": F.ceil(F.col("_i") / size).cast("long"), "_right": F.floor(F.col("_j") / size).cast("long")}).filter("_left < _right")
    taken = F.array_compact(F.array(F.when(F.col("_left") % 2 == 1, F.col("_left")), F.when(F.col("_right") % 2 == 1, F.col("_right") - 1)))
    blocks = runs.select(*keys, "_id", "_l", F.explode(taken).alias("_block")).groupBy(*keys, "_l", "_block").agg(F.min("_id").alias("_id"))
    inside = cuts.filter("_next is not null").select(*keys, "_day", "_next", "_n", level).withColumn("_block", F.expr("shiftright(_n, _l)"))
    met = inside.alias("x").join(blocks.alias("y"), same("x", "y") & F.expr("x._l = y._l and x._block = y._block"))
    won = met.groupBy(*[F.col(f"x.{k}").alias(k) for k in keys], "x._day", "x._next").agg(F.min("y._id").alias(id_))
    return won.select(*keys, F.col("_day").alias("from_day"), F.date_sub("_next", 1).alias("to_day"), id_)


def rows_in_spans(rows: DataFrame, spans: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Rows with their span, which is one at most: they meet by key and bin of days."""
    bins = F.explode(F.sequence(F.floor(F.unix_date("from_day") / BIN), F.floor(F.unix_date("to_day") / BIN)))
    met = rows.withColumn("_bin", F.floor(F.unix_date(day) / BIN)).join(spans.withColumn("_bin", bins), [*keys, "_bin"])
    return met.filter(F.col(day).between(F.col("from_day"), F.col("to_day"))).drop("_bin")
