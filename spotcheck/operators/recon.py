"""Rows of the reconciliation report: spots, deviations and their value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotcheck.functions.scalars import money, money_text, note_or

SCOPE = ["account_id", "channel"]
NOTES = "map<string,struct<reason:string,dev_value:string>>"


def report_rows(commercial: DataFrame, sponsorship: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each product of a scope's report, commercial ones and sponsored ones, with its label and notes.

    ``commercial`` has brand, duration, planned, aired, third_party, missed and extra; so has
    ``sponsorship``, with a row for each programme.  ``notes`` has a row at most for each scope:
    spot_labels, a JSON map of labels, and deviation_notes, one of a reason and a value, both by
    key: ``brand|seconds``, after ``spon|`` for sponsored products.  A blank or missing label is
    the brand and its seconds, a missing note empty; a JSON text that is none has no entries.
    """
    columns = [*SCOPE, "brand", "duration", "planned", "aired", "third_party", "missed", "extra"]
    rows = commercial.select(*columns, F.lit(False).alias("is_sponsorship"))
    rows = rows.unionByName(sponsorship.select(*columns, F.lit(True).alias("is_sponsorship")))
    seconds = F.coalesce("duration", F.lit(0))
    key = F.concat(F.when(F.col("is_sponsorship"), "spon|").otherwise(""), F.coalesce("brand", F.lit("")), F.lit("|"), seconds.cast("string"))
    plain = F.concat(F.coalesce("brand", F.lit("")), F.when((seconds > 0) & (F.coalesce("brand", F.lit("")) != ""), F.concat(F.lit(" "), seconds.cast("string"), F.lit("s"))).otherwise(""))
    out = rows.withColumn("key", key).join(notes.select(*SCOPE, "spot_labels", "deviation_notes"), SCOPE, "left")
    note = F.try_element_at(F.from_json("deviation_notes", NOTES), F.col("key"))
    text = lambda name: F.coalesce(note.getField(name), F.lit(""))
    return out.select(*columns, "is_sponsorship", "key", note_or(F.col("spot_labels"), F.col("key"), plain).alias("label"), text("reason").alias("reason"), text("dev_value").alias("dev_value"))


def spot_table(rows: DataFrame) -> DataFrame:
    """The report's spots with the totals of each scope (key null)."""
    one = rows.select(*SCOPE, "is_sponsorship", "key", "label", "planned", "aired", "third_party")
    sums = rows.groupBy(*SCOPE).agg(*[F.sum(c).alias(c) for c in ("planned", "aired", "third_party")])
    return one.unionByName(sums, allowMissingColumns=True)


def deviations(rows: DataFrame) -> DataFrame:
    """Products that aired too often or too seldom, with reason and value."""
    out = rows.filter("extra > 0 or missed > 0")
    return out.select(*SCOPE, "is_sponsorship", "key", "label", F.col("extra").alias("deviated"), F.col("missed").alias("not_aired"), "reason", "dev_value")


def deviated_costs(deviation_rows: DataFrame, stored: DataFrame) -> DataFrame:
    """schedule_cost and deviated_cost of each scope of ``stored``.

    Texts with an amount are summed, the stored cost holds where none has one; a schedule's
    value is its text, or the stored cost; what is missing is 0.
    """
    summed = deviation_rows.groupBy(*SCOPE).agg(F.sum(money_text(F.col("dev_value"))).alias("_sum"))
    zero = F.lit(0).cast("decimal(16,2)")
    out = stored.join(summed, SCOPE, "left")
    return out.select(*SCOPE, money(F.coalesce(money_text(F.col("schedule_value")), "schedule_cost", zero)).alias("schedule_cost"), money(F.coalesce("_sum", "deviated_cost", zero)).alias("deviated_cost"))
