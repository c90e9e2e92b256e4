"""Sponsorship spots, deals over a period, and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.functions.scalars import clean_channel, normalize
from spotcheck.operators.assign import assign, assign_in_turn
from spotcheck.operators.mapping import resolve_patterns
from spotcheck.operators.spans import rows_in_spans, winning_spans
from spotcheck.sources.staging import materialize


def in_turn(spots: DataFrame, logs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sponsorship spots by day, start and brand take their theme's free log rows by day and time.

    Themes are exact here.  A brand and duration with one theme that no other brand has share
    all candidates, so ranks join; the rest goes through the general assignment.
    """
    t = mappings.select("account_id", normalize(F.col("brand")).alias("brand_key"), F.col("duration").alias("map_duration"), normalize(F.col("theme")).alias("theme_key")).distinct()
    s = spots.withColumn("brand_key", normalize(F.col("brand"))).join(t, ["account_id", "brand_key"]).filter("map_duration is null or map_duration = duration")
    s = s.select("spot_id", "account_id", clean_channel(F.col("channel")).alias("channel"), "theme_key", "duration", "spot_date", "start_secs", "brand_key").distinct()
    r = logs.select("log_id", "account_id", clean_channel(F.col("channel")).alias("channel"), normalize(F.col("advt_theme")).alias("theme_key"), "duration", "log_date", "air_secs")
    group = ["account_id", "channel", "theme_key", "duration"]
    themes = s.groupBy("spot_id").agg(F.countDistinct("theme_key").alias("n"))
    several = s.join(themes.filter("n > 1"), "spot_id", "left_semi").select(group).distinct()
    plain = assign_in_turn(s.join(several, group, "left_anti"), r.join(several, group, "left_anti"), group, [F.col(c) for c in ("spot_date", "start_secs", "brand_key", "spot_id")], [F.col(c) for c in ("log_date", "air_secs", "log_id")])
    order = ["spot_date", "start_secs", "brand_key", "spot_id", "theme_key", "log_date", "air_secs"]
    hard = s.join(several, group, "left_semi").join(r, group).select("account_id", "channel", "duration", "log_id", *order)
    general = assign(hard, "spot_id", "log_id", [F.col(c) for c in order], scope=["account_id", "channel", "duration"])
    return plain.select("spot_id", "log_id").unionByName(general.select("spot_id", "log_id"))


def targets(spots: DataFrame, assigned: DataFrame) -> DataFrame:
    """Required, assigned and remaining spots of each scope, brand and duration."""
    key = ["account_id", "channel", "brand", "duration"]
    out = spots.join(assigned.select("spot_id", "log_id"), "spot_id", "left").groupBy(*key).agg(F.count("*").alias("required"), F.count("log_id").alias("assigned"))
    return out.withColumn("remaining", F.col("required") - F.col("assigned"))


def deals_from_schedule(spots: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A deal for each scope, brand and duration: its span and planned count; existing ones are skipped."""
    key = ["account_id", "channel", "brand", "duration"]
    out = spots.groupBy(*key).agg(F.min("spot_date").alias("start_date"), F.max("spot_date").alias("end_date"), F.count("*").alias("planned_count"))
    return out if existing is None else out.join(existing.select(key).distinct(), key, "left_anti")


def cover(deals: DataFrame, logs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Log rows of each deal's themes within its days; a row goes to the deal of smallest id that wants it.

    A deal counts its own ``theme`` (a column of deals, if there is one that is not blank), else
    the themes of its brand, of mappings of its duration or of any; without a duration it
    counts rows of every duration.  The deals of a theme are cut into disjoint spans, each with
    its deal, so a log row meets one span of its duration and one of any, and no deal meets
    all rows of its theme.
    """
    m = mappings.select("account_id", normalize(F.col("brand")).alias("_brand"), "theme", F.col("duration").alias("_of") if "duration" in mappings.columns else F.lit(None).cast("int").alias("_of")).distinct()
    own = normalize(F.col("theme")) if "theme" in deals.columns else F.lit("")
    d = deals.select("deal_id", "account_id", clean_channel(F.col("channel")).alias("_ch"), normalize(F.col("brand")).alias("_brand"), "duration", "start_date", "end_date", own.alias("_own"))
    agree = F.col("_of").isNull() | F.col("duration").isNull() | (F.col("_of") == F.col("duration"))
    wanted = d.filter("_own <> ''").withColumn("theme", F.col("_own")).drop("_own", "_brand").unionByName(d.filter("_own = ''").join(m, ["account_id", "_brand"]).filter(agree).drop("_own", "_brand", "_of"))
    wanted = wanted.filter(F.length(normalize(F.col("theme"))) > 0)
    named = resolve_patterns(wanted, logs.select("account_id", "advt_theme"), "theme", "advt_theme", ["account_id"]).select("account_id", "_ch", "advt_theme", "duration", "deal_id", "start_date", "end_date").distinct()
    keys = ["account_id", "_ch", "advt_theme"]
    spans = materialize(winning_spans(named, [*keys, "duration"], "deal_id", "start_date", "end_date"))
    rows = logs.select("log_id", "account_id", clean_channel(F.col("channel")).alias("_ch"), "advt_theme", "duration", "log_date")
    of_any = rows_in_spans(rows.drop("duration"), spans.filter("duration is null").drop("duration"), keys, "log_date")
    of_one = rows_in_spans(rows, spans.filter("duration is not null"), [*keys, "duration"], "log_date")
    found = of_any.select("log_id", "deal_id", "log_date").unionByName(of_one.select("log_id", "deal_id", "log_date"))
    return found.groupBy("log_id").agg(F.min(F.struct("deal_id", "log_date")).alias("x")).select("log_id", F.col("x.deal_id").alias("deal_id"), F.col("x.log_date").alias("log_date"))


def coverage(deals: DataFrame, covered: DataFrame) -> DataFrame:
    """Found, short, extra and covered days of each deal."""
    found = covered.groupBy("deal_id").agg(F.count("*").alias("found"), F.countDistinct("log_date").alias("days_covered"))
    out = deals.join(found, "deal_id", "left").fillna(0, ["found", "days_covered"])
    zero = F.lit(0).cast("bigint")
    return out.withColumns({"short": F.greatest(zero, F.col("planned_count") - F.col("found")), "extra": F.greatest(zero, F.col("found") - F.col("planned_count"))})


def free_groups(logs: DataFrame, claims: DataFrame) -> DataFrame:
    """Unclaimed log rows by scope, theme and duration: number and span."""
    free = logs.join(claims.select("log_id").distinct(), "log_id", "left_anti")
    return free.groupBy("account_id", "channel", "advt_theme", "duration").agg(F.count("*").alias("n"), F.min("log_date").alias("first_date"), F.max("log_date").alias("last_date"))


def manual_assign(requests: DataFrame, spots: DataFrame, logs: DataFrame, claims: DataFrame) -> DataFrame:
    """Each request (request_id, spot_id, log_id) with what became of it.

    It is created if both rows exist, neither is taken, and no earlier request has either.
    """
    out = requests.join(spots.select("spot_id", F.lit(True).alias("_s")), "spot_id", "left").join(logs.select("log_id", F.lit(True).alias("_r")), "log_id", "left")
    taken = claims.select("log_id", F.lit(True).alias("_t")).distinct()
    held = claims.select(F.col("left_id").alias("spot_id"), F.lit(True).alias("_h")).distinct()
    out = out.join(taken, "log_id", "left").join(held, "spot_id", "left")
    bad = F.when(F.col("_s").isNull() | F.col("_r").isNull(), "missing").when(F.col("_t"), "log taken").when(F.col("_h"), "spot taken")
    out = out.withColumn("reason", bad)
    good = out.filter("reason is null")
    by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("request_id"))
    good = good.withColumn("reason", F.when((by("spot_id") > 1) | (by("log_id") > 1), "asked before"))
    out = out.filter("reason is not null").unionByName(good)
    return out.select("request_id", "spot_id", "log_id", F.coalesce("reason", F.lit("created")).alias("result"))


def without(table: DataFrame, removals: DataFrame, key: str) -> DataFrame:
    """The table without the rows whose key is to be removed."""
    return table.join(removals.select(key).distinct(), key, "left_anti")


def candidates(deals: DataFrame, logs: DataFrame, mappings: DataFrame, claims: DataFrame) -> DataFrame:
    """Free log rows for each deal from its first day to the end of the next month, of its themes if it has any."""
    m = mappings.select("account_id", "brand", "theme").distinct()
    themes = resolve_patterns(m, logs.select("account_id", "advt_theme"), "theme", "advt_theme", ["account_id"]).select("account_id", "brand", "advt_theme").distinct()
    free = logs.join(claims.select("log_id").distinct(), "log_id", "left_anti")
    named = lambda df: df.withColumn("_ch", clean_channel(F.col("channel"))).drop("channel")
    pairs = named(deals).join(themes, ["account_id", "brand"]).join(named(free).drop("duration"), ["account_id", "_ch", "advt_theme"])
    return pairs.filter(F.col("log_date").between(F.col("start_date"), F.last_day(F.add_months("end_date", 1)))).select("deal_id", "log_id", "log_date", "air_secs")
