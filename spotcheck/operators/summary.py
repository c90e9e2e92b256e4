"""Summaries of reconciled scopes, money and status maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.functions.scalars import clean_channel, money, percent_of

KEY = ["account_id", "channel", "brand", "duration"]


def commercial(spots: DataFrame, confirmed: DataFrame, mapped: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Planned, aired, third-party, missed and extra spots of each brand and duration.

    confirmed: account_id, channel, brand, duration of confirmed certificates.  For mapped
    brands aired counts manual matches besides, missed does not; an unmapped brand has manual
    matches alone.
    """
    planned = spots.groupBy(*KEY).agg(F.count("*").alias("planned"))
    third = confirmed.groupBy(*KEY).agg(F.count("*").alias("t"))
    by_hand = (spots.select(*KEY).limit(0) if manual is None else manual.select(*KEY)).groupBy(*KEY).agg(F.count("*").alias("m"))
    out = planned.join(third, KEY, "left").join(by_hand, KEY, "left").join(mapped.select("account_id", "brand", F.lit(True).alias("_mapped")).distinct(), ["account_id", "brand"], "left")
    known = F.coalesce(F.col("_mapped"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    out = out.fillna(0, ["t", "m"]).withColumns({"third_party": F.when(known, F.col("t")).otherwise(zero)})
    return out.select(
        *KEY, "planned", (F.col("third_party") + F.col("m")).alias("aired"), "third_party",
        F.greatest(zero, F.col("planned") - F.when(known, F.col("third_party")).otherwise(F.col("m"))).alias("missed"),
        F.greatest(zero, F.col("third_party") - F.col("planned")).alias("extra"),
    )


def sponsorship(spots: DataFrame, *evidence: DataFrame) -> DataFrame:
    """Planned and aired by programme, brand and duration; evidence sets (key, log_id) count each log row once."""
    key = ["account_id", "channel", "programme", "brand", "duration"]
    planned = spots.groupBy(*key).agg(F.count("*").alias("planned"))
    ids = evidence[0].select(*key, "log_id")
    for e in evidence[1:]:
        ids = ids.unionByName(e.select(*key, "log_id"))
    aired = ids.groupBy(*key).agg(F.countDistinct("log_id").alias("aired"))
    out = planned.join(aired, key, "left").fillna(0, ["aired"])
    return out.withColumn("status", F.when(F.col("aired") == 0, "no_data").when(F.col("aired") >= F.col("planned"), "complete").otherwise("incomplete"))


def totals(rows: DataFrame, *levels: str, measures: tuple[str, ...] = ("planned", "aired")) -> DataFrame:
    """Sums at every level of a rollup; ``level`` tells how many columns are rolled up."""
    id_ = F.grouping_id()
    level = sum((F.shiftright(id_, i).bitwiseAND(F.lit(1)) for i in range(len(levels))), F.lit(0))
    return rows.rollup(*levels).agg(*[F.sum(m).alias(m) for m in measures], level.cast("int").alias("level"))


def campaign_board(spots: DataFrame, logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row for each scope: planned and aired spots, spans, whether logs cover the period, and its status dot."""
    scope = ["account_id", "channel"]
    p = spots.groupBy(*scope).agg(F.count("*").alias("planned"), F.min("spot_date").alias("first_date"), F.max("spot_date").alias("last_date"))
    r = logs.groupBy(*scope).agg(F.max("log_date").alias("log_until"), F.count("*").alias("log_rows"))
    v = verdicts.groupBy(*scope).agg(F.count("log_id").alias("aired"), F.count(F.when(F.col("status") == "not_aired", 1)).alias("missed"))
    out = p.join(r, scope, "left").join(v, scope, "left").fillna(0, ["log_rows", "aired", "missed"])
    out = out.withColumn("covered", F.coalesce(F.col("log_until") >= F.date_add("last_date", 7), F.lit(False)))
    return out.withColumn("dot", F.when(F.col("log_rows") == 0, "grey").when(F.col("missed") > 0, "red").when(F.col("covered"), "green").otherwise("amber"))


def board_states(headers: DataFrame, logs: DataFrame, runs: DataFrame, today: Column) -> DataFrame:
    """For each scope of ``headers`` (row_count, end_date, is_locked): planned spots, whether its
    period is over, whether the log reaches a week past it, whether all its schedules are locked,
    and the day of its last run (null: none).
    """
    scope = ["account_id", "ch"]
    named = lambda df: df.withColumn("ch", clean_channel(F.col("channel")))
    h = named(headers).groupBy(*scope).agg(F.min("channel").alias("channel"), F.sum("row_count").alias("planned"), F.max("end_date").alias("_end"), F.coalesce(F.bool_and(F.coalesce("is_locked", F.lit(False))), F.lit(False)).alias("is_locked"))
    r = named(logs).groupBy(*scope).agg(F.max("log_date").alias("_log"))
    v = named(runs).groupBy(*scope).agg(F.max("run_at").alias("last_run"))
    out = h.join(r, scope, "left").join(v, scope, "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    return out.select("account_id", "channel", "planned", true(F.col("_end") < today).alias("period_over"), true(F.col("_log") >= F.date_add("_end", 7)).alias("covered"), "is_locked", "last_run")


def scope_card(summary: DataFrame, reconciled: Column | None = None) -> DataFrame:
    """Percent aired and a status for each scope."""
    out = summary.groupBy("account_id", "channel").agg(F.sum("planned").alias("planned"), F.sum("aired").alias("aired"), F.sum("missed").alias("missed"))
    status = F.when(F.col("aired") == 0, "not_reconciled").when(F.col("missed") > 0, "has_missed").otherwise("all_clear")
    return out.withColumns({"percent": F.bround(F.col("aired") * 100.0 / F.col("planned"), 1), "status": status})


def financials(costs: DataFrame, levy: str = "2.5", vat: str = "18", media: str = "85", agency: str = "10.75", client: str = "4.25") -> DataFrame:
    """The money block of rows with ``schedule_cost`` and ``deviated_cost``; every step is rounded half up to cents."""
    rate = lambda x: F.lit(x).cast("decimal(9,4)")
    out = costs.withColumns({"schedule_cost": money(F.col("schedule_cost")), "deviated_cost": money(F.col("deviated_cost"))})
    out = out.withColumn("net", money(F.col("schedule_cost") - F.col("deviated_cost")))
    out = out.withColumns({n: percent_of(F.col("net"), rate(r)) for n, r in (("levy", levy), ("media_house", media), ("agency", agency), ("client", client))})
    out = out.withColumn("sub_total", money(F.col("net") + F.col("levy")))
    out = out.withColumn("vat", percent_of(F.col("sub_total"), rate(vat)))
    return out.withColumns({"total_with_taxes": money(F.col("sub_total") + F.col("vat")), "split_total": money(F.col("media_house") + F.col("agency") + F.col("client"))})


#: Fixed rates of the cost breakdown, in percent.
LEVY, VAT, MEDIA, GLOBAL, COMMISSION, TO_CLIENT = "2.5", "18", "85", "3", "12", "88"


def cost_breakdown(costs: DataFrame) -> DataFrame:
    """Costs with and without taxes at the fixed rates."""
    p = lambda c, r: percent_of(F.col(c), F.lit(r).cast("decimal(9,4)"))
    out = costs.withColumn("net_cost", money(F.col("schedule_cost") - F.col("deviated_cost")))
    out = out.withColumn("levy", p("net_cost", LEVY))
    out = out.withColumn("before_vat", money(F.col("net_cost") + F.col("levy")))
    out = out.withColumn("vat", p("before_vat", VAT))
    out = out.withColumn("final", money(F.col("before_vat") + F.col("vat")))
    return out.withColumns({"payable_to_media": p("schedule_cost", MEDIA), "global_share": p("schedule_cost", GLOBAL), "agency_commission": p("schedule_cost", COMMISSION), "client_88": p("schedule_cost", TO_CLIENT), "client_88_with_vat": p("final", TO_CLIENT)})


def status_map(verdicts: DataFrame, logs: DataFrame) -> DataFrame:
    """Spots of each slot, day and status; a late airing also counts as late on the day it aired."""
    slot = ["account_id", "channel", "programme", "start_secs", "duration"]
    own = verdicts.select(*slot, F.col("spot_date").alias("date"), F.when(F.col("status") == "late_telecast", "not_aired").otherwise(F.col("status")).alias("status"))
    late = verdicts.filter("status = 'late_telecast'").join(logs.select("log_id", "log_date"), "log_id").select(*slot, F.col("log_date").alias("date"), F.lit("late_telecast").alias("status"))
    return own.unionByName(late).groupBy(*slot, "date", "status").agg(F.count("*").alias("n"))


def certificate_status_map(spots: DataFrame, matched: DataFrame, aired: DataFrame) -> DataFrame:
    """Status of every spot from certificates, missed ones promoted by day up to what the summary counts as aired.

    matched: spot_id, cert_date; aired: account_id, channel, brand, duration, aired.
    """
    out = spots.join(matched.select("spot_id", "cert_date"), "spot_id", "left")
    status = F.when(F.col("cert_date").isNull(), "missed").when(F.col("cert_date") > F.col("spot_date"), "late").otherwise("matched")
    out = out.withColumn("status", status)
    have = out.groupBy(*KEY).agg(F.count("cert_date").alias("have"))
    need = have.join(aired.select(*KEY, "aired"), KEY, "left").select(*KEY, F.greatest(F.lit(0), F.coalesce("aired", F.lit(0)) - F.col("have")).alias("need"))
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("spot_date", "start_secs", "spot_id"))
    missed = out.filter("status = 'missed'").withColumn("_turn", turn).join(need, KEY)
    missed = missed.withColumn("status", F.when(F.col("_turn") <= F.col("need"), "matched").otherwise("missed")).select(out.columns)
    return out.filter("status <> 'missed'").unionByName(missed)


def sponsorship_days(spots: DataFrame, logs: DataFrame, themes: DataFrame) -> DataFrame:
    """Planned against observed of each brand and day: matched, aired_less or not_aired."""
    key = ["account_id", "channel", "brand", "date"]
    planned = spots.select("account_id", "channel", "brand", F.col("spot_date").alias("date")).groupBy(*key).agg(F.count("*").alias("planned"))
    seen = logs.join(themes, ["account_id", "advt_theme"]).select("account_id", "channel", "brand", F.col("log_date").alias("date")).groupBy(*key).agg(F.count("*").alias("observed"))
    out = planned.join(seen, key, "left").fillna(0, ["observed"])
    return out.withColumn("status", F.when(F.col("observed") == 0, "not_aired").when(F.col("observed") < F.col("planned"), "aired_less").otherwise("matched"))


def schedule_pivot(spots: DataFrame, days: list[int]) -> DataFrame:
    """The schedule as a grid: a row for each slot, a column for each day of the month."""
    slot = ["account_id", "channel", "brand", "programme", "start_secs", "duration"]
    out = spots.withColumn("day", F.dayofmonth("spot_date")).groupBy(*slot).pivot("day", days).count()
    return out.select(*slot, *[F.coalesce(F.col(str(d)), F.lit(0)).alias(f"d{d}") for d in days])


#: Order in which statuses are shown.
STATUS_ORDER = ("matched", "mismatch", "late_telecast", "not_aired", "no_mapping", "extra", "pending")


def in_display_order(rows: DataFrame) -> DataFrame:
    """Rows with the place of their status, ordered by scope and place."""
    return rows.withColumn("place", F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))).orderBy("account_id", "channel", "place")


def quick_check(spots: DataFrame, certs: DataFrame, brand_of: DataFrame) -> DataFrame:
    """Scheduled against certified spots of each brand and their difference."""
    s = spots.groupBy("account_id", "channel", "brand").agg(F.count("*").alias("scheduled"))
    c = certs.join(brand_of, ["account_id", "tc_theme"]).groupBy("account_id", "channel", "brand").agg(F.count("*").alias("certified"))
    out = s.join(c, ["account_id", "channel", "brand"], "full").fillna(0, ["scheduled", "certified"])
    return out.withColumn("diff", F.col("certified") - F.col("scheduled"))
