"""Queries of certificates, sponsorship, summaries and money."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotcheck.operators import certificates as c, sponsorship as s, summary as y
from spotcheck.operators.mapping import brand_themes
from spotcheck.plans.registry import query
from spotcheck.plans.verification import THEMES, VERDICTS, commercial, verdicts
from spotcheck.plans.walk import walk
from spotcheck.sources.projection import certs, logs, mappings, spots
from spotcheck.sources.staging import materialize

TC = """tc AS (SELECT DISTINCT m.account_id, m.brand, m.product, x.tc_theme, t.advt_theme FROM (SELECT *, unnest(string_split(tc_theme, '|')) AS one FROM mappings) AS m
  JOIN (SELECT DISTINCT account_id, tc_theme FROM certs) AS x ON x.account_id = m.account_id AND x.tc_theme = m.one
  LEFT JOIN themes AS t ON t.account_id = m.account_id AND t.brand = m.brand)"""

CONFIRMED = THEMES + ", " + TC + ", " + walk("confirmed", """SELECT k.cert_id, r.log_id, k.account_id, k.channel, k.cert_date, k.duration, k.air_secs AS cert_secs, abs(r.air_secs - k.air_secs) AS gap, r.air_secs
  FROM certs AS k JOIN logs AS r ON r.account_id = k.account_id AND r.channel = k.channel AND r.log_date = k.cert_date AND r.duration = k.duration AND abs(r.air_secs - k.air_secs) <= 5
  WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme)
    OR EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme AND tc.advt_theme = r.advt_theme AND tc.product IN ('', lower(r.product)))""",
    "concat_ws('|', account_id, channel, cert_date, duration)", "cert_id", "log_id", "cert_date, cert_secs, cert_id, gap, air_secs, log_id")


def confirmed(spark, sf_dir) -> DataFrame:
    return c.confirm(certs(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir))


@query("SELECT p.cert_id, p.log_id, abs(r.air_secs - k.air_secs) AS gap FROM confirmed AS p JOIN certs AS k ON k.cert_id = p.cert_id JOIN logs AS r ON r.log_id = p.log_id", CONFIRMED)
def cert_confirmed(spark, sf_dir):
    return confirmed(spark, sf_dir).select("cert_id", "log_id", "gap")


@query("SELECT cert_id, account_id, channel, cert_date FROM certs WHERE cert_id NOT IN (SELECT cert_id FROM confirmed)", CONFIRMED)
def cert_unconfirmed(spark, sf_dir):
    return c.extras(certs(spark, sf_dir), confirmed(spark, sf_dir)).select("cert_id", "account_id", "channel", "cert_date")


WINDOW = "CASE WHEN air_secs BETWEEN start_secs AND end_secs + 600 THEN 1 WHEN abs(air_secs - (start_secs + end_secs) / 2.0) <= 7200 THEN 2 END"

#: Confirmed certificates with the log's time; each looks at the brands of its theme in order and takes the best free spot of the first that has one.
PLACED = CONFIRMED + f""", wanted AS (SELECT DISTINCT k.cert_id, p.spot_id, dense_rank() OVER (PARTITION BY k.cert_id ORDER BY tc.brand) AS brand_turn, k.account_id, k.channel, k.duration, k.cert_date, p.spot_date, p.start_secs, p.end_secs, r.air_secs,
    {WINDOW.replace("air_secs", "r.air_secs")} AS tier
  FROM confirmed AS f JOIN certs AS k ON k.cert_id = f.cert_id JOIN logs AS r ON r.log_id = f.log_id JOIN (SELECT DISTINCT account_id, tc_theme, brand FROM tc) AS tc ON tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme
  JOIN spots AS p ON p.account_id = k.account_id AND p.channel = k.channel AND p.brand = tc.brand AND p.duration = k.duration AND k.cert_date >= p.spot_date),
turn AS (SELECT *, dense_rank() OVER (PARTITION BY account_id, channel, duration ORDER BY cert_date, cert_id) AS n FROM (SELECT DISTINCT cert_id, account_id, channel, duration, cert_date FROM wanted)),
offer AS (SELECT t.account_id, t.channel, t.duration, t.n, w.cert_id, list({{'b': w.brand_turn, 't': coalesce(w.tier, 9), 'm': CASE WHEN w.tier = 2 THEN abs(w.air_secs - (w.start_secs + w.end_secs) / 2.0) ELSE 0 END, 'd': w.spot_date, 's': w.spot_id}}
    ORDER BY w.brand_turn, coalesce(w.tier, 9), CASE WHEN w.tier = 2 THEN abs(w.air_secs - (w.start_secs + w.end_secs) / 2.0) ELSE 0 END, w.spot_date, w.spot_id) AS picks
  FROM wanted AS w JOIN turn AS t ON t.cert_id = w.cert_id GROUP BY ALL),
step AS (SELECT DISTINCT account_id, channel, duration, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS cs, CAST([] AS BIGINT[]) AS ss FROM turn
  UNION ALL SELECT account_id, channel, duration, n, CASE WHEN best.t < 9 THEN list_append(cs, cert_id) ELSE cs END, CASE WHEN best.t < 9 THEN list_append(ss, best.s) ELSE ss END FROM (
    SELECT w.account_id, w.channel, w.duration, o.n, w.cs, w.ss, o.cert_id, list_filter(o.picks, lambda x: NOT list_contains(w.ss, x.s))[1] AS best
    FROM step AS w JOIN offer AS o ON o.account_id = w.account_id AND o.channel = w.channel AND o.duration = w.duration AND o.n = w.n + 1)),
placed AS (SELECT unnest(cs) AS cert_id, unnest(ss) AS spot_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id, channel, duration ORDER BY n DESC) AS last FROM step) WHERE last = 1)"""


@query("SELECT cert_id, spot_id FROM placed", PLACED)
def cert_to_schedule(spark, sf_dir):
    return placed(spark, sf_dir).select("cert_id", "spot_id")


def placed(spark, sf_dir) -> DataFrame:
    have = confirmed(spark, sf_dir).select("cert_id", F.col("air_secs").alias("log_secs"))
    k = certs(spark, sf_dir).join(have, "cert_id").withColumn("air_secs", F.col("log_secs")).drop("log_secs")
    return c.to_schedule(k, spots(spark, sf_dir), mappings(spark, sf_dir))


LOOSE = walk("loose", """SELECT DISTINCT p.spot_id, k.cert_id, p.account_id, p.channel, p.brand, p.duration, p.spot_date, p.start_secs,
  list_position(string_split(m.tc_theme, '|'), k.tc_theme) AS place, k.cert_date, k.air_secs FROM spots AS p JOIN mappings AS m ON m.account_id = p.account_id AND m.brand = p.brand
  JOIN certs AS k ON k.account_id = p.account_id AND k.channel = p.channel AND list_contains(string_split(m.tc_theme, '|'), k.tc_theme) AND k.duration = p.duration AND k.cert_date >= p.spot_date
  WHERE k.cert_id NOT IN (SELECT cert_id FROM confirmed) AND p.spot_id NOT IN (SELECT spot_id FROM placed)""",
    "concat_ws('|', account_id, channel, brand, duration)", "spot_id", "cert_id", "spot_date, start_secs, spot_id, place, cert_date, air_secs, cert_id")


@query("SELECT cert_id, spot_id FROM loose", PLACED + ", " + LOOSE)
def cert_unconfirmed_to_schedule(spark, sf_dir):
    """Unconfirmed certificates and the spots that confirmed ones leave."""
    return chained(spark, sf_dir).filter("step = 'theme'").select("cert_id", "spot_id")


BELT = walk("belt", f"""SELECT *, CASE WHEN tier = 2 THEN abs(air_secs - (start_secs + end_secs) / 2.0) ELSE 0 END AS measure FROM (
  SELECT k.cert_id, p.spot_id, k.account_id, k.channel, k.duration, k.cert_date, p.spot_date, r.air_secs, p.start_secs, p.end_secs, {WINDOW.replace("air_secs", "r.air_secs")} AS tier
  FROM certs AS k JOIN confirmed AS f ON f.cert_id = k.cert_id JOIN logs AS r ON r.log_id = f.log_id JOIN spots AS p ON p.account_id = k.account_id AND p.channel = k.channel AND p.duration = k.duration AND k.cert_date >= p.spot_date
  WHERE p.ad_type = 'COMMERCIAL BENEFITS' AND k.cert_id NOT IN (SELECT cert_id FROM placed) AND p.spot_id NOT IN (SELECT spot_id FROM placed) AND p.spot_id NOT IN (SELECT spot_id FROM loose)) WHERE tier IS NOT NULL""",
    "concat_ws('|', account_id, channel, duration)", "cert_id", "spot_id", "cert_date, cert_id, tier, measure, spot_date, spot_id")


def chained(spark, sf_dir) -> DataFrame:
    return c.chain(certs(spark, sf_dir), logs(spark, sf_dir), spots(spark, sf_dir), mappings(spark, sf_dir))


@query("SELECT cert_id, spot_id FROM belt", PLACED + ", " + LOOSE + ", " + BELT)
def cert_time_belt(spark, sf_dir):
    """Confirmed certificates that no spot of a brand took, on the spots that the earlier steps leave."""
    return chained(spark, sf_dir).filter("step = 'belt'").select("cert_id", "spot_id")


@query("SELECT cert_id, spot_id FROM belt", PLACED + ", " + LOOSE + ", " + BELT)
def cert_time_belt_fallback(spark, sf_dir):
    """The same by its steps: what confirmed and unconfirmed certificates leave goes to ``time_belt``."""
    k, p, m = certs(spark, sf_dir), spots(spark, sf_dir), mappings(spark, sf_dir)
    have = materialize(confirmed(spark, sf_dir).select("cert_id", F.col("air_secs").alias("log_secs")))
    timed = k.join(have, "cert_id").withColumn("air_secs", F.coalesce("log_secs", "air_secs")).drop("log_secs")
    on = materialize(c.to_schedule(timed, p, m).select("cert_id", "spot_id"))
    p = p.join(on, "spot_id", "left_anti")
    loose = c.unconfirmed_to_schedule(c.extras(k, have), p, m)
    return c.time_belt(c.extras(timed, on), p.join(loose.select("spot_id"), "spot_id", "left_anti")).select("cert_id", "spot_id")


@query("""SELECT k.cert_id, CASE WHEN p.cert_id IS NOT NULL THEN 'brand' WHEN l.cert_id IS NOT NULL THEN 'theme' WHEN b.cert_id IS NOT NULL THEN 'belt' ELSE 'extra' END AS step, f.log_id, coalesce(p.spot_id, l.spot_id, b.spot_id) AS spot_id
  FROM certs AS k LEFT JOIN confirmed AS f ON f.cert_id = k.cert_id LEFT JOIN placed AS p ON p.cert_id = k.cert_id LEFT JOIN loose AS l ON l.cert_id = k.cert_id LEFT JOIN belt AS b ON b.cert_id = k.cert_id""", PLACED + ", " + LOOSE + ", " + BELT)
def cert_chain(spark, sf_dir):
    """Every certificate with the step that placed it, its log row and its spot."""
    return chained(spark, sf_dir)


@query("SELECT cert_id, log_id, true AS by_map FROM by_map UNION ALL SELECT cert_id, log_id, false FROM rest", THEMES + ", " + TC + ", " + walk("by_map", """SELECT k.cert_id, r.log_id, k.account_id, k.cert_date,
    k.air_secs AS cert_secs, abs(r.air_secs - k.air_secs) AS gap, r.air_secs FROM certs AS k JOIN logs AS r ON r.account_id = k.account_id AND r.log_date = k.cert_date AND r.duration = k.duration
    AND r.advt_theme = 'theme 13' AND abs(r.air_secs - k.air_secs) <= 5 WHERE k.tc_theme = 'tc theme 13'""",
    "concat_ws('|', account_id, cert_date)", "cert_id", "log_id", "cert_date, cert_secs, cert_id, gap, air_secs, log_id") + ", " + walk("rest", """SELECT k.cert_id, r.log_id, k.account_id, k.channel, k.cert_date, k.duration,
    k.air_secs AS cert_secs, abs(r.air_secs - k.air_secs) AS gap, r.air_secs FROM certs AS k JOIN logs AS r ON r.account_id = k.account_id AND r.channel = k.channel AND r.log_date = k.cert_date AND r.duration = k.duration
    AND abs(r.air_secs - k.air_secs) <= 5 WHERE k.tc_theme <> 'tc theme 13' AND r.log_id NOT IN (SELECT log_id FROM by_map) AND (NOT EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme)
    OR EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme AND tc.advt_theme = r.advt_theme AND tc.product IN ('', lower(r.product))))""",
    "concat_ws('|', account_id, channel, cert_date, duration)", "cert_id", "log_id", "cert_date, cert_secs, cert_id, gap, air_secs, log_id"))
def cert_log_standalone(spark, sf_dir):
    """With a theme map for theme 13, which no brand has."""
    k = certs(spark, sf_dir)
    theme_map = k.filter("tc_theme = 'tc theme 13'").select("account_id", "tc_theme", F.lit(None).cast("int").alias("tc_duration"), F.lit("theme 13").alias("log_theme"), F.lit(None).cast("int").alias("log_duration")).distinct()
    return c.standalone(k, logs(spark, sf_dir), mappings(spark, sf_dir), theme_map).select("cert_id", "log_id", "by_map")


SPONSORED = "spon AS (SELECT * FROM spots WHERE ad_type = 'SPONSORSHIP')"


def sponsored(spark, sf_dir) -> DataFrame:
    return spots(spark, sf_dir).filter("ad_type = 'SPONSORSHIP'")


IN_TURN = SPONSORED + """, fifo AS (SELECT p.spot_id, r.log_id FROM
  (SELECT p.*, m.theme, row_number() OVER (PARTITION BY p.account_id, p.channel, m.theme, p.duration ORDER BY p.spot_date, p.start_secs, lower(p.brand), p.spot_id) AS n FROM spon AS p JOIN mappings AS m ON m.account_id = p.account_id AND m.brand = p.brand) AS p
  JOIN (SELECT *, row_number() OVER (PARTITION BY account_id, channel, advt_theme, duration ORDER BY log_date, air_secs, log_id) AS n FROM logs) AS r
  ON r.account_id = p.account_id AND r.channel = p.channel AND r.advt_theme = p.theme AND r.duration = p.duration AND r.n = p.n)"""


def fifo(spark, sf_dir) -> DataFrame:
    return s.in_turn(sponsored(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir))


@query("SELECT * FROM fifo", IN_TURN)
def sponsorship_fifo(spark, sf_dir):
    return fifo(spark, sf_dir)


@query("SELECT account_id, channel, brand, duration, count(*) AS required, count(log_id) AS assigned, count(*) - count(log_id) AS remaining FROM spon LEFT JOIN fifo USING (spot_id) GROUP BY ALL", IN_TURN)
def sponsorship_targets(spark, sf_dir):
    return s.targets(sponsored(spark, sf_dir), fifo(spark, sf_dir))


DEALS = SPONSORED + """, deals AS (SELECT min(spot_id) AS deal_id, account_id, channel, brand, duration, min(spot_date) AS start_date, max(spot_date) AS end_date, count(*) AS planned_count FROM spon GROUP BY account_id, channel, brand, duration)"""
COVERED = THEMES + ", " + DEALS + """, covered AS (SELECT r.log_id, min(d.deal_id) AS deal_id, any_value(r.log_date) AS log_date FROM deals AS d JOIN themes AS t ON t.account_id = d.account_id AND t.brand = d.brand
  JOIN logs AS r ON r.account_id = d.account_id AND r.channel = d.channel AND r.advt_theme = t.advt_theme AND r.duration = d.duration AND r.log_date BETWEEN d.start_date AND d.end_date GROUP BY r.log_id)"""


def deals(spark, sf_dir) -> DataFrame:
    p = sponsored(spark, sf_dir)
    ids = p.groupBy("account_id", "channel", "brand", "duration").agg(F.min("spot_id").alias("deal_id"))
    return s.deals_from_schedule(p).join(ids, ["account_id", "channel", "brand", "duration"])


@query("SELECT account_id, channel, brand, duration, start_date, end_date, planned_count FROM deals", DEALS)
def period_import(spark, sf_dir):
    return s.deals_from_schedule(sponsored(spark, sf_dir))


OVERLAPPING = THEMES + ", " + SPONSORED + """, deals AS (SELECT min(spot_id) * 2 AS deal_id, account_id, channel, brand, duration, min(spot_date) AS start_date, max(spot_date) AS end_date FROM spon GROUP BY account_id, channel, brand, duration, schedule_number
  UNION ALL SELECT min(spot_id) * 2 + 1, account_id, channel, brand, NULL, min(spot_date) + CAST(min(spot_id) % 5 AS INTEGER), max(spot_date) FROM spon GROUP BY account_id, channel, brand, date_trunc('month', spot_date))"""


@query("""SELECT r.log_id, min(d.deal_id) AS deal_id, any_value(r.log_date) AS log_date FROM deals AS d JOIN themes AS t ON t.account_id = d.account_id AND t.brand = d.brand JOIN logs AS r ON r.account_id = d.account_id AND r.channel = d.channel
  AND r.advt_theme = t.advt_theme AND (d.duration IS NULL OR r.duration = d.duration) AND r.log_date BETWEEN d.start_date AND d.end_date GROUP BY r.log_id""", OVERLAPPING)
def overlapping_deals(spark, sf_dir):
    """Airings by the deal that counts them, where deals of each schedule and monthly ones of any duration overlap."""
    p = sponsored(spark, sf_dir)
    span = (F.min("spot_date").alias("start_date"), F.max("spot_date").alias("end_date"), F.min("spot_id").alias("_id"))
    one = p.groupBy("account_id", "channel", "brand", "duration", "schedule_number").agg(*span).withColumn("deal_id", F.col("_id") * 2)
    month = p.groupBy("account_id", "channel", "brand", F.trunc("spot_date", "month").alias("_m")).agg(*span).withColumns({"deal_id": F.col("_id") * 2 + 1, "duration": F.lit(None).cast("int"), "start_date": F.expr("date_add(start_date, cast(_id % 5 as int))")})
    cols = ["deal_id", "account_id", "channel", "brand", "duration", "start_date", "end_date"]
    return s.cover(one.select(cols).unionByName(month.select(cols)), logs(spark, sf_dir), mappings(spark, sf_dir))


@query("""SELECT d.*, coalesce(found, 0) AS found, coalesce(days_covered, 0) AS days_covered, greatest(0, planned_count - coalesce(found, 0)) AS short, greatest(0, coalesce(found, 0) - planned_count) AS extra
  FROM deals AS d LEFT JOIN (SELECT deal_id, count(*) AS found, count(DISTINCT log_date) AS days_covered FROM covered GROUP BY deal_id) AS c ON c.deal_id = d.deal_id""", COVERED)
def period_coverage(spark, sf_dir):
    d = deals(spark, sf_dir)
    return s.coverage(d, s.cover(d, logs(spark, sf_dir), mappings(spark, sf_dir)))


@query("SELECT account_id, channel, advt_theme, duration, count(*) AS n, min(log_date) AS first_date, max(log_date) AS last_date FROM logs WHERE log_id NOT IN (SELECT log_id FROM fifo) GROUP BY ALL", IN_TURN)
def free_log_groups(spark, sf_dir):
    return s.free_groups(logs(spark, sf_dir), fifo(spark, sf_dir))


@query("""SELECT d.deal_id, r.log_id, r.log_date, r.air_secs FROM deals AS d JOIN themes AS t ON t.account_id = d.account_id AND t.brand = d.brand
  JOIN logs AS r ON r.account_id = d.account_id AND r.channel = d.channel AND r.advt_theme = t.advt_theme AND r.log_date BETWEEN d.start_date AND last_day(d.end_date + INTERVAL 1 MONTH)
  WHERE r.log_id NOT IN (SELECT log_id FROM covered)""", COVERED)
def sponsorship_candidates(spark, sf_dir):
    d = deals(spark, sf_dir)
    claimed = s.cover(d, logs(spark, sf_dir), mappings(spark, sf_dir))
    return s.candidates(d, logs(spark, sf_dir), mappings(spark, sf_dir), claimed)


@query("""SELECT request_id, spot_id, log_id, CASE WHEN NOT ok THEN 'missing' WHEN taken THEN 'log taken' WHEN held THEN 'spot taken' ELSE 'created' END AS result FROM (
  SELECT q.spot_id AS request_id, q.spot_id, q.spot_id + 1 AS log_id, q.spot_id + 1 IN (SELECT log_id FROM logs) AS ok, q.spot_id + 1 IN (SELECT log_id FROM fifo) AS taken, q.spot_id IN (SELECT spot_id FROM fifo) AS held FROM spon AS q)""", IN_TURN)
def manual_assignments(spark, sf_dir):
    """A request for every sponsorship spot, for the log row of the next number."""
    p = sponsored(spark, sf_dir)
    requests = p.select(F.col("spot_id").alias("request_id"), "spot_id", (F.col("spot_id") + 1).alias("log_id"))
    return s.manual_assign(requests, p, logs(spark, sf_dir), fifo(spark, sf_dir).withColumnRenamed("spot_id", "left_id"))


SUMMARY = CONFIRMED + """, comm AS (SELECT account_id, channel, brand, duration, count(*) AS planned FROM spots WHERE ad_type = 'COMMERCIAL BENEFITS' GROUP BY ALL),
third AS (SELECT k.account_id, k.channel, b.brand, k.duration, count(*) AS t FROM certs AS k JOIN confirmed AS f ON f.cert_id = k.cert_id JOIN (SELECT DISTINCT account_id, tc_theme, brand FROM tc) AS b ON b.account_id = k.account_id AND b.tc_theme = k.tc_theme GROUP BY ALL),
summary AS (SELECT c.account_id, c.channel, c.brand, c.duration, planned, coalesce(t, 0) AS aired, coalesce(t, 0) AS third_party, greatest(0, planned - coalesce(t, 0)) AS missed, greatest(0, coalesce(t, 0) - planned) AS extra
  FROM comm AS c LEFT JOIN third ON third.account_id = c.account_id AND third.channel = c.channel AND third.brand = c.brand AND third.duration = c.duration)"""


def summary(spark, sf_dir) -> DataFrame:
    from spotcheck.operators.mapping import certificate_themes

    k, m = certs(spark, sf_dir), mappings(spark, sf_dir)
    brand_of = certificate_themes(m, k).join(m.select("account_id", F.lower("brand").alias("brand_key"), "brand").distinct(), ["account_id", "brand_key"]).select("account_id", "tc_theme", "brand").distinct()
    have = k.join(confirmed(spark, sf_dir).select("cert_id"), "cert_id", "left_semi").join(brand_of, ["account_id", "tc_theme"])
    return y.commercial(commercial(spark, sf_dir), have, m)


@query("SELECT * FROM summary", SUMMARY)
def summary_commercial(spark, sf_dir):
    return summary(spark, sf_dir)


@query("""SELECT account_id, channel, CAST(sum(planned) AS BIGINT) AS planned, CAST(sum(aired) AS BIGINT) AS aired, CAST(sum(missed) AS BIGINT) AS missed, round_even(sum(aired) * 100.0 / sum(planned), 1)::DOUBLE AS percent,
  CASE WHEN sum(aired) = 0 THEN 'not_reconciled' WHEN sum(missed) > 0 THEN 'has_missed' ELSE 'all_clear' END AS status FROM summary GROUP BY account_id, channel""", SUMMARY)
def summary_scope_card(spark, sf_dir):
    return y.scope_card(summary(spark, sf_dir))


@query("SELECT account_id, channel, brand, CAST(sum(planned) AS BIGINT) AS planned, CAST(sum(aired) AS BIGINT) AS aired, CAST(grouping(account_id) + grouping(channel) + grouping(brand) AS INTEGER) AS level FROM summary GROUP BY ROLLUP (account_id, channel, brand)", SUMMARY)
def summary_rollup(spark, sf_dir):
    return y.totals(summary(spark, sf_dir), "account_id", "channel", "brand")


@query("""SELECT p.account_id, p.channel, p.programme, p.brand, p.duration, count(*) AS planned, count(DISTINCT f.log_id) AS aired,
  CASE WHEN count(DISTINCT f.log_id) = 0 THEN 'no_data' WHEN count(DISTINCT f.log_id) >= count(*) THEN 'complete' ELSE 'incomplete' END AS status
  FROM spon AS p LEFT JOIN fifo AS f ON f.spot_id = p.spot_id GROUP BY ALL""", IN_TURN)
def summary_sponsorship(spark, sf_dir):
    p = sponsored(spark, sf_dir)
    evidence = p.join(fifo(spark, sf_dir), "spot_id")
    return y.sponsorship(p, evidence, evidence)


@query("""SELECT p.account_id, p.channel, planned, first_date, last_date, log_until, coalesce(log_rows, 0) AS log_rows, coalesce(aired, 0) AS aired, coalesce(missed, 0) AS missed, coalesce(log_until >= last_date + 7, false) AS covered,
  CASE WHEN coalesce(log_rows, 0) = 0 THEN 'grey' WHEN coalesce(missed, 0) > 0 THEN 'red' WHEN log_until >= last_date + 7 THEN 'green' ELSE 'amber' END AS dot
  FROM (SELECT account_id, channel, count(*) AS planned, min(spot_date) AS first_date, max(spot_date) AS last_date FROM spots GROUP BY ALL) AS p
  LEFT JOIN (SELECT account_id, channel, max(log_date) AS log_until, count(*) AS log_rows FROM logs GROUP BY ALL) AS r USING (account_id, channel)
  LEFT JOIN (SELECT account_id, channel, count(log_id) AS aired, count(*) FILTER (status = 'not_aired') AS missed FROM verdicts GROUP BY ALL) AS v USING (account_id, channel)""", VERDICTS)
def campaign_board(spark, sf_dir):
    return y.campaign_board(spots(spark, sf_dir), logs(spark, sf_dir), verdicts(spark, sf_dir))


_pct = lambda base, rate: f"CAST(round(CAST({base} AS DECIMAL(30,8)) * {rate} / 100, 2) AS DECIMAL(16,2))"
COSTS = """costs AS (SELECT account_id, batch, CAST(sum(cost) AS DECIMAL(16,2)) AS schedule_cost, CAST(coalesce(sum(cost) FILTER (ad_position = 7), 0) AS DECIMAL(16,2)) AS deviated_cost FROM ads GROUP BY account_id, batch)"""


def costs(spark, sf_dir) -> DataFrame:
    from spotcheck.sources.projection import ads

    last = F.coalesce(F.sum(F.when(F.col("ad_position") == 7, F.col("cost"))), F.lit(0))
    return ads(spark, sf_dir).groupBy("account_id", "batch").agg(F.sum("cost").cast("decimal(16,2)").alias("schedule_cost"), last.cast("decimal(16,2)").alias("deviated_cost"))


@query(f"""SELECT account_id, batch, schedule_cost, deviated_cost, net, levy, media_house, agency, client, sub_total, vat, CAST(sub_total + vat AS DECIMAL(16,2)) AS total_with_taxes, CAST(media_house + agency + client AS DECIMAL(16,2)) AS split_total FROM (
  SELECT *, {_pct('sub_total', 18)} AS vat FROM (SELECT *, CAST(net + levy AS DECIMAL(16,2)) AS sub_total FROM (SELECT *, {_pct('net', 2.5)} AS levy, {_pct('net', 85)} AS media_house, {_pct('net', 10.75)} AS agency, {_pct('net', 4.25)} AS client
  FROM (SELECT *, CAST(schedule_cost - deviated_cost AS DECIMAL(16,2)) AS net FROM costs))))""", COSTS)
def recon_financials(spark, sf_dir):
    return y.financials(costs(spark, sf_dir))


@query(f"""SELECT *, CAST(before_vat + vat AS DECIMAL(16,2)) AS final, {_pct('schedule_cost', 85)} AS payable_to_media, {_pct('schedule_cost', 3)} AS global_share, {_pct('schedule_cost', 12)} AS agency_commission,
  {_pct('schedule_cost', 88)} AS client_88, {_pct('CAST(before_vat + vat AS DECIMAL(16,2))', 88)} AS client_88_with_vat FROM (SELECT *, {_pct('before_vat', 18)} AS vat FROM (SELECT *, CAST(net_cost + levy AS DECIMAL(16,2)) AS before_vat
  FROM (SELECT *, {_pct('net_cost', 2.5)} AS levy FROM (SELECT *, CAST(schedule_cost - deviated_cost AS DECIMAL(16,2)) AS net_cost FROM costs))))""", COSTS)
def cost_breakdown(spark, sf_dir):
    return y.cost_breakdown(costs(spark, sf_dir))


@query("""SELECT account_id, channel, programme, start_secs, duration, date, status, count(*) AS n FROM (
  SELECT *, spot_date AS date, CASE WHEN status = 'late_telecast' THEN 'not_aired' ELSE status END AS st FROM verdicts UNION ALL
  SELECT v.*, r.log_date, 'late_telecast' FROM verdicts AS v JOIN logs AS r ON r.log_id = v.log_id WHERE v.status = 'late_telecast') AS x(spot_id, account_id, channel, schedule_number, brand, spot_date, start_secs, end_secs, duration, programme, old, pass, log_id, date, status)
  GROUP BY account_id, channel, programme, start_secs, duration, date, status""", VERDICTS)
def status_map(spark, sf_dir):
    return y.status_map(verdicts(spark, sf_dir), logs(spark, sf_dir))


@query("""SELECT p.spot_id, CASE WHEN k.cert_date IS NULL THEN CASE WHEN row_number() OVER (PARTITION BY p.account_id, p.channel, p.brand, p.duration, k.cert_date IS NULL ORDER BY p.spot_date, p.start_secs, p.spot_id)
    <= greatest(0, coalesce(z.aired, 0) - count(k.cert_date) OVER (PARTITION BY p.account_id, p.channel, p.brand, p.duration)) THEN 'matched' ELSE 'missed' END WHEN k.cert_date > p.spot_date THEN 'late' ELSE 'matched' END AS status
  FROM spots AS p LEFT JOIN (SELECT placed.spot_id, certs.cert_date FROM placed JOIN certs USING (cert_id)) AS k ON k.spot_id = p.spot_id LEFT JOIN summary AS z ON z.account_id = p.account_id AND z.channel = p.channel AND z.brand = p.brand AND z.duration = p.duration""",
       PLACED + SUMMARY[len(CONFIRMED):])
def certificate_status_map(spark, sf_dir):
    k = placed(spark, sf_dir).select("spot_id", "cert_date")
    return y.certificate_status_map(spots(spark, sf_dir), k, summary(spark, sf_dir)).select("spot_id", "status")


@query("""SELECT p.*, coalesce(observed, 0) AS observed, CASE WHEN coalesce(observed, 0) = 0 THEN 'not_aired' WHEN observed < planned THEN 'aired_less' ELSE 'matched' END AS status
  FROM (SELECT account_id, channel, brand, spot_date AS date, count(*) AS planned FROM spon GROUP BY ALL) AS p LEFT JOIN (SELECT r.account_id, r.channel, t.brand, r.log_date AS date, count(*) AS observed FROM logs AS r JOIN themes AS t ON t.account_id = r.account_id AND t.advt_theme = r.advt_theme GROUP BY ALL) AS o USING (account_id, channel, brand, date)""",
       THEMES + ", " + SPONSORED)
def sponsorship_days(spark, sf_dir):
    m, r = mappings(spark, sf_dir), logs(spark, sf_dir)
    themes = brand_themes(m, r).join(m.select("account_id", F.lower("brand").alias("brand_key"), "brand").distinct(), ["account_id", "brand_key"]).select("account_id", "advt_theme", "brand").distinct()
    return y.sponsorship_days(sponsored(spark, sf_dir), r, themes)


@query("SELECT account_id, channel, brand, programme, start_secs, duration, " + ", ".join(f"count(*) FILTER (day(spot_date) = {d}) AS d{d}" for d in range(1, 32)) + " FROM spots GROUP BY account_id, channel, brand, programme, start_secs, duration")
def schedule_pivot(spark, sf_dir):
    return y.schedule_pivot(spots(spark, sf_dir), list(range(1, 32)))


@query("""SELECT coalesce(p.account_id, k.account_id) AS account_id, coalesce(p.channel, k.channel) AS channel, coalesce(p.brand, k.brand) AS brand, coalesce(scheduled, 0) AS scheduled, coalesce(certified, 0) AS certified, coalesce(certified, 0) - coalesce(scheduled, 0) AS diff
  FROM (SELECT account_id, channel, brand, count(*) AS scheduled FROM spots GROUP BY ALL) AS p FULL JOIN (SELECT k.account_id, k.channel, b.brand, count(*) AS certified FROM certs AS k JOIN (SELECT DISTINCT account_id, tc_theme, brand FROM tc) AS b ON b.account_id = k.account_id AND b.tc_theme = k.tc_theme GROUP BY ALL) AS k
  ON k.account_id = p.account_id AND k.channel = p.channel AND k.brand = p.brand""", THEMES + ", " + TC)
def certificate_quick_check(spark, sf_dir):
    from spotcheck.operators.mapping import certificate_themes

    k, m = certs(spark, sf_dir), mappings(spark, sf_dir)
    brand_of = certificate_themes(m, k).join(m.select("account_id", F.lower("brand").alias("brand_key"), "brand").distinct(), ["account_id", "brand_key"]).select("account_id", "tc_theme", "brand").distinct()
    return y.quick_check(spots(spark, sf_dir), k, brand_of)
