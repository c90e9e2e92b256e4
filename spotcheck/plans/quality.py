"""Queries of searches and audits where times are missing, durations don't count, or names only look alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotcheck.functions import scalars as f
from spotcheck.operators import certificates as c, quality
from spotcheck.plans.certificates import CONFIRMED, TC, confirmed
from spotcheck.plans.registry import query
from spotcheck.plans.scopes import VARIED
from spotcheck.plans.verification import THEMES
from spotcheck.plans.walk import walk
from spotcheck.sources.projection import certs, logs, mappings, spots, table


@query("""SELECT spot_id, CAST(place AS INTEGER) AS place, log_id, advt_theme, duration, gap, log_id IN (SELECT log_id FROM confirmed) AS locked FROM (
  SELECT p.spot_id, r.log_id, r.advt_theme, r.duration, abs(r.air_secs - p.start_secs) AS gap, row_number() OVER (PARTITION BY p.spot_id ORDER BY abs(r.air_secs - p.start_secs) NULLS LAST, r.air_secs NULLS LAST, r.log_id) AS place
  FROM holed AS p JOIN timeless AS r ON r.account_id = p.account_id AND r.channel = p.channel AND r.log_date = p.spot_date AND coalesce(abs(r.air_secs - p.start_secs), 0) <= 3600) WHERE place <= 10""",
       CONFIRMED + """, holed AS (SELECT * REPLACE (CASE WHEN spot_id % 6 > 0 THEN start_secs END AS start_secs) FROM spots), timeless AS (SELECT * REPLACE (CASE WHEN log_id % 9 > 0 THEN air_secs END AS air_secs) FROM logs)""")
def candidate_search_gaps(spark, sf_dir):
    """Candidates where every sixth spot has no start and every ninth airing no time; those that certificates hold are locked."""
    p = spots(spark, sf_dir).withColumn("start_secs", F.expr("if(spot_id % 6 > 0, start_secs, null)"))
    r = logs(spark, sf_dir).withColumn("air_secs", F.expr("if(log_id % 9 > 0, air_secs, null)"))
    return quality.candidate_search(p, r, claims=confirmed(spark, sf_dir).select("log_id"))


@query("SELECT cert_id, log_id FROM spun", THEMES + ", " + TC + ", " + """free AS (SELECT DISTINCT p.account_id, p.channel, date_trunc('month', p.spot_date) AS month, tc.tc_theme FROM spots AS p JOIN tc ON tc.account_id = p.account_id AND tc.brand = p.brand WHERE p.ad_type = 'SPONSORSHIP' AND p.duration = 5), """
       + walk("spun", """SELECT k.cert_id, r.log_id, k.account_id, k.channel, k.cert_date, k.air_secs AS cert_secs, abs(r.air_secs - k.air_secs) AS gap, r.air_secs
  FROM certs AS k JOIN wlogs AS r ON r.account_id = k.account_id AND r.channel = k.channel AND r.log_date = k.cert_date AND abs(r.air_secs - k.air_secs) <= 5
    AND (r.duration = k.duration OR (k.account_id, k.channel, date_trunc('month', k.cert_date), k.tc_theme) IN (SELECT (account_id, channel, month, tc_theme) FROM free))
  WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme)
    OR EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme AND tc.advt_theme = r.advt_theme AND tc.product IN ('', lower(r.product)))""",
    "concat_ws('|', account_id, channel, cert_date)", "cert_id", "log_id", "cert_date, cert_secs, cert_id, gap, air_secs, log_id").replace("wlogs AS r", "(SELECT * REPLACE (CASE WHEN log_id % 3 = 0 THEN 7 ELSE duration END AS duration) FROM logs) AS r"))
def cert_sponsored_durations(spark, sf_dir):
    """Confirmation where sponsored brands (those of five seconds) may air in any duration, and every third airing has another one."""
    k, m = certs(spark, sf_dir), mappings(spark, sf_dir)
    free = c.sponsored_themes(spots(spark, sf_dir).filter("duration = 5"), k, m)
    r = logs(spark, sf_dir).withColumn("duration", F.expr("if(log_id % 3 = 0, 7, duration)"))
    return c.confirm(k, r, m, any_duration=free).select("cert_id", "log_id")


@query("""SELECT account_id, lower(theme) AS theme, 'several brands' AS finding FROM amaps GROUP BY ALL HAVING count(DISTINCT brand) > 1
  UNION SELECT account_id, lower(theme), 'product without duration' FROM amaps WHERE product <> '' AND duration IS NULL""",
       VARIED.rstrip(", ") + ", amaps AS (SELECT * REPLACE (CASE WHEN brand IN ('Brand 5', 'Brand 6') AND account_id < 2 THEN 'Theme 5' ELSE theme END AS theme) FROM vmaps)")
def mapping_audit(spark, sf_dir):
    """Mappings of which two brands of accounts 0 and 1 share a theme, and one names a product."""
    m = mappings(spark, sf_dir).withColumn("product", F.when(F.col("brand") == "Brand 2", "gold").otherwise(""))
    m = m.withColumn("theme", F.expr("if(brand in ('Brand 5', 'Brand 6') and account_id < 2, 'Theme 5', theme)"))
    return quality.audit_mappings(m)


@query()
def mapping_look_alikes(spark, sf_dir):
    """Log themes that look like a brand and are not mapped to it; the ratio has no SQL form."""
    r = logs(spark, sf_dir).withColumn("advt_theme", F.expr("concat(if(log_id % 2 = 0, 'brand ', 'theme '), substring(advt_theme, 7))"))
    return quality.forgotten_themes(mappings(spark, sf_dir), r)


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS first_day, last_day(o_orderdate::DATE) AS last_day, last_day(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next_end FROM orders")
def month_bounds(spark, sf_dir):
    """First and last day of the month named in text, and the last one of the next."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "MMMM yyyy"))
    return o.select("o_orderkey", f.month_start(F.col("month")).alias("first_day"), f.month_end(f.month_start(F.col("month"))).alias("last_day"), f.next_month_end(F.col("month")).alias("next_end"))
