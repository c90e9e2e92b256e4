"""Queries of scopes, sources, manual links, capped and repeated runs, and of files read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotcheck.operators import certificates as c, scopes as s, verify as v, workflows
from spotcheck.plans.registry import query
from spotcheck.plans.certificates import CONFIRMED, PLACED, TC, confirmed, placed
from spotcheck.plans.reports import HEADERS, headers
from spotcheck.plans.verification import THEMES, VERDICTS, commercial, verdicts
from spotcheck.plans.walk import walk
from spotcheck.sources import ingest
from spotcheck.sources.projection import ads, certs, logs, mappings, spots
from spotcheck.sources.staging import materialize


@query("""SELECT account_id, channel, month, total_tc, matched, total_tc - matched AS unmatched_tc, coalesce(free, 0) AS unmatched_log, date_min, date_max, matched > 0 AS has_run FROM
  (SELECT account_id, channel, strftime(cert_date, '%B %Y') AS month, count(*) AS total_tc, count(f.cert_id) AS matched FROM certs AS k LEFT JOIN confirmed AS f ON f.cert_id = k.cert_id GROUP BY ALL)
  LEFT JOIN (SELECT account_id, channel, strftime(log_date, '%B %Y') AS month, count(*) FILTER (log_id NOT IN (SELECT log_id FROM confirmed)) AS free, min(log_date) AS date_min, max(log_date) AS date_max FROM logs GROUP BY ALL) USING (account_id, channel, month)""", CONFIRMED)
def scope_cards(spark, sf_dir):
    pairs = materialize(confirmed(spark, sf_dir).select("cert_id", "log_id"))
    return s.scope_cards(certs(spark, sf_dir), logs(spark, sf_dir), pairs, pairs)


@query("""SELECT 'certificate' AS side, account_id, tc_theme AS theme, duration, count(*) AS n, bool_or((account_id, tc_theme) IN (SELECT (account_id, tc_theme) FROM tc)) AS mapped FROM certs GROUP BY ALL
  UNION ALL SELECT 'log', account_id, advt_theme, duration, count(*), NULL FROM logs GROUP BY ALL""", THEMES + ", " + TC)
def theme_pairs(spark, sf_dir):
    from spotcheck.operators.mapping import certificate_themes

    k = certs(spark, sf_dir)
    return s.theme_pairs(k, logs(spark, sf_dir), certificate_themes(mappings(spark, sf_dir), k))


@query("SELECT account_id, month, count(*) AS schedules, count(DISTINCT channel) AS channels, CAST(substr(month, 1, 4) AS INTEGER) AS year FROM headers GROUP BY ALL", HEADERS)
def schedule_library(spark, sf_dir):
    return s.library(headers(spark, sf_dir))


@query("SELECT account_id, schedule_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month DESC, version DESC, schedule_id DESC) AS place FROM headers) WHERE place <= 5", HEADERS)
def latest_uploads(spark, sf_dir):
    """The latest five schedules of each account."""
    return s.first_rows(headers(spark, sf_dir), ["account_id"], [F.desc("month"), F.desc("version"), F.desc("schedule_id")], 5).select("account_id", "schedule_id", "place")


@query("""SELECT spot_id, brand, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY account_id, channel ORDER BY brand, spot_date, start_secs, spot_id) AS place FROM verdicts)""", VERDICTS)
def report_order(spark, sf_dir):
    """Rows of each scope's report in its order: brand, day, start."""
    return s.first_rows(verdicts(spark, sf_dir), ["account_id", "channel"], ["brand", "spot_date", "start_secs", "spot_id"], 1 << 30).select("spot_id", "brand", "place")


@query("""SELECT DISTINCT p.account_id, p.channel, CASE WHEN EXISTS (SELECT 1 FROM certs AS k JOIN confirmed AS f ON f.cert_id = k.cert_id WHERE k.account_id = p.account_id AND k.channel = p.channel AND k.account_id < 2) THEN 'certificates'
  WHEN EXISTS (SELECT 1 FROM verdicts AS v WHERE v.account_id = p.account_id AND v.channel = p.channel AND v.channel <> 'click') THEN 'verdicts' ELSE 'planned' END AS source FROM spots AS p""", VERDICTS + ", " + CONFIRMED.removeprefix(THEMES + ", "))
def colour_source(spark, sf_dir):
    """With certificates of accounts 0 and 1 and verdicts of all channels but one."""
    k = certs(spark, sf_dir).filter("account_id < 2")
    have = k.join(confirmed(spark, sf_dir).select("cert_id"), "cert_id", "left_semi")
    return s.colour_source(spots(spark, sf_dir), have, verdicts(spark, sf_dir).filter("channel != 'click'"))


@query("SELECT spot_id, cert_id FROM cover", PLACED + ", " + walk("cover", """SELECT p.spot_id, k.cert_id, p.account_id, p.channel, p.spot_date FROM spots AS p JOIN certs AS k ON k.account_id = p.account_id AND k.channel = p.channel AND k.cert_date = p.spot_date
  AND k.duration = p.duration AND k.air_secs BETWEEN p.start_secs AND p.end_secs + 600 WHERE k.cert_id IN (SELECT cert_id FROM confirmed) AND k.cert_id NOT IN (SELECT cert_id FROM placed) AND p.spot_id NOT IN (SELECT spot_id FROM placed)""",
    "concat_ws('|', account_id, channel, spot_date)", "spot_id", "cert_id", "spot_id, cert_id"))
def slot_coverage(spark, sf_dir):
    """Spots that no certificate of their brand was placed on, covered by confirmed certificates left over in their window."""
    on = materialize(placed(spark, sf_dir).select("cert_id", "spot_id"))
    k = certs(spark, sf_dir).join(confirmed(spark, sf_dir).select("cert_id"), "cert_id", "left_semi").join(on, "cert_id", "left_anti")
    return s.window_cover(spots(spark, sf_dir).join(on, "spot_id", "left_anti"), k)


@query("SELECT cert_id, log_id FROM loose", THEMES + ", " + TC + ", " + walk("loose", """SELECT k.cert_id, r.log_id, k.account_id, k.channel, k.cert_date, k.air_secs AS cert_secs, abs(r.air_secs - k.air_secs) AS gap, r.air_secs
  FROM certs AS k JOIN logs AS r ON r.account_id = k.account_id AND r.channel = k.channel AND r.log_date = k.cert_date AND abs(r.air_secs - k.air_secs) <= 5 AND (r.duration = k.duration OR k.tc_theme = 'tc theme 13')
  WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme)
    OR EXISTS (SELECT 1 FROM tc WHERE tc.account_id = k.account_id AND tc.tc_theme = k.tc_theme AND tc.advt_theme = r.advt_theme AND tc.product IN ('', lower(r.product)))""",
    "concat_ws('|', account_id, channel, cert_date)", "cert_id", "log_id", "cert_date, cert_secs, cert_id, gap, air_secs, log_id"))
def cert_any_duration(spark, sf_dir):
    """Confirmation where theme 13 may air in any duration."""
    k = certs(spark, sf_dir)
    return c.confirm(k, logs(spark, sf_dir), mappings(spark, sf_dir), any_duration=k.filter("tc_theme = 'tc theme 13'")).select("cert_id", "log_id")


@query("SELECT p.spot_id, l.log_id, CASE l.tier WHEN 1 THEN 'matched' WHEN 2 THEN 'shifted' ELSE 'missed' END AS status FROM spots AS p LEFT JOIN (SELECT w.*, e.tier FROM legacy AS w JOIN edges AS e ON e.spot_id = w.spot_id AND e.log_id = w.log_id) AS l ON l.spot_id = p.spot_id",
       THEMES + """, edges AS (SELECT p.spot_id, r.log_id, p.account_id, p.channel, p.duration, r.log_date, r.air_secs, CASE WHEN r.log_date = p.spot_date AND r.air_secs BETWEEN p.start_secs AND p.end_secs THEN 1 ELSE 2 END AS tier
  FROM spots AS p JOIN (SELECT account_id, brand, min(advt_theme) AS advt_theme FROM themes GROUP BY ALL) AS t ON t.account_id = p.account_id AND t.brand = p.brand
  JOIN logs AS r ON r.account_id = p.account_id AND r.channel = p.channel AND r.advt_theme = t.advt_theme AND r.duration = p.duration AND abs(r.log_date - p.spot_date) <= 1), """
       + walk("legacy", "SELECT * FROM edges", "concat_ws('|', account_id, channel, duration)", "spot_id", "log_id", "spot_id, tier, log_date, air_secs, log_id"))
def legacy_match(spark, sf_dir):
    from spotcheck.operators.mapping import brand_themes

    r = logs(spark, sf_dir)
    return v.tolerant_match(spots(spark, sf_dir), r, brand_themes(mappings(spark, sf_dir), r)).select("spot_id", "log_id", "status")


CAP = "DATE '2024-01-20'"


@query(f"SELECT spot_id, status, log_id FROM verdicts UNION ALL SELECT spot_id, 'pending', NULL FROM spots WHERE ad_type = 'COMMERCIAL BENEFITS' AND spot_date > {CAP}", "early AS (SELECT * FROM spots WHERE spot_date <= " + CAP + "), " + VERDICTS.replace("spots AS s", "early AS s"))
def verify_capped(spark, sf_dir):
    """Verification while the log reaches to a day: later spots are pending."""
    p = commercial(spark, sf_dir)
    cap = p.select("account_id", "channel").distinct().withColumn("last_date", F.lit("2024-01-20").cast("date"))
    return v.verify(p, logs(spark, sf_dir), mappings(spark, sf_dir), cap=cap).select("spot_id", "status", "log_id")


@query("SELECT spot_id, status, log_id FROM verdicts WHERE schedule_number = '102'", VERDICTS)
def smart_run(spark, sf_dir):
    """A second run after schedule 101: its verdicts stay, its airings are taken."""
    p, r, m = commercial(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir)
    first = materialize(v.verify(p.filter("schedule_number = '101'"), r, m).select("spot_id", "log_id"))
    return v.verify(p, r, m, done=first, claimed=first.filter("log_id is not null")).select("spot_id", "status", "log_id")


def _feed(sql: str) -> str:
    """SQL over the logs and mappings, over a preliminary feed instead."""
    return sql.replace("FROM logs", "FROM feed").replace("JOIN logs", "JOIN feed").replace("FROM mappings", "FROM named").replace("JOIN mappings", "JOIN named")


@query("SELECT spot_id, status, log_id FROM verdicts", """feed AS (SELECT cert_id AS log_id, account_id, channel, cert_date AS log_date, air_secs, duration, tc_theme AS advt_theme, 'prg' || air_secs // 10800 AS program, '' AS product FROM certs),
named AS (SELECT account_id, brand, split_part(tc_theme, '|', 1) AS theme, '' AS product FROM mappings), """ + _feed(VERDICTS))  # fmt: skip
def preliminary_run(spark, sf_dir):
    """Verification against the preliminary feed, under the names that it uses."""
    feed = certs(spark, sf_dir).select(F.col("cert_id").alias("log_id"), "account_id", "channel", F.col("cert_date").alias("log_date"), "air_secs", "duration", F.col("tc_theme").alias("advt_theme"), F.expr("concat('prg', air_secs div 10800)").alias("program"))
    named = mappings(spark, sf_dir).withColumns({"preliminary_theme": F.substring_index("tc_theme", "|", 1), "product": F.lit("")})
    return v.verify(commercial(spark, sf_dir), feed, named, source="preliminary_theme").select("spot_id", "status", "log_id")


EXTRA = """extra AS (SELECT account_id, channel, min(log_id) AS log_id FROM logs WHERE log_id NOT IN (SELECT log_id FROM picks) GROUP BY ALL),
linked AS (SELECT min(v.spot_id) AS spot_id, e.log_id FROM verdicts AS v JOIN extra AS e ON e.account_id = v.account_id AND e.channel = v.channel WHERE v.status = 'not_aired' GROUP BY e.log_id)"""


@query("SELECT v.spot_id, CASE WHEN k.log_id IS NOT NULL THEN 'matched' ELSE v.status END AS status, coalesce(k.log_id, v.log_id) AS log_id FROM verdicts AS v LEFT JOIN linked AS k ON k.spot_id = v.spot_id", VERDICTS + ", " + EXTRA)
def link_extra(spark, sf_dir):
    """Every missed spot asks for the first extra airing of its scope; one of them gets it."""
    done, r = materialize(verdicts(spark, sf_dir)), logs(spark, sf_dir)
    extra = r.join(done.filter("log_id is not null").select("log_id"), "log_id", "left_anti").groupBy("account_id", "channel").agg(F.min("log_id").alias("log_id"))
    asked = done.drop("log_id").join(extra, ["account_id", "channel"]).select("spot_id", "log_id")
    return workflows.link_extra(done, asked).select("spot_id", "status", "log_id")


@query("SELECT spot_id, CASE WHEN spot_id % 50 = 0 THEN 'confirmed by hand' ELSE status END AS status FROM verdicts", VERDICTS)
def manual_overrides(spark, sf_dir):
    done = materialize(verdicts(spark, sf_dir).select("spot_id", "status"))
    return workflows.with_overrides(done, done.filter("spot_id % 50 = 0").withColumn("status", F.lit("confirmed by hand")), "spot_id")


def _ad_file(spark, sf_dir):
    """The ads as a file of its own column names, every row twice, some without a date."""
    a = ads(spark, sf_dir)
    rows = a.select(F.col("advertiser").alias("Advertiser"), F.col("product").alias("Product"), F.col("advt_theme").alias("Advt_Theme"), F.col("channel").alias("Channel"), F.col("program").alias("Programme"),
                    F.dayofmonth("ad_date").alias("Dd"), F.when(F.col("ad_position") == 7, 13).otherwise(F.month("ad_date")).alias("Mn"), F.year("ad_date").alias("Yr"), F.col("air_secs").cast("string").alias("Advt_time"), F.col("duration").alias("Dur"), F.col("cost").cast("string").alias("Cost"), F.col("batch").alias("seq"))
    return rows.unionByName(rows)


FILE = "SELECT DISTINCT advertiser, product, advt_theme, channel, program, ad_date, air_secs, duration FROM ads WHERE ad_position <> 7"


@query(f"SELECT advertiser, count(*) AS ads, min(ad_date) AS first_date FROM ({FILE}) GROUP BY advertiser")
def competitor_file(spark, sf_dir):
    """A competitor file read: rows with a date, one of each key."""
    rows = ingest.competitor_ads(_ad_file(spark, sf_dir), 1, order=["seq"])
    return rows.groupBy("advertiser").agg(F.count("*").alias("ads"), F.min("date").alias("first_date"))


@query(f"SELECT count(*) AS rows, min(ad_date) AS first_date, max(ad_date) AS last_date, count(*) FILTER (year(ad_date) < 1995) AS duplicates FROM ({FILE})")
def upload_preview(spark, sf_dir):
    """A file of which the years before 1995 are known."""
    rows = materialize(ingest.competitor_ads(_ad_file(spark, sf_dir), 1, order=["seq"]))
    return ingest.upload_preview(rows, rows.filter("year(date) < 1995")).select("rows", "first_date", "last_date", "duplicates")


@query("SELECT file, row, programme, brand FROM (SELECT CAST(s_nationkey AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS row, 'Show ' || s_suppkey AS programme, s_name AS brand, s_suppkey FROM supplier) WHERE s_suppkey % 5 <> 0")
def sheet_rows(spark, sf_dir):
    """Sheets with a title, a header row and totals: every fifth row of cells holds a total."""
    from pyspark.sql.window import Window

    from spotcheck.sources.projection import table

    n = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), "s_suppkey", "s_name", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("n"))
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    total = F.col("s_suppkey") % 5 == 0
    body = [cell(F.col("n") + 1, 0, F.when(total, F.lit("Sub Total")).otherwise(F.concat(F.lit("Show "), "s_suppkey"))), cell(F.col("n") + 1, 1, F.lit("Mon")), cell(F.col("n") + 1, 2, F.lit("20:00")), cell(F.col("n") + 1, 3, F.col("s_name")), cell(F.col("n") + 1, 4, F.lit("1"))]
    top = [cell(F.lit(0), 0, F.lit("Net plan"))] + [cell(F.lit(1), i, F.lit(x)) for i, x in enumerate(("Programme", "Day", "Time", "Brand", "2025-01-01"))]
    cells = n.select("file", F.lit("s").alias("sheet"), F.explode(F.array(*body)).alias("c")).unionByName(n.select("file").distinct().select("file", F.lit("s").alias("sheet"), F.explode(F.array(*top)).alias("c")))
    return ingest.flatten_pivot(cells.select("file", "sheet", "c.*")).select("file", (F.col("row") - 1).alias("row"), "programme", "brand")


VARIED = """vlogs AS (SELECT * EXCLUDE (product), CASE WHEN advt_theme <> 'theme 2' THEN '' WHEN log_id % 4 = 0 THEN 'Silver' ELSE 'Gold' END AS product FROM logs),
vspots AS (SELECT * EXCLUDE (programme), CASE spot_id % 3 WHEN 0 THEN 'late show ' WHEN 1 THEN 'show ' ELSE '' END || programme AS programme FROM spots),
vmaps AS (SELECT * EXCLUDE (product), CASE WHEN brand = 'Brand 2' THEN 'gold' ELSE '' END AS product FROM mappings), """


def _varied(sql: str) -> str:
    """SQL over the logs, spots and mappings, over their varied forms instead."""
    for name, other in (("logs", "vlogs"), ("spots", "vspots"), ("mappings", "vmaps")):
        sql = sql.replace(f"FROM {name}", f"FROM {other}").replace(f"JOIN {name}", f"JOIN {other}")
    return sql


def varied(spark, sf_dir):
    """Logs with two products of one theme, spots whose programmes agree in part with the log's, a mapping of one product."""
    product = F.when(F.col("advt_theme") != "theme 2", "").when(F.col("log_id") % 4 == 0, "Silver").otherwise("Gold")
    named = F.concat(F.expr("case spot_id % 3 when 0 then 'late show ' when 1 then 'show ' else '' end"), F.col("programme"))
    m = mappings(spark, sf_dir).withColumn("product", F.when(F.col("brand") == "Brand 2", "gold").otherwise(""))
    return logs(spark, sf_dir).withColumn("product", product), commercial(spark, sf_dir).withColumn("programme", named), m


@query("SELECT spot_id, status, pass, log_id FROM verdicts", VARIED + _varied(VERDICTS))
def varied_verdicts(spark, sf_dir):
    """Verdicts where programmes agree in half their words, or less, and a product has to agree."""
    r, p, m = varied(spark, sf_dir)
    return v.verify(p, r, m).select("spot_id", "status", "pass", "log_id")


@query("SELECT cert_id, log_id FROM confirmed", VARIED + _varied(CONFIRMED))
def varied_certificates(spark, sf_dir):
    """Certificates confirmed where one brand needs a product in the log."""
    r, _, m = varied(spark, sf_dir)
    return c.confirm(certs(spark, sf_dir), r, m).select("cert_id", "log_id")
