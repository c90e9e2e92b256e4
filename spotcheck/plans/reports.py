"""Queries of scalars, ingest, diagnosis, quality, workflows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotcheck.functions import scalars as f
from spotcheck.operators import quality, verify, workflows
from spotcheck.operators.partials import merged, partials
from spotcheck.plans.registry import query
from spotcheck.plans.verification import THEMES, VERDICTS, verdicts
from spotcheck.sources import ingest, sinks
from spotcheck.sources.projection import certs, logs, mappings, spots, table
from spotcheck.sources.staging import shared_dir
from spotcheck.sources.words import certificate_words


@query("SELECT p_partkey, lower(trim(p_name)) AS name, lower(p_type) AS kind FROM part")
def normalize_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", f.normalize(F.concat(F.lit(" \t"), "p_name", F.lit("\n"))).alias("name"), f.normalize(F.col("p_type")).alias("kind"))


CLOCK = "lpad(CAST(air_secs // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(air_secs // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(air_secs % 60 AS VARCHAR), 2, '0')"


@query(f"SELECT log_id, {CLOCK} AS clock, CAST(air_secs AS INTEGER) AS secs, CAST(air_secs // 60 * 60 AS INTEGER) AS minutes_only, CAST(air_secs AS INTEGER) AS from_fraction, CAST(NULL AS INTEGER) AS bad FROM logs")
def time_seconds(spark, sf_dir):
    r = logs(spark, sf_dir).withColumn("clock", f.clock_text(F.col("air_secs")))
    s = f.seconds_of_day
    return r.select("log_id", "clock", s(F.col("clock")).alias("secs"), s(F.substring("clock", 1, 5)).alias("minutes_only"), s((F.col("air_secs") / 86400).cast("string")).alias("from_fraction"), s(F.lit("soon")).alias("bad"))


@query("""SELECT log_id, CASE WHEN air_secs // 3600 BETWEEN 6 AND 11 THEN 'morning' WHEN air_secs // 3600 BETWEEN 12 AND 18 THEN 'daytime' WHEN air_secs // 3600 BETWEEN 19 AND 23 THEN 'primetime' ELSE 'latenight' END AS band FROM logs""")
def time_band(spark, sf_dir):
    return logs(spark, sf_dir).select("log_id", f.time_band(F.col("air_secs")).alias("band"))


@query("SELECT log_id, lower(channel) AS clean, CASE log_id % 4 WHEN 0 THEN 'tv' WHEN 1 THEN 'radio' WHEN 2 THEN 'press' ELSE 'other' END AS media FROM logs")
def channel_clean(spark, sf_dir):
    named = F.concat(F.expr("case log_id % 4 when 0 then 'TV - ' when 1 then 'Radio - ' when 2 then 'PRESS - ' else '' end"), F.col("channel"))
    r = logs(spark, sf_dir).withColumn("name", named)
    return r.select("log_id", f.clean_channel(F.col("name")).alias("clean"), f.media_type(F.col("name")).alias("media"))


@query("SELECT spot_id, CAST(CASE WHEN end_secs % 86399 = 0 AND start_secs > 43200 THEN 86400 ELSE end_secs % 86399 END AS BIGINT) AS until FROM spots")
def window_end(spark, sf_dir):
    end = F.col("end_secs") % 86399  # a window to the day's last second ends at 00:00
    return spots(spark, sf_dir).select("spot_id", f.end_of_window(F.col("start_secs"), end).cast("bigint").alias("until"))


KEY = "substr(sha256(concat_ws('|', account_id, channel, log_date, CAST(air_secs AS VARCHAR), advt_theme, duration, '', CASE WHEN log_id % 3 = 0 THEN '' ELSE CAST(log_id % 3 AS VARCHAR) END)), 1, 32)"


def keyed(r):
    return r.withColumn("dedup_key", f.log_key(F.col("account_id"), F.col("channel"), F.col("log_date"), F.col("air_secs"), F.col("advt_theme"), F.col("duration"), F.lit(None), F.col("log_id") % 3))


@query(f"SELECT log_id, {KEY} AS dedup_key FROM logs")
def log_keys(spark, sf_dir):
    return keyed(logs(spark, sf_dir)).select("log_id", "dedup_key")


@query("SELECT l_orderkey, l_linenumber, min(l_shipdate)::DATE AS first_date, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL")
def dedup_log(spark, sf_dir):
    """Rows that stand several times become one."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("first_date"), "l_extendedprice", "l_partkey")
    first = ingest.first_per_key(line, ["l_orderkey", "l_linenumber"], ["first_date", "l_partkey", "l_extendedprice"])
    n = line.groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("repeats"))
    return first.select("l_orderkey", "l_linenumber", "first_date").join(n, ["l_orderkey", "l_linenumber"])


@query(f"SELECT min(log_id) AS log_id FROM (SELECT *, {KEY} AS k FROM logs) WHERE log_date > DATE '2024-01-15' AND k NOT IN (SELECT k FROM (SELECT {KEY} AS k FROM logs WHERE log_date <= DATE '2024-01-15')) GROUP BY k")
def new_rows_anti(spark, sf_dir):
    r = keyed(logs(spark, sf_dir))
    return ingest.append_new(r.filter("log_date > date'2024-01-15'"), r.filter("log_date <= date'2024-01-15'"), ["log_id"]).select("log_id")


@query("SELECT log_id % 7 AS batch, lower(channel) AS channel, min(log_date) AS start_date, max(log_date) AS end_date, count(*) AS row_count FROM logs GROUP BY ALL")
def channel_split(spark, sf_dir):
    return ingest.split_channels(logs(spark, sf_dir).withColumn("batch", F.col("log_id") % 7), "batch", "channel", "log_date")


@query("""SELECT 'preliminary' AS _source, cert_id AS id, cert_date AS "Date", tc_theme AS "Advt_Theme", CAST(duration AS INTEGER) AS "Dur" FROM certs
  UNION ALL SELECT 'authoritative', log_id, CASE WHEN log_id % 20 = 1 THEN NULL ELSE log_date END, advt_theme, duration FROM logs""")
def feed_union(spark, sf_dir):
    """A preliminary and an authoritative feed in their own column names; bad dates are null."""
    a = certs(spark, sf_dir).select(F.col("cert_id").alias("id"), F.col("cert_date").cast("string").alias("Prg Date"), F.col("tc_theme").alias("Theme"), F.col("duration").alias("Ad Dur"))
    month = F.when(F.col("log_id") % 20 == 1, 13).otherwise(F.month("log_date"))
    b = logs(spark, sf_dir).select(F.col("log_id").alias("id"), F.dayofmonth("log_date").alias("Dd"), month.alias("Mn"), F.year("log_date").alias("Yr"), F.col("advt_theme").alias("Advt_Theme"), F.col("duration").alias("Dur"))
    return ingest.pool({"preliminary": a, "authoritative": b}).select("_source", "id", "Date", "Advt_Theme", "Dur")


HEADERS = """headers AS (SELECT o_orderkey AS schedule_id, o_custkey % 5 AS account_id, o_orderstatus AS channel, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS schedule_number,
  CAST(row_number() OVER (PARTITION BY o_custkey % 5, o_orderstatus, strftime(o_orderdate, '%Y-%m'), o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS version,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS parent_schedule_id FROM orders)"""


def headers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as schedule_id", "o_custkey % 5 as account_id", "o_orderstatus as channel", "date_format(o_orderdate, 'yyyy-MM') as month", "o_orderpriority as schedule_number", "if(o_orderkey % 3 = 0, o_orderkey - 1, null) as parent_schedule_id")
    return workflows.next_versions(o.limit(0).withColumn("version", F.lit(0)), o)


@query("SELECT schedule_id, version FROM headers QUALIFY row_number() OVER (PARTITION BY account_id, channel, month, schedule_number ORDER BY version DESC) = 1", HEADERS)
def latest_version(spark, sf_dir):
    return verify.latest_versions(headers(spark, sf_dir)).select("schedule_id", "version")


@query("""SELECT a.schedule_id, a.parent_schedule_id FROM act AS a JOIN act AS p ON p.schedule_id = a.parent_schedule_id WHERE p.parent_schedule_id IS NULL""",
       HEADERS + ", act AS (SELECT * FROM headers QUALIFY row_number() OVER (PARTITION BY account_id, channel, month, schedule_number ORDER BY version DESC) = 1)")
def makeup_schedules(spark, sf_dir):
    return verify.makeup_schedules(headers(spark, sf_dir)).select("schedule_id", "parent_schedule_id")


@query("SELECT schedule_id, version < max(version) OVER (PARTITION BY account_id, channel, month, schedule_number) AS is_superseded FROM headers", HEADERS)
def superseded(spark, sf_dir):
    return workflows.supersede(headers(spark, sf_dir)).select("schedule_id", "is_superseded")


@query("""SELECT spot_id, CASE WHEN brand IN ('Brand 13', 'Brand 14') THEN 'no mapping' WHEN NOT EXISTS (SELECT 1 FROM rows AS r WHERE r.account_id = v.account_id AND r.channel = v.channel AND r.brand = v.brand) THEN 'theme not in log'
  WHEN NOT EXISTS (SELECT 1 FROM rows AS r WHERE r.account_id = v.account_id AND r.channel = v.channel AND r.brand = v.brand AND r.duration = v.duration) THEN 'other durations only'
  WHEN NOT EXISTS (SELECT 1 FROM rows AS r WHERE r.account_id = v.account_id AND r.channel = v.channel AND r.brand = v.brand AND r.duration = v.duration AND r.log_date = v.spot_date) THEN 'other days only'
  WHEN n IS NULL THEN 'claimed by other spots' WHEN matchable THEN 'should match' WHEN after IS NOT NULL THEN 'after the window' ELSE 'before the window' END AS reason,
  CASE WHEN n IS NOT NULL AND NOT matchable THEN after END AS after_secs FROM (SELECT v.spot_id, any_value(v.account_id) AS account_id, any_value(v.channel) AS channel, any_value(v.brand) AS brand, any_value(v.duration) AS duration, any_value(v.spot_date) AS spot_date,
    count(r.log_id) AS c, CASE WHEN count(r.log_id) > 0 THEN count(r.log_id) END AS n, min(CASE WHEN r.air_secs > v.end_secs THEN r.air_secs - v.end_secs END) AS after,
    bool_or(r.air_secs BETWEEN v.start_secs AND v.end_secs OR r.air_secs - v.end_secs BETWEEN 1 AND 600 OR len(list_intersect(string_split(v.programme, ' '), string_split(r.program, ' '))) * 2 >= len(string_split(v.programme, ' '))) AS matchable
    FROM verdicts AS v LEFT JOIN free AS r ON r.account_id = v.account_id AND r.channel = v.channel AND r.brand = v.brand AND r.duration = v.duration AND r.log_date = v.spot_date WHERE v.log_id IS NULL GROUP BY v.spot_id) AS v""",
       VERDICTS + ", rows AS (SELECT r.*, t.brand FROM logs AS r JOIN themes AS t ON t.account_id = r.account_id AND t.advt_theme = r.advt_theme), free AS (SELECT * FROM rows WHERE log_id NOT IN (SELECT log_id FROM picks))")
def diagnose(spark, sf_dir):
    return quality.diagnose(verdicts(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir))


@query("""SELECT spot_id, CAST(place AS INTEGER) AS place, log_id, advt_theme, duration, gap, false AS locked FROM (SELECT p.spot_id, r.log_id, r.advt_theme, r.duration, abs(r.air_secs - p.start_secs) AS gap,
  row_number() OVER (PARTITION BY p.spot_id ORDER BY abs(r.air_secs - p.start_secs), r.air_secs, r.log_id) AS place FROM spots AS p JOIN logs AS r ON r.account_id = p.account_id AND r.channel = p.channel AND r.log_date = p.spot_date AND abs(r.air_secs - p.start_secs) <= 3600) WHERE place <= 10""")
def candidate_search(spark, sf_dir):
    return quality.candidate_search(spots(spark, sf_dir), logs(spark, sf_dir))


@query("""SELECT account_id, count(*) FILTER (m) AS mapped, count(*) FILTER (NOT m) AS unmapped, CAST(coalesce(sum(n) FILTER (m), 0) AS BIGINT) AS mapped_spots, coalesce(array_to_string(list(brand ORDER BY brand) FILTER (NOT m), ','), '') AS unmapped_brands
  FROM (SELECT account_id, brand, count(*) AS n, (account_id, brand) IN (SELECT (account_id, brand) FROM mappings) AS m FROM spots GROUP BY account_id, brand) GROUP BY account_id""")
def mapping_coverage(spark, sf_dir):
    return quality.mapping_coverage(spots(spark, sf_dir), mappings(spark, sf_dir)).withColumn("unmapped_brands", F.array_join("unmapped_brands", ","))


@query("SELECT account_id, advt_theme, count(*) AS n, min(log_date) AS first_date, max(log_date) AS last_date, count(DISTINCT channel) AS channels FROM logs WHERE (account_id, advt_theme) NOT IN (SELECT (account_id, advt_theme) FROM themes) GROUP BY ALL", THEMES)
def unmapped_themes(spark, sf_dir):
    return quality.unmapped_themes(logs(spark, sf_dir), mappings(spark, sf_dir))


@query("SELECT 'verdicts' AS \"table\", col AS \"column\", n AS rows, round_even(k * 100.0 / n, 1)::DOUBLE AS filled FROM (SELECT count(*) AS n, unnest(['spot_id', 'status', 'log_id']) AS col, unnest([count(spot_id), count(status), count(log_id)]) AS k FROM verdicts)", VERDICTS)
def quality_scorecard(spark, sf_dir):
    return quality.scorecard(verdicts(spark, sf_dir).select("spot_id", "status", "log_id"), "verdicts")


@query("SELECT account_id, channel, min(log_date) AS first_date, max(log_date) AS last_date, count(*) AS n, count(DISTINCT log_date) AS days FROM logs GROUP BY ALL")
def log_coverage(spark, sf_dir):
    return quality.log_coverage(logs(spark, sf_dir))


@query("""SELECT spot_id, account_id, channel, CAST(turn AS INTEGER) AS turn, status, log_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY account_id, channel ORDER BY spot_date, start_secs, spot_id) AS turn FROM (SELECT * EXCLUDE (log_id, pass) FROM verdicts WHERE status IN ('not_aired', 'no_mapping'))) AS v
  LEFT JOIN LATERAL (SELECT log_id, abs(r.air_secs - v.start_secs) AS gap FROM logs AS r WHERE r.account_id = v.account_id AND r.channel = v.channel AND r.log_date = v.spot_date AND abs(r.air_secs - v.start_secs) <= 3600
    ORDER BY abs(r.air_secs - v.start_secs), r.air_secs, r.log_id LIMIT 1) AS b ON true WHERE turn <= 25""", VERDICTS)
def investigate_missed(spark, sf_dir):
    return quality.investigate(verdicts(spark, sf_dir), logs(spark, sf_dir))


@query("SELECT k.cert_id, r.log_id, abs(r.air_secs - k.air_secs) AS gap FROM certs AS k JOIN logs AS r ON r.account_id = k.account_id AND r.channel = k.channel AND r.log_date = k.cert_date AND abs(r.air_secs - k.air_secs) <= 300")
def certificate_echoes(spark, sf_dir):
    return quality.root_causes(certs(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir))[1]


@query()
def fuzzy_themes(spark, sf_dir):
    """Mapped themes most similar to each certificate theme; the ratio has no SQL form."""
    return quality.root_causes(certs(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir))[0]


@query("SELECT CASE WHEN status = 'late_telecast' THEN 'Late telecast' WHEN status = 'matched' THEN 'Matched' WHEN status = 'mismatch' THEN 'Programme mismatch' WHEN status = 'not_aired' THEN 'Not aired' ELSE 'No mapping' END AS label, brand, count(*) AS total FROM verdicts GROUP BY ALL", VERDICTS)
def report_by_brand(spark, sf_dir):
    return sinks.report_sheets(verdicts(spark, sf_dir), logs(spark, sf_dir))["full"].groupBy("label", "brand").agg(F.count("*").alias("total"))


@query("SELECT channel, count(*) AS total, count(*) FILTER (status IN ('matched', 'mismatch', 'late_telecast')) AS aired, round_even(count(*) FILTER (status IN ('matched', 'mismatch', 'late_telecast')) * 100.0 / count(*), 1)::DOUBLE AS percent FROM verdicts GROUP BY channel", VERDICTS)
def report_by_channel(spark, sf_dir):
    return sinks.report_sheets(verdicts(spark, sf_dir), logs(spark, sf_dir))["channel_summary"]


@query("SELECT log_id FROM logs WHERE log_id NOT IN (SELECT log_id FROM picks)", VERDICTS)
def report_unmatched_log(spark, sf_dir):
    return sinks.report_sheets(verdicts(spark, sf_dir), logs(spark, sf_dir))["unmatched_log"].select("log_id")


@query("SELECT spot_id, status FROM verdicts WHERE spot_date <= (SELECT max(log_date) FROM logs) AND status = 'not_aired'", VERDICTS)
def confirmed_missed(spark, sf_dir):
    latest = logs(spark, sf_dir).agg(F.max("log_date").alias("latest"))
    return verdicts(spark, sf_dir).filter("status = 'not_aired'").join(F.broadcast(latest), F.col("spot_date") <= F.col("latest")).select("spot_id", "status")  # one row


@query("""SELECT account_id, channel, coalesce(h1, s1) AS first_date, coalesce(h2, s2) AS last_date, least(coalesce(h2, s2), latest) AS cap_date FROM
  (SELECT account_id, channel, min(spot_date) AS s1, max(spot_date) AS s2 FROM spots GROUP BY ALL)
  LEFT JOIN (SELECT account_id, channel, min(spot_date) + 2 AS h1, greatest(max(spot_date) FILTER (spot_id % 2 = 0) - 3, max(spot_date) FILTER (spot_id % 2 = 1) - 3 + CASE WHEN account_id = 0 THEN 2 ELSE 12 END) AS h2
    FROM spots WHERE account_id < 2 GROUP BY account_id, channel) USING (account_id, channel)
  LEFT JOIN (SELECT account_id, channel, max(log_date) AS latest FROM logs GROUP BY ALL) USING (account_id, channel)""")
def scope_window(spark, sf_dir):
    """Two headers for each scope of accounts 0 and 1, one of them with a makeup end; the other scopes by their spots."""
    p = spots(spark, sf_dir)
    h = p.filter("account_id < 2").groupBy("account_id", "channel", F.expr("spot_id % 2").alias("half")).agg(F.date_add(F.min("spot_date"), 2).alias("start_date"), F.date_sub(F.max("spot_date"), 3).alias("end_date"))
    late = F.when(F.col("half") == 1, F.date_add("end_date", F.when(F.col("account_id") == 0, 2).otherwise(12)))
    return verify.scope_window(h.withColumn("makeup_end_date", late), p, logs(spark, sf_dir))


@query("""SELECT account_id, channel, brand, '2024-01-15'::DATE >= min(spot_date) AS begun, count(*) AS spots FROM spots WHERE contains(lower(brand), 'brand 1') GROUP BY ALL""")
def brand_lookup(spark, sf_dir):
    p = spots(spark, sf_dir).filter(F.contains(f.normalize(F.col("brand")), F.lit("brand 1")))
    return p.groupBy("account_id", "channel", "brand").agg((F.lit("2024-01-15").cast("date") >= F.min("spot_date")).alias("begun"), F.count("*").alias("spots"))


@query("SELECT DISTINCT p.account_id, p.channel FROM spots AS p JOIN logs AS r ON r.account_id = p.account_id AND lower(r.channel) = lower(p.channel)")
def scopes_with_both(spark, sf_dir):
    p = spots(spark, sf_dir).select("account_id", "channel", F.lower("channel").alias("_ch")).distinct()
    return p.join(logs(spark, sf_dir).select("account_id", F.lower("channel").alias("_ch")).distinct(), ["account_id", "_ch"], "left_semi").select("account_id", "channel")


@query("SELECT spot_id, channel, row_number() OVER (ORDER BY channel, CASE WHEN spot_id % 17 > 0 THEN spot_date END NULLS LAST, start_secs DESC NULLS LAST, spot_id) AS row_number, true AS in_place FROM spots")
def export_in_order(spark, sf_dir):
    """The spots as files in the order of a report, read back: each row's number, and whether it stands after the row before it."""
    p = spots(spark, sf_dir).withColumn("spot_date", F.when(F.expr("spot_id % 17 > 0"), F.col("spot_date")))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_ordered(p, path, [F.asc_nulls_last("channel"), F.asc_nulls_last("spot_date"), F.desc_nulls_last("start_secs"), F.asc("spot_id")])
    return sinks.read_ordered(spark, path, p.schema).select("spot_id", "channel", "row_number", "in_place")


@query("SELECT account_id, channel, count(*) AS missed FROM verdicts WHERE status = 'not_aired' GROUP BY ALL", VERDICTS)
def missed_alerts(spark, sf_dir):
    officers = spots(spark, sf_dir).select("account_id", "channel").distinct()
    return workflows.alerts(verdicts(spark, sf_dir), officers)


@query("SELECT log_id FROM logs WHERE log_date >= DATE '2024-01-31' - 10")
def retained_log(spark, sf_dir):
    return workflows.retained(logs(spark, sf_dir), "log_date", F.lit("2024-01-31").cast("date"), 10).select("log_id")


@query(f"SELECT min(log_id) AS log_id, {KEY.replace(', CASE WHEN log_id % 3 = 0 THEN ', ', CASE WHEN true THEN ')} AS dedup_key FROM logs GROUP BY 2")
def rekeyed_log(spark, sf_dir):
    r = logs(spark, sf_dir)
    key = f.log_key(F.col("account_id"), F.col("channel"), F.col("log_date"), F.col("air_secs"), F.col("advt_theme"), F.col("duration"), F.lit(None), F.lit(None))
    return workflows.rename_channels(r, key).select("log_id", "dedup_key")


@query("SELECT c_custkey AS user_id, c_nationkey AS account_id FROM customer UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey")
def access_expansion(spark, sf_dir):
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "cast(c_nationkey as bigint) as account_id", "c_nationkey as client_id")
    clients = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as account_id", "s_nationkey as client_id")
    return workflows.expand_access(users, clients)


@query("SELECT account_id, channel, programme, brand, duration, start_secs, spot_date AS date, count(*) AS spots FROM spots GROUP BY ALL")
def pivot_flatten(spark, sf_dir):
    """The schedule as sheets of cells, a column for each day, and back to spots."""
    p = spots(spark, sf_dir).select("account_id", "channel", "programme", "brand", "duration", "start_secs", "spot_date", "ad_type")
    slot = ["account_id", "channel", "programme", "brand", "duration", "start_secs"]
    row = F.dense_rank().over(Window.partitionBy("account_id", "channel").orderBy(*slot[2:]))
    n = p.groupBy(*slot, "spot_date").agg(F.count("*").alias("n")).withColumn("row", row + 1)
    sheet = [F.col("account_id").cast("string").alias("file"), F.col("channel").alias("sheet")]
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row"), F.lit(c).cast("int").alias("col") if isinstance(c, int) else c.cast("int").alias("col"), v.cast("string").alias("value"))
    day = F.datediff("spot_date", F.lit("2024-01-01").cast("date")) + 6
    facts = n.select(*sheet, F.explode(F.array(cell(F.col("row"), 0, F.col("programme")), cell(F.col("row"), 1, F.lit("Any")), cell(F.col("row"), 2, f.clock_text(F.col("start_secs"))), cell(F.col("row"), 3, F.col("duration")), cell(F.col("row"), 4, F.col("brand")), cell(F.col("row"), day, F.col("n")))).alias("c")).distinct()
    top = n.select(*sheet, F.explode(F.array(*[cell(F.lit(1), i, F.lit(v)) for i, v in enumerate(("PROGRAMME", "DAY", "TIME", "DUR", "BRAND"))], cell(F.lit(1), day, F.col("spot_date")))).alias("c")).distinct()
    flat = ingest.flatten_pivot(facts.unionByName(top).select("file", "sheet", "c.*"))
    return flat.groupBy(F.col("file").cast("bigint").alias("account_id"), F.col("sheet").alias("channel"), "programme", "brand", "duration", f.seconds_of_day(F.col("start_time")).cast("bigint").alias("start_secs"), "date").agg(F.count("*").alias("spots"))


@query("""SELECT CAST(account_id AS VARCHAR) AS file, cert_id AS seq, cert_date, 'programme ' || channel AS programme, CAST(floor(air_secs / 3600) AS BIGINT) AS hour, tc_theme, CAST(duration AS INTEGER) AS duration FROM certs WHERE air_secs BETWEEN 0 AND 86399""")
def cert_lines(spark, sf_dir):
    """Certificates as text lines, and parsed again."""
    k = certs(spark, sf_dir).filter("air_secs between 0 and 86399")
    line = F.concat_ws(" ", F.date_format("cert_date", "MM/dd/yyyy"), F.concat(F.lit("programme "), "channel"), F.concat(f.clock_text(F.col("air_secs")), F.lit(":07")), "tc_theme", F.col("duration").cast("string"))
    lines = k.select(F.col("account_id").cast("string").alias("file"), F.col("cert_id").alias("seq"), line.alias("line"))
    skipped = k.select(F.col("account_id").cast("string").alias("file"), F.col("cert_id").alias("seq"), F.lit("Page 1 of 9").alias("line"))
    out = ingest.certificate_lines(lines.unionByName(skipped))
    return out.select("file", "seq", "cert_date", "programme", F.floor(f.seconds_of_day(F.col("aired_time")) / 3600).alias("hour"), "tc_theme", "duration")


@query(r"""SELECT file, cert_date, CASE WHEN stray THEN 'caption ' || channel || ' ' || name || ' Late' || rest ELSE channel || ' Late' END AS programme, CASE WHEN stray THEN CAST(own AS VARCHAR) ELSE 'caption ' || name || rest END AS tc_theme, picked AS duration, count(*) AS n FROM (
  SELECT CAST(account_id AS VARCHAR) || ':' || (cert_id // 400) AS file, cert_date, channel, 'T' || split_part(tc_theme, ' ', 3) || 'x' AS name, CASE WHEN cert_id % 3 = 0 THEN ' rest' ELSE '' END AS rest, certs.duration AS own,
    CASE WHEN cert_id % 4 < 3 THEN certs.duration ELSE TRY_CAST(regexp_extract(strftime(cert_date, '%d/%m/%Y') || ' ' || certs.duration || ' ' || (cert_id % 400), '\b(10|15|20|25|30|45|60)\b', 1) AS INTEGER) END AS picked,
    cert_id % 4 = 3 AND own <> 5 AND picked IS DISTINCT FROM own AS stray
  FROM certs WHERE air_secs BETWEEN 3600 AND 86399) GROUP BY ALL""")
def cert_words(spark, sf_dir):
    """Certificates as words on pages, with headers, money, serial numbers and uneven lines, and read back.

    A number of the date is taken for the duration if nothing else says it; the true one then stands in the last column.
    """
    k = certs(spark, sf_dir).filter("air_secs between 3600 and 86399")
    place = F.struct(F.concat_ws(":", "account_id", F.expr("cert_id div 400")).alias("file"), F.expr("cert_id % 400 div 40").alias("page"), F.expr("100.0 + cert_id % 40 * 20").cast("double").alias("y"))
    word = lambda x, text, down=0.0: F.struct(F.lit(float(x)).alias("x0"), (F.lit(float(x)) + 5 * F.length(text)).alias("x1"), F.lit(float(down)).alias("down"), text.alias("word"))
    clock = F.concat(f.clock_text(F.col("air_secs")), F.lit(":07"))
    # the duration as a time, as a number before the time, or after it
    length = F.col("duration").cast("string")
    kind, none = F.expr("cert_id % 4"), F.lit(None).cast("string")
    words = F.array(
        word(12, F.expr("cast(cert_id % 400 as string)"), 2.5), word(60, F.date_format("cert_date", "dd/MM/yyyy")), word(130, F.lit("Mon"), 1.4), word(160, F.lit("Late"), 2.9), word(185, F.col("channel"), 0.6),
        word(300, F.lit("caption")), word(340, F.concat(F.lit("T"), F.element_at(F.split("tc_theme", " "), 3), F.lit("x")), 2.0), word(420, F.when(kind == 2, length).otherwise(none), 1.05), word(450, clock, 1.1),
        word(520, F.when(kind < 2, F.concat(F.lit("00:00:"), F.lpad(length, 2, "0"))).when(kind == 3, length).otherwise(none)), word(300, F.when(F.expr("cert_id % 3 = 0"), F.lit("rest")).otherwise(none), 7.0),
        word(40, F.lit("1,250.00"), 12.0), word(200, F.when(F.expr("cert_id % 40 = 0"), F.lit("TELECAST CERTIFICATE")).otherwise(none), -20.0),
    )
    flat = k.select(place.alias("p"), F.explode(words).alias("w")).filter("w.word is not null").select("p.file", "p.page", "w.x0", "w.x1", (F.col("p.y") + F.col("w.down")).alias("y"), "w.word")
    return certificate_words(flat).groupBy("file", "cert_date", "programme", "tc_theme", "duration").agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS file, CASE WHEN arg_min(CASE WHEN day(o_orderdate) > 12 THEN 1 END, o_orderkey) IS NULL THEN 'day first' WHEN o_custkey % 2 = 0 THEN 'month first' ELSE 'day first' END AS date_order FROM orders GROUP BY o_custkey""")
def date_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return ingest.date_formats(o.select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("seq"), text.alias("date")))


@query("SELECT window_start, channel, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS channel FROM events) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """The events table as a stream; windows that the watermark has passed."""
    from spotcheck.streaming import jobs

    out = run_stream(spark, jobs.airing_counts(stream(spark, sf_dir)), "append")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "channel", "n")


@query("SELECT DISTINCT user_id, event_type AS channel, CAST(ts AS DATE) AS day FROM events")
def stream_dedup(spark, sf_dir):
    """The first event of each user, type and day as the stream comes in."""
    from spotcheck.streaming import jobs

    keyed_ = stream(spark, sf_dir).withColumn("dedup_key", F.concat_ws("|", "user_id", "channel", F.to_date("ts")))
    return run_stream(spark, jobs.deduplicated(keyed_, late="60 days"), "append").select("user_id", "channel", F.to_date("ts").alias("day"))


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_type", "channel")


def run_stream(spark, df, mode):
    """Run a stream over all there is into files of the shared folder."""
    import uuid

    from spotcheck.sources.staging import shared_dir

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("""SELECT account_id, date_trunc('month', spot_date)::DATE AS month, min(spot_date) AS first_date, max(spot_date) AS last_date, count(*) AS scheduled, count(*) FILTER (status IN ('matched', 'mismatch', 'late_telecast')) AS matched,
  count(*) FILTER (status = 'not_aired') AS missed, count(DISTINCT brand) AS brands FROM verdicts GROUP BY ALL""", VERDICTS)
def monthly_matched(spark, sf_dir):
    """Scheduled, matched and missed spots of each account and month, from the partial rows of scopes and days."""
    status = F.col("status")
    parts = partials(verdicts(spark, sf_dir), ["account_id", "channel"], "spot_date", {"matched": status.isin("matched", "mismatch", "late_telecast"), "missed": status == "not_aired"}, {"brands": F.col("brand")})
    months = merged(parts.withColumn("month", F.trunc("spot_date", "month")).drop("channel"), ["account_id", "month"], "spot_date", ["brands"])
    return months.withColumnRenamed("rows", "scheduled")


@query("""SELECT batch, min(log_date) AS first_date, max(log_date) AS last_date, count(*) AS rows, count(*) FILTER (duration <= 30) AS short, count(DISTINCT account_id || channel) AS scopes, count(DISTINCT advt_theme) AS themes
  FROM (SELECT *, log_id // 500 AS batch FROM logs) GROUP BY batch ORDER BY batch DESC LIMIT 10""")
def batch_summaries(spark, sf_dir):
    """The latest ten uploads: rows, days, short rows, scopes and themes."""
    r = logs(spark, sf_dir).withColumn("batch", F.expr("log_id div 500"))
    parts = partials(r, ["batch", "account_id", "channel"], "log_date", {"short": F.col("duration") <= 30}, {"scopes": F.concat("account_id", "channel"), "themes": F.col("advt_theme")})
    return merged(parts.drop("account_id", "channel"), ["batch"], "log_date", ["scopes", "themes"]).orderBy(F.desc("batch")).limit(10)
