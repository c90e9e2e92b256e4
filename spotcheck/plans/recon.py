"""Queries of the reconciliation report and of boards and alerts about scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotcheck.operators import recon, summary as y, workflows
from spotcheck.plans.certificates import CONFIRMED, IN_TURN, SUMMARY, confirmed, fifo, sponsored, summary
from spotcheck.plans.registry import query
from spotcheck.plans.verification import THEMES, VERDICTS, verdicts
from spotcheck.sources.projection import certs, logs, spots
from spotcheck.sources.staging import materialize

ROWS = SUMMARY + ", " + IN_TURN + """, srows AS (SELECT p.account_id, p.channel, p.brand, p.duration, count(*) AS planned, count(DISTINCT f.log_id) AS aired FROM spon AS p LEFT JOIN fifo AS f ON f.spot_id = p.spot_id GROUP BY p.account_id, p.channel, p.programme, p.brand, p.duration),
bare AS (SELECT account_id, channel, brand, duration, planned, aired, third_party, missed, extra, false AS is_sponsorship FROM summary
  UNION ALL SELECT account_id, channel, brand, duration, planned, aired, 0, greatest(0, planned - aired), greatest(0, aired - planned), true FROM srows),
rrows AS (SELECT *, CASE WHEN is_sponsorship THEN 'spon|' ELSE '' END || brand || '|' || duration AS key,
  CASE WHEN account_id < 3 AND duration = 10 AND NOT is_sponsorship AND brand NOT LIKE '%7' THEN 'Ten of ' || brand ELSE brand || ' ' || duration || 's' END AS label,
  CASE WHEN account_id < 3 AND duration >= 15 AND NOT is_sponsorship THEN 'moved' ELSE '' END AS reason,
  CASE WHEN account_id < 3 AND duration >= 15 AND NOT is_sponsorship THEN CASE duration WHEN 15 THEN 'Rs 1,200.50' WHEN 20 THEN 'none' ELSE '75' END ELSE '' END AS dev_value FROM bare)"""


def notes(spark, sf_dir) -> DataFrame:
    """Labels and notes of accounts 0 to 2 as JSON, as a report's editor leaves them."""
    kinds = spots(spark, sf_dir).filter("account_id < 3").select("account_id", "channel", "brand", "duration").distinct()
    key = F.concat(F.col("brand"), F.lit("|"), F.col("duration").cast("string"))
    label = F.when(F.col("brand").endswith("7"), "  ").otherwise(F.concat(F.lit("Ten of "), "brand"))
    value = F.when(F.col("duration") == 15, "Rs 1,200.50").when(F.col("duration") == 20, "none").otherwise("75")
    entries = lambda when, v: F.to_json(F.map_from_entries(F.collect_list(F.when(when, F.struct(key.alias("k"), v.alias("v"))))))
    return kinds.groupBy("account_id", "channel").agg(entries(F.col("duration") == 10, label).alias("spot_labels"), entries(F.col("duration") >= 15, F.struct(F.lit("moved").alias("reason"), value.alias("dev_value"))).alias("deviation_notes"))


def rows(spark, sf_dir) -> DataFrame:
    p = sponsored(spark, sf_dir)
    evidence = p.join(fifo(spark, sf_dir), "spot_id")
    zero = F.lit(0).cast("bigint")
    s = y.sponsorship(p, evidence).withColumns({"third_party": zero, "missed": F.greatest(zero, F.col("planned") - F.col("aired")), "extra": F.greatest(zero, F.col("aired") - F.col("planned"))})
    return recon.report_rows(summary(spark, sf_dir), s, notes(spark, sf_dir))


@query("""SELECT account_id, channel, is_sponsorship, key, label, planned, aired, third_party FROM rrows
  UNION ALL SELECT account_id, channel, NULL, NULL, NULL, CAST(sum(planned) AS BIGINT), CAST(sum(aired) AS BIGINT), CAST(sum(third_party) AS BIGINT) FROM rrows GROUP BY account_id, channel""", ROWS)
def recon_spot_table(spark, sf_dir):
    return recon.spot_table(materialize(rows(spark, sf_dir)))


@query("SELECT account_id, channel, is_sponsorship, key, label, extra AS deviated, missed AS not_aired, reason, dev_value FROM rrows WHERE extra > 0 OR missed > 0", ROWS)
def recon_deviations(spark, sf_dir):
    return recon.deviations(rows(spark, sf_dir))


@query("""SELECT account_id, channel, CASE WHEN account_id < 2 THEN 5000000.25 ELSE 1000000 END::DECIMAL(16,2) AS schedule_cost, coalesce(d, CASE WHEN account_id = 3 THEN 300 END, 0)::DECIMAL(16,2) AS deviated_cost
  FROM (SELECT account_id, channel, sum(CASE dev_value WHEN 'Rs 1,200.50' THEN 1200.50 WHEN '75' THEN 75 END) FILTER (extra > 0 OR missed > 0) AS d FROM rrows GROUP BY ALL)""", ROWS)
def recon_costs(spark, sf_dir):
    """Costs of the report from the values of its deviations; accounts 0 and 1 state the schedule's value as text."""
    stored = spots(spark, sf_dir).select("account_id", "channel").distinct()
    stored = stored.withColumns({"schedule_value": F.when(F.col("account_id") < 2, "LKR 5,000,000.25"), "schedule_cost": F.lit("1000000").cast("decimal(16,2)"), "deviated_cost": F.when(F.col("account_id") == 3, F.lit("300").cast("decimal(16,2)"))})
    return recon.deviated_costs(recon.deviations(rows(spark, sf_dir)), stored)


TODAY = "2024-01-28"


@query(f"""SELECT p.account_id, p.channel, planned, last_date < DATE '{TODAY}' AS period_over, coalesce(log_until >= last_date + 7, false) AS covered, NOT EXISTS (SELECT 1 FROM sched AS s WHERE s.account_id = p.account_id AND s.channel = p.channel AND NOT locked) AS is_locked, last_run
  FROM (SELECT account_id, channel, count(*) AS planned, max(spot_date) - 10 AS last_date FROM spots GROUP BY ALL) AS p
  LEFT JOIN (SELECT account_id, channel, max(log_date) AS log_until FROM logs GROUP BY ALL) USING (account_id, channel)
  LEFT JOIN (SELECT account_id, channel, max(spot_date) AS last_run FROM spots WHERE account_id <> 1 GROUP BY ALL) USING (account_id, channel)""",
       "sched AS (SELECT DISTINCT account_id, channel, schedule_number, account_id = 2 OR schedule_number = '101' AND account_id < 3 AS locked FROM spots)")
def board_states(spark, sf_dir):
    """Whether each scope's period is over, covered by the log and locked in all its schedules, and its last run."""
    p = spots(spark, sf_dir)
    headers = p.groupBy("account_id", "channel", "schedule_number").agg(F.date_sub(F.max("spot_date"), 10).alias("end_date"), F.count("*").alias("row_count"))
    headers = headers.withColumn("is_locked", F.expr("account_id = 2 or schedule_number = '101' and account_id < 3"))
    runs = p.filter("account_id != 1").select("account_id", "channel", F.col("spot_date").alias("run_at"))
    return y.board_states(headers, logs(spark, sf_dir), runs, F.lit(TODAY).cast("date"))


@query(f"""SELECT 'missed_spots' AS kind, account_id, channel, count(*) AS first_number, NULL::BIGINT AS second_number, NULL::DATE AS end_date FROM verdicts WHERE status = 'not_aired' GROUP BY ALL
  UNION ALL SELECT 'certificate_reminder', account_id, channel, NULL, NULL, max(spot_date) - 10 FROM spots AS p WHERE (account_id, channel) NOT IN (SELECT (account_id, channel) FROM certs WHERE account_id > 1) GROUP BY ALL HAVING max(spot_date) - 10 < DATE '{TODAY}'
  UNION ALL SELECT 'reconciliation_done', k.account_id, k.channel, count(DISTINCT v.log_id), count(DISTINCT f.log_id), NULL FROM (SELECT DISTINCT account_id, channel FROM certs WHERE account_id > 1) AS k
    LEFT JOIN verdicts AS v ON v.account_id = k.account_id AND v.channel = k.channel LEFT JOIN (SELECT c.account_id, c.channel, f.log_id FROM confirmed AS f JOIN certs AS c USING (cert_id)) AS f ON f.account_id = k.account_id AND f.channel = k.channel GROUP BY ALL""",
       VERDICTS + ", " + CONFIRMED.removeprefix(THEMES + ", "))
def scope_alerts(spark, sf_dir):
    """Alerts of missed spots, of scopes over without certificates (accounts 0 and 1 have none), and of finished reconciliations."""
    p, k = spots(spark, sf_dir), certs(spark, sf_dir).filter("account_id > 1")
    ends = p.groupBy("account_id", "channel").agg(F.date_sub(F.max("spot_date"), 10).alias("end_date"))
    pairs = confirmed(spark, sf_dir).join(certs(spark, sf_dir).select("cert_id", "account_id", "channel"), "cert_id")
    return workflows.scope_alerts(materialize(verdicts(spark, sf_dir)), ends, k, pairs.select("account_id", "channel", "log_id"), F.lit(TODAY).cast("date"))


@query("""SELECT account_id, channel, status, n, CAST(CASE status WHEN 'matched' THEN 1 WHEN 'mismatch' THEN 2 WHEN 'late_telecast' THEN 3 WHEN 'not_aired' THEN 4 WHEN 'no_mapping' THEN 5 END AS INTEGER) AS place
  FROM (SELECT account_id, channel, status, count(*) AS n FROM verdicts GROUP BY ALL)""", VERDICTS)
def statuses_in_order(spark, sf_dir):
    """Statuses of each scope in the order in which they are shown."""
    return y.in_display_order(verdicts(spark, sf_dir).groupBy("account_id", "channel", "status").agg(F.count("*").alias("n"))).withColumn("place", F.col("place").cast("int"))
