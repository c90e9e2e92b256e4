"""Queries of links mended after changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotcheck.operators import certificates as c, repair
from spotcheck.operators.assign import assign
from spotcheck.plans.certificates import CONFIRMED
from spotcheck.plans.registry import query
from spotcheck.sources.projection import certs, logs, mappings
from spotcheck.sources.staging import materialize

ORDER = [*c.CONFIRM_ORDER]
#: The links of certificates over the rows that are left.
FREE = CONFIRMED.replace("FROM certs AS k JOIN logs AS r", "FROM free_certs AS k JOIN free_logs AS r")
WITHDRAWN = "free_certs AS (SELECT * FROM certs WHERE cert_id % 70 <> 3), free_logs AS (SELECT * FROM logs WHERE log_id % 50 <> 7), " + FREE
BY_HAND = """hand AS (SELECT k.cert_id, r.log_id FROM certs AS k JOIN logs AS r ON r.log_id = k.cert_id + 1 WHERE k.cert_id % 40 = 5),
free_certs AS (SELECT * FROM certs WHERE cert_id NOT IN (SELECT cert_id FROM hand)), free_logs AS (SELECT * FROM logs WHERE log_id NOT IN (SELECT log_id FROM hand)), """ + FREE


def linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The candidate links with their regions, and the assignment, as a store would keep them."""
    edges = c.confirmable(certs(spark, sf_dir), logs(spark, sf_dir), mappings(spark, sf_dir)).select("cert_id", "log_id", *(o for o in ORDER if o != "cert_id"))
    edges = materialize(repair.regions(materialize(edges), "cert_id", "log_id"))
    return edges, materialize(assign(edges, "cert_id", "log_id", [F.col(o) for o in ORDER]))


def gone(spark, sf_dir) -> dict[str, DataFrame]:
    """Every 70th certificate and every 50th airing."""
    return {"gone_left": certs(spark, sf_dir).filter("cert_id % 70 = 3").select("cert_id"), "gone_right": logs(spark, sf_dir).filter("log_id % 50 = 7").select("log_id")}


@query("SELECT cert_id, log_id FROM confirmed", WITHDRAWN)
def links_withdrawn(spark, sf_dir):
    """Links of certificates after some certificates and airings are withdrawn; the SQL assigns everything anew."""
    edges, pairs = linked(spark, sf_dir)
    return repair.repaired(edges, pairs, "cert_id", "log_id", [F.col(o) for o in ORDER], **gone(spark, sf_dir))


@query("SELECT cert_id, log_id FROM confirmed UNION ALL SELECT cert_id, log_id FROM hand", BY_HAND)
def links_by_hand(spark, sf_dir):
    """Links after every 40th certificate is linked by hand to the airing of the next number, whoever had either."""
    edges, pairs = linked(spark, sf_dir)
    asked = certs(spark, sf_dir).filter("cert_id % 40 = 5").select("cert_id", (F.col("cert_id") + 1).alias("log_id"))
    hand = materialize(asked.join(logs(spark, sf_dir).select("log_id"), "log_id", "left_semi").select("cert_id", "log_id"))
    return repair.repaired(edges, pairs, "cert_id", "log_id", [F.col(o) for o in ORDER], by_hand=hand)


@query("""SELECT count(*) AS edges, count(DISTINCT region) AS regions, count(*) FILTER (touched) AS edges_touched, count(DISTINCT region) FILTER (touched) AS regions_touched
  FROM (SELECT region, region IN (SELECT region FROM parts JOIN confirmed USING (cert_id, log_id) WHERE cert_id % 70 = 3 OR log_id % 50 = 7) AS touched FROM parts)""",
       CONFIRMED + """, ends AS (SELECT cert_id * 2 AS u, log_id * 2 + 1 AS v FROM confirmed_e), both_ways AS (SELECT u, v FROM ends UNION SELECT v, u FROM ends),
met AS (SELECT DISTINCT u AS start, u AS node FROM both_ways UNION SELECT m.start, b.v FROM met AS m JOIN both_ways AS b ON b.u = m.node),
roots AS (SELECT node, min(start) AS region FROM met GROUP BY node), parts AS (SELECT cert_id, log_id, region FROM confirmed_e JOIN roots ON node = cert_id * 2)""")  # fmt: skip
def repair_reach(spark, sf_dir):
    """How many of the candidate links a change reads: all, and those of the regions that lost a link."""
    edges, pairs = linked(spark, sf_dir)
    touched = repair.reached(pairs, "cert_id", "log_id", **gone(spark, sf_dir)).withColumn("hit", F.lit(True))
    by = edges.groupBy("region").agg(F.count("*").alias("n")).join(touched, "region", "left")
    hit = F.col("hit").isNotNull()
    return by.agg(F.sum("n").alias("edges"), F.count("*").alias("regions"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("edges_touched"), F.count("hit").alias("regions_touched"))
