"""The star-schema and event tables read as schedules, logs, certificates, mappings and ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _secs() -> Column:
    return F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")


_DUR = "case user_id % 5 when 0 then 5 when 1 then 10 when 2 then 15 when 3 then 20 else 30 end"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed airings."""
    e = table(spark, sf_dir, "events").filter("event_id % 10 <> 0").withColumn("secs", _secs())
    return e.select(
        F.col("event_id").alias("log_id"), F.expr("user_id % 4").alias("account_id"), F.col("event_type").alias("channel"),
        F.expr("date_add(cast(ts as date), if(event_id % 11 = 0, 1, 0))").alias("log_date"), F.col("secs").cast("bigint").alias("air_secs"),
        F.expr(_DUR).alias("duration"), F.expr("concat('theme ', user_id % 15)").alias("advt_theme"), F.expr("concat('prg', secs div 10800)").alias("program"),
        F.lit("").alias("product"),
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned airings."""
    e = table(spark, sf_dir, "events").filter("event_id % 10 <> 1").withColumn("h", F.hour("ts"))
    return e.select(
        F.col("event_id").alias("spot_id"), F.expr("user_id % 4").alias("account_id"), F.col("event_type").alias("channel"), F.expr("cast(ts as date)").alias("spot_date"),
        F.expr("cast(h * 3600 - if(event_id % 7 = 0, 3600, 0) as bigint)").alias("start_secs"), F.expr("cast(h * 3600 + if(event_id % 7 = 0, 0, 3599) as bigint)").alias("end_secs"),
        F.expr(_DUR).alias("duration"), F.expr("concat('Brand ', user_id % 15)").alias("brand"),
        F.expr("concat('prg', (h * 3600 - if(event_id % 7 = 0, 3600, 0) + 1800) div 10800)").alias("programme"),
        F.expr("if(event_id % 6 = 5, 'SPONSORSHIP', 'COMMERCIAL BENEFITS')").alias("ad_type"), F.expr("if(event_id % 2 = 0, '101', '102')").alias("schedule_number"),
    )


def certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airings that the channel certifies."""
    e = table(spark, sf_dir, "events").filter("event_id % 10 <> 2").withColumn("secs", _secs())
    return e.select(
        F.col("event_id").alias("cert_id"), F.expr("user_id % 4").alias("account_id"), F.col("event_type").alias("channel"), F.expr("cast(ts as date)").alias("cert_date"),
        F.expr("secs + event_id % 13 - 6").alias("air_secs"), F.expr(_DUR).alias("duration"), F.expr("concat('tc theme ', user_id % 15)").alias("tc_theme"),
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account's brands are called in logs and certificates, as its spots have them."""
    brands = spots(spark, sf_dir).select("account_id", F.expr("cast(substring(brand, 7) as int)").alias("k")).distinct().filter("k < 13")
    return brands.selectExpr(
        "account_id", "concat('Brand ', k) as brand", "if(k = 3, 'theme 3*', concat('theme ', k)) as theme",
        "if(k = 4, 'tc theme 4|tc alt 4', concat('tc theme ', k)) as tc_theme", "cast(null as int) as duration", "'' as product",
    )


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitors' ads with their cost."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    per_order = line.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("total_ads"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = line.join(per_order, "l_orderkey").join(part, F.col("p_partkey") == F.col("l_partkey"))
    joined = joined.join(supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.selectExpr(
        "l_orderkey % 3 as account_id", "s_name as advertiser", "p_name as product", "p_brand as advt_theme", "n_name as channel", "p_type as program",
        "cast(l_shipdate as date) as ad_date", "cast(l_linenumber as int) as ad_position", "total_ads", "p_size as duration",
        "(l_partkey * 37 + l_orderkey) % 86400 as air_secs", "cast(l_extendedprice as decimal(16,2)) as cost", "cast(year(l_shipdate) as bigint) as batch",
    )


SQL = """
logs AS (SELECT event_id AS log_id, user_id % 4 AS account_id, event_type AS channel,
  CAST(ts AS DATE) + CAST(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS log_date,
  CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) % 86400 AS air_secs,
  CASE user_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 20 ELSE 30 END AS duration,
  'theme ' || (user_id % 15) AS advt_theme,
  'prg' || (CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) % 86400) // 10800 AS program,
  '' AS product
FROM events WHERE event_id % 10 <> 0),
spots AS (SELECT event_id AS spot_id, account_id, channel, spot_date,
  h * 3600 - CASE WHEN event_id % 7 = 0 THEN 3600 ELSE 0 END AS start_secs,
  h * 3600 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 3599 END AS end_secs,
  duration, brand,
  'prg' || (h * 3600 - CASE WHEN event_id % 7 = 0 THEN 3600 ELSE 0 END + 1800) // 10800 AS programme,
  CASE WHEN event_id % 6 = 5 THEN 'SPONSORSHIP' ELSE 'COMMERCIAL BENEFITS' END AS ad_type,
  CASE WHEN event_id % 2 = 0 THEN '101' ELSE '102' END AS schedule_number
FROM (SELECT *, user_id % 4 AS account_id, event_type AS channel, CAST(ts AS DATE) AS spot_date,
  (CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) % 86400) // 3600 AS h,
  CASE user_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 20 ELSE 30 END AS duration,
  'Brand ' || (user_id % 15) AS brand FROM events WHERE event_id % 10 <> 1)),
certs AS (SELECT event_id AS cert_id, user_id % 4 AS account_id, event_type AS channel, CAST(ts AS DATE) AS cert_date,
  CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) % 86400 + event_id % 13 - 6 AS air_secs,
  CASE user_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 20 ELSE 30 END AS duration,
  'tc theme ' || (user_id % 15) AS tc_theme FROM events WHERE event_id % 10 <> 2),
mappings AS (SELECT account_id, 'Brand ' || k AS brand, CASE WHEN k = 3 THEN 'theme 3*' ELSE 'theme ' || k END AS theme,
  CASE WHEN k = 4 THEN 'tc theme 4|tc alt 4' ELSE 'tc theme ' || k END AS tc_theme, CAST(NULL AS INTEGER) AS duration, '' AS product
FROM (SELECT DISTINCT account_id, CAST(substr(brand, 7) AS INTEGER) AS k FROM spots) WHERE k < 13),
ads AS (SELECT l_orderkey % 3 AS account_id, s_name AS advertiser, p_name AS product, p_brand AS advt_theme, n_name AS channel,
  p_type AS program, CAST(l_shipdate AS DATE) AS ad_date, CAST(l_linenumber AS INTEGER) AS ad_position,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS total_ads, p_size AS duration,
  (l_partkey * 37 + l_orderkey) % 86400 AS air_secs, CAST(l_extendedprice AS DECIMAL(16,2)) AS cost, year(l_shipdate) AS batch
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey)"""
