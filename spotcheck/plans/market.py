"""Queries of the market analytics, over all ads."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotcheck.operators import market as m
from spotcheck.plans.registry import query
from spotcheck.sources.projection import ads

SPEND = "CAST(sum(cost) AS DECIMAL(20,2)) AS spend"
HOUR = "air_secs // 3600"
BAND = f"CASE WHEN {HOUR} >= 6 AND {HOUR} < 12 THEN 'morning' WHEN {HOUR} >= 12 AND {HOUR} < 19 THEN 'daytime' WHEN {HOUR} >= 19 AND {HOUR} <= 23 THEN 'primetime' ELSE 'latenight' END"
PRIME = f"{HOUR} >= 19 AND {HOUR} <= 23"


@query(f"""SELECT account_id, CAST(sum(spend) AS DECIMAL(20,2)) AS spend, CAST(sum(n) AS BIGINT) AS ads, round_even(sum(d) / sum(n), 1) AS avg_duration,
  round_even(sum(p) * 100.0::DOUBLE / sum(n), 1) AS prime_percent, arg_min(advertiser, (-spend, advertiser)) AS leader
  FROM (SELECT account_id, advertiser, {SPEND}, count(*) AS n, sum(duration) AS d, count(*) FILTER ({PRIME}) AS p FROM ads GROUP BY ALL) GROUP BY account_id""")
def market_kpis(spark, sf_dir):
    return m.kpis(ads(spark, sf_dir))


@query(f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY spend DESC, advertiser) AS INTEGER) AS place FROM
  (SELECT account_id, advertiser, {SPEND}, count(*) AS ads FROM ads GROUP BY ALL)) WHERE place <= 15""")
def spend_by_advertiser(spark, sf_dir):
    return m.top_by_spend(ads(spark, sf_dir), "advertiser", 15)


LEAD = f"""lead AS (SELECT account_id, advertiser, row_number() OVER (PARTITION BY account_id ORDER BY spend DESC, advertiser) AS place
  FROM (SELECT account_id, advertiser, {SPEND} FROM ads GROUP BY ALL))"""


@query(f"SELECT account_id, advertiser, ad_date, {SPEND} FROM ads WHERE (account_id, advertiser) IN (SELECT (account_id, advertiser) FROM lead WHERE place <= 5) GROUP BY ALL", LEAD)
def spend_trend_top5(spark, sf_dir):
    return m.spend_trend(ads(spark, sf_dir), 5)


@query("""SELECT account_id, program, advertiser, count(*) AS ads FROM ads WHERE (account_id, advertiser) IN (SELECT (account_id, advertiser) FROM lead WHERE place <= 8)
  AND (account_id, program) IN (SELECT (account_id, program) FROM (SELECT account_id, program, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, program) AS p
    FROM (SELECT account_id, program, count(*) AS n FROM ads GROUP BY ALL)) WHERE p <= 10) GROUP BY ALL""", LEAD)
def programme_heatmap(spark, sf_dir):
    return m.heatmap(ads(spark, sf_dir))


SHARE = "SELECT *, round_even(ads * 100.0::DOUBLE / sum(ads) OVER (PARTITION BY account_id, program), 1) AS share FROM (SELECT account_id, program, advertiser, count(*) AS ads FROM ads GROUP BY ALL)"


@query(SHARE)
def programme_share(spark, sf_dir):
    return m.programme_share(ads(spark, sf_dir))


BY_MONTH = "SELECT *, date_trunc('month', ad_date)::DATE AS month FROM ads"


@query(f"""SELECT account_id, program, month, advertiser, spend, total, round_even(spend::DOUBLE * 100.0::DOUBLE / total::DOUBLE, 0) AS share FROM (SELECT *,
    CAST(sum(spend) OVER w AS DECIMAL(20,2)) AS total, row_number() OVER (w ORDER BY spend DESC, advertiser) AS n FROM (SELECT account_id, program, month, advertiser, {SPEND} FROM ({BY_MONTH}) GROUP BY ALL)
    WINDOW w AS (PARTITION BY account_id, program, month)) WHERE n = 1 AND total > 0 AND spend::DOUBLE * 100.0::DOUBLE / total::DOUBLE > 40""")
def programme_dominance(spark, sf_dir):
    """The dominant advertiser of each programme and month."""
    return m.dominance(ads(spark, sf_dir).withColumn("month", F.trunc("ad_date", "month")), "account_id", "program", "month")


@query("SELECT account_id, CASE WHEN ad_position = 1 THEN 'First' WHEN ad_position = total_ads THEN 'Last' ELSE 'Middle' END AS place, count(*) AS ads FROM ads GROUP BY ALL")
def break_position(spark, sf_dir):
    return m.break_position(ads(spark, sf_dir), "account_id")


@query(f"SELECT account_id, advertiser, {BAND} AS band, count(*) AS ads, {SPEND} FROM ads GROUP BY ALL")
def time_band_counts(spark, sf_dir):
    return m.band_counts(ads(spark, sf_dir), "account_id", "advertiser")


@query(f"""SELECT *, CASE WHEN seconds > 0 THEN CAST(round(CAST(spend AS DECIMAL(28,8)) / seconds, 2) AS DECIMAL(20,2)) END AS per_second, CAST(round(CAST(spend AS DECIMAL(28,8)) / ads, 2) AS DECIMAL(20,2)) AS per_ad
  FROM (SELECT account_id, advertiser, {SPEND}, count(*) AS ads, CAST(sum(duration) AS BIGINT) AS seconds FROM ads GROUP BY ALL)""")
def cost_efficiency(spark, sf_dir):
    return m.cost_efficiency(ads(spark, sf_dir))


_AXES = ("spend", "ads", "channels", "creatives", "prime")


@query("SELECT account_id, advertiser, " + ", ".join(f"CASE WHEN max({c}) OVER w > 0 THEN round_even({c} * 100.0::DOUBLE / max({c}) OVER w, 1) ELSE 0 END AS {c}" for c in _AXES)
       + f""" FROM (SELECT account_id, advertiser, CAST(sum(cost) AS DOUBLE) AS spend, count(*)::DOUBLE AS ads, count(DISTINCT channel)::DOUBLE AS channels,
  count(DISTINCT advt_theme)::DOUBLE AS creatives, (count(*) FILTER ({PRIME}))::DOUBLE AS prime FROM ads GROUP BY ALL) WINDOW w AS (PARTITION BY account_id)""")  # fmt: skip
def radar(spark, sf_dir):
    return m.radar(ads(spark, sf_dir))


def _top(column: str) -> str:
    return f"SELECT account_id, advertiser, arg_min({column}, (-n, {column})) AS top_{column} FROM (SELECT account_id, advertiser, {column}, count(*) AS n FROM ads GROUP BY ALL) GROUP BY ALL"


@query(f"""SELECT * FROM (SELECT account_id, advertiser, {SPEND}, count(*) AS ads, min(ad_date) AS first_date, max(ad_date) AS last_date, count(DISTINCT advt_theme) AS creatives FROM ads GROUP BY ALL)
  JOIN ({_top('product')}) USING (account_id, advertiser) JOIN ({_top('channel')}) USING (account_id, advertiser)
  JOIN ({_top('program')}) USING (account_id, advertiser) JOIN ({_top('ad_date')}) USING (account_id, advertiser)""")
def deep_profile(spark, sf_dir):
    return m.deep_profile(ads(spark, sf_dir))


_LISTS = (("channel", "channel", "spend DESC", 8), ("programme", "program", "spend DESC", 10), ("duration", "duration", "ads DESC", None), ("product", "product", "spend DESC", 8), ("theme", "advt_theme", "ads DESC", 10),
          ("peak_day", "ad_date", "spend DESC", 7), ("day", "ad_date", "0", None), ("band", BAND, "ads DESC", None), ("position", "CASE WHEN ad_position = 1 THEN 'First' WHEN ad_position = total_ads THEN 'Last' ELSE 'Middle' END", "ads DESC", None))


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT account_id, advertiser, '{name}' AS list, CAST(row_number() OVER (PARTITION BY account_id, advertiser ORDER BY {order}, value) AS INTEGER) AS place, value, ads, spend
  FROM (SELECT account_id, advertiser, CAST({column} AS VARCHAR) AS value, count(*) AS ads, {SPEND} FROM ads GROUP BY ALL)) WHERE place <= {n or 1 << 30}""" for name, column, order, n in _LISTS))  # fmt: skip
def profile_lists(spark, sf_dir):
    return m.profile_lists(ads(spark, sf_dir))


def _fresh(kind: str, column: str) -> str:
    return f"SELECT DISTINCT account_id, advertiser, '{kind}' AS kind, {column} AS value FROM ads AS a WHERE batch = 1997 AND NOT EXISTS (SELECT 1 FROM ads AS b WHERE b.account_id = a.account_id AND b.advertiser = a.advertiser AND b.{column} = a.{column} AND b.batch < 1997)"


@query(" UNION ALL ".join(_fresh(*x) for x in (("product", "product"), ("creative", "advt_theme"), ("channel", "channel"))))
def new_entrants(spark, sf_dir):
    return m.new_entrants(ads(spark, sf_dir), 1997)


@query("""SELECT account_id, kind, value FROM (SELECT *, max(batch) OVER (PARTITION BY account_id) AS latest FROM (SELECT account_id, batch, unnest(['product', 'creative', 'channel']) AS kind, unnest([product, advt_theme || ' ' || year(ad_date), channel]) AS value FROM ads))
  WHERE value <> '' GROUP BY account_id, kind, value, latest HAVING min(batch) = latest AND max(batch) = latest""")
def new_items(spark, sf_dir):
    """With creatives that each year names anew."""
    a = ads(spark, sf_dir)
    return m.new_items(a.withColumn("advt_theme", F.concat_ws(" ", "advt_theme", F.year("ad_date"))))


@query("""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY advertisers DESC, program) AS INTEGER) AS place FROM
  (SELECT account_id, program, count(DISTINCT advertiser) AS advertisers FROM ads WHERE program <> '' GROUP BY ALL HAVING count(DISTINCT advertiser) >= 3)) WHERE place <= 3""")
def competitive_pressure(spark, sf_dir):
    return m.pressure(ads(spark, sf_dir))


@query(f"""SELECT *, round_even(weekend * 100.0::DOUBLE / (weekend + weekday), 0) AS weekend_percent FROM (SELECT account_id, advertiser, month, count(*) FILTER (dayofweek(ad_date) IN (0, 6)) AS weekend,
  count(*) FILTER (dayofweek(ad_date) NOT IN (0, 6)) AS weekday FROM ({BY_MONTH}) GROUP BY ALL) WHERE weekday > 0 AND weekend / weekday > 0.6""")
def weekend_advertisers(spark, sf_dir):
    """Advertisers and months with weekend-heavy flighting."""
    return m.weekend_heavy(ads(spark, sf_dir).withColumn("month", F.trunc("ad_date", "month")), "account_id", "advertiser", "month")


@query(f"SELECT account_id, advertiser, channel, count(*) AS ads, {SPEND} FROM ads GROUP BY ALL")
def channel_strategy(spark, sf_dir):
    return m.counts_by(ads(spark, sf_dir), "advertiser", "channel")


@query(f"SELECT account_id, duration, count(*) AS ads, {SPEND} FROM ads GROUP BY ALL")
def duration_distribution(spark, sf_dir):
    return m.counts_by(ads(spark, sf_dir), "duration")


@query(f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY ads DESC, product) AS INTEGER) AS place FROM
  (SELECT account_id, product, count(*) AS ads, {SPEND} FROM ads GROUP BY ALL)) WHERE place <= 12""")
def product_frequency(spark, sf_dir):
    return m.counts_by(ads(spark, sf_dir), "product", n=12)


@query(f"SELECT account_id, count(*) AS ads, {SPEND} FROM ads WHERE ad_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND duration IN (10, 20, 30) GROUP BY ALL")
def filtered_dashboard(spark, sf_dir):
    return m.filtered(ads(spark, sf_dir), "1995-01-01", "1996-12-31", duration=[10, 20, 30]).groupBy("account_id").agg(F.count("*").alias("ads"), m.spend())


@query("SELECT advertiser, max(spend) AS spend, max(compact) AS compact FROM (SELECT advertiser, CAST(sum(cost) AS DECIMAL(20,2)) AS spend, CASE WHEN sum(cost) >= 1000000 THEN format('{:.1f}M', CAST(sum(cost) AS DOUBLE) / 1000000) WHEN sum(cost) >= 1000 THEN format('{:.1f}K', CAST(sum(cost) AS DOUBLE) / 1000) ELSE CAST(round(sum(cost)) AS VARCHAR) END AS compact FROM ads GROUP BY advertiser) GROUP BY advertiser")
def compact_spend(spark, sf_dir):
    from spotcheck.functions.scalars import compact_number

    by = ads(spark, sf_dir).groupBy("advertiser").agg(m.spend())
    return by.withColumn("compact", F.regexp_replace(compact_number(F.col("spend").cast("double")), ",", ""))


@query("SELECT account_id, count(DISTINCT product) AS products, true AS estimate_fits FROM ads GROUP BY account_id")
def approximate_products(spark, sf_dir):
    """The number of products, and whether its estimate by a mergeable sketch lies within a tenth of it."""
    by = ads(spark, sf_dir).groupBy("account_id").agg(F.countDistinct("product").alias("products"), F.approx_count_distinct("product", 0.02).alias("a"))
    return by.select("account_id", "products", (F.abs(F.col("a") - F.col("products")) <= 0.1 * F.col("products")).alias("estimate_fits"))
