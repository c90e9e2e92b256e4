"""Market analytics over competitors' ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.functions.scalars import time_band

#: From 19:00 up to midnight.
PRIME = (68400, 86399)


def is_prime() -> Column:
    return F.col("air_secs").between(*PRIME)


def filtered(ads: DataFrame, first: str | None = None, last: str | None = None, **among: list) -> DataFrame:
    """Ads within dates and, for each named column, among values."""
    if first:
        ads = ads.filter(F.col("ad_date") >= F.lit(first).cast("date"))
    if last:
        ads = ads.filter(F.col("ad_date") <= F.lit(last).cast("date"))
    for column, values in among.items():
        if values:
            ads = ads.filter(F.col(column).isin(*values))
    return ads


def spend() -> Column:
    return F.sum("cost").cast("decimal(20,2)").alias("spend")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.bround(part * 100.0 / whole, digits)


def kpis(ads: DataFrame) -> DataFrame:
    """One row for each account: spend, ads, mean duration, share in prime time, leading advertiser."""
    by = ads.groupBy("account_id", "advertiser").agg(spend(), F.count("*").alias("n"), F.sum("duration").alias("d"), F.count(F.when(is_prime(), 1)).alias("p"))
    out = by.groupBy("account_id").agg(F.sum("spend").cast("decimal(20,2)").alias("spend"), F.sum("n").alias("ads"), F.sum("d").alias("d"), F.sum("p").alias("p"), F.min(F.struct((-F.col("spend")).alias("s"), "advertiser")).alias("lead"))
    return out.select("account_id", "spend", "ads", F.bround(F.col("d") / F.col("ads"), 1).alias("avg_duration"), percent(F.col("p"), F.col("ads")).alias("prime_percent"), F.col("lead.advertiser").alias("leader"))


def top_by_spend(ads: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` values of a column with most spend in each account, names breaking ties."""
    by = ads.groupBy("account_id", column).agg(spend(), F.count("*").alias("ads"))
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("spend"), column))
    return by.withColumn("place", place).filter(F.col("place") <= n)


def spend_trend(ads: DataFrame, n: int = 5) -> DataFrame:
    """Daily spend of the leading advertisers."""
    lead = top_by_spend(ads, "advertiser", n).select("account_id", "advertiser")
    return ads.join(lead, ["account_id", "advertiser"], "left_semi").groupBy("account_id", "advertiser", "ad_date").agg(spend())


def heatmap(ads: DataFrame, programmes: int = 10, advertisers: int = 8) -> DataFrame:
    """Ads of the leading advertisers in the busiest programmes."""
    place = lambda c: F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("n"), c))
    busy = ads.groupBy("account_id", "program").agg(F.count("*").alias("n")).withColumn("p", place("program")).filter(F.col("p") <= programmes).select("account_id", "program")
    lead = top_by_spend(ads, "advertiser", advertisers).select("account_id", "advertiser")
    kept = ads.join(busy, ["account_id", "program"], "left_semi").join(lead, ["account_id", "advertiser"], "left_semi")
    return kept.groupBy("account_id", "program", "advertiser").agg(F.count("*").alias("ads"))


def programme_share(ads: DataFrame) -> DataFrame:
    """Each advertiser's share of a programme's ads."""
    by = ads.groupBy("account_id", "program", "advertiser").agg(F.count("*").alias("ads"))
    return by.withColumn("share", percent(F.col("ads"), F.sum("ads").over(Window.partitionBy("account_id", "program"))))


def break_position(ads: DataFrame, *by: str) -> DataFrame:
    """First, middle and last places in the break."""
    where = F.when(F.col("ad_position") == 1, "First").when(F.col("ad_position") == F.col("total_ads"), "Last").otherwise("Middle")
    return ads.withColumn("place", where).groupBy(*by, "place").agg(F.count("*").alias("ads"))


def band_counts(ads: DataFrame, *by: str) -> DataFrame:
    return ads.withColumn("band", time_band(F.col("air_secs"))).groupBy(*by, "band").agg(F.count("*").alias("ads"), spend())


def cost_efficiency(ads: DataFrame) -> DataFrame:
    """Cost of a second and of an ad for each advertiser."""
    by = ads.groupBy("account_id", "advertiser").agg(spend(), F.count("*").alias("ads"), F.sum("duration").cast("bigint").alias("seconds"))
    per = lambda c: F.round(F.col("spend") / F.when(F.col(c) > 0, F.col(c)).cast("decimal(20,0)"), 2).cast("decimal(20,2)")
    return by.withColumns({"per_second": per("seconds"), "per_ad": per("ads")})


def radar(ads: DataFrame) -> DataFrame:
    """Five measures of each advertiser as percent of the account's greatest."""
    by = ads.groupBy("account_id", "advertiser").agg(
        F.sum("cost").cast("double").alias("spend"), F.count("*").cast("double").alias("ads"), F.countDistinct("channel").cast("double").alias("channels"),
        F.countDistinct("advt_theme").cast("double").alias("creatives"), F.count(F.when(is_prime(), 1)).cast("double").alias("prime"),
    )
    w = Window.partitionBy("account_id")
    return by.select("account_id", "advertiser", *[F.when(F.max(c).over(w) > 0, F.bround(F.col(c) * 100.0 / F.max(c).over(w), 1)).otherwise(0.0).alias(c) for c in ("spend", "ads", "channels", "creatives", "prime")])


def deep_profile(ads: DataFrame) -> DataFrame:
    """Each advertiser's figures, its leading product, channel and programme, and its busiest day."""
    key = ["account_id", "advertiser"]

    def lead(column: str) -> DataFrame:
        n = ads.groupBy(*key, column).agg(F.count("*").alias("n"))
        return n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("x")).select(*key, F.col("x.v").alias(f"top_{column}"))

    out = ads.groupBy(*key).agg(spend(), F.count("*").alias("ads"), F.min("ad_date").alias("first_date"), F.max("ad_date").alias("last_date"), F.countDistinct("advt_theme").alias("creatives"))
    for column in ("product", "channel", "program", "ad_date"):
        out = out.join(lead(column), key)
    return out


#: Lists of an advertiser's profile: column, measure that ranks (None: the value itself), length (None: all).
PROFILE = {
    "channel": ("channel", "spend", 8), "programme": ("program", "spend", 10), "duration": ("duration", "ads", None), "product": ("product", "spend", 8), "theme": ("advt_theme", "ads", 10),
    "peak_day": ("ad_date", "spend", 7), "day": ("ad_date", None, None), "band": ("_band", "ads", None), "position": ("_position", "ads", None), "language": ("language", "ads", None),
}


def profile_lists(ads: DataFrame) -> DataFrame:
    """The lists of each advertiser's profile: account_id, advertiser, list, place, value, ads and spend.

    Every ad counts once for each list it has a value in, and counts are added up before they
    are shuffled; ranks are taken among the distinct values of one advertiser.  Blank values
    are left out, ties go by value.
    """
    position = F.when(F.col("ad_position") == 1, "First").when(F.col("ad_position") == F.col("total_ads"), "Last").otherwise("Middle")
    rows = ads.withColumns({"_band": time_band(F.col("air_secs")), "_position": F.when(F.col("ad_position").isNotNull(), position)})
    lists = {name: at for name, at in PROFILE.items() if at[0] in rows.columns}
    each = F.array(*[F.struct(F.lit(name).alias("list"), F.col(column).cast("string").alias("value")) for name, (column, _, _) in lists.items()])
    by = rows.select("account_id", "advertiser", "cost", F.inline(each)).filter("value != ''").groupBy("account_id", "advertiser", "list", "value").agg(F.count("*").alias("ads"), spend())
    ranked_by = F.lit(None).cast("decimal(20,2)")
    length = F.lit(None).cast("int")
    for name, (_, measure, n) in lists.items():
        if measure:
            ranked_by = F.when(F.col("list") == name, F.col(measure).cast("decimal(20,2)")).otherwise(ranked_by)
        if n:
            length = F.when(F.col("list") == name, F.lit(n)).otherwise(length)
    place = F.row_number().over(Window.partitionBy("account_id", "advertiser", "list").orderBy(ranked_by.desc_nulls_last(), "value"))
    return by.withColumn("place", place).filter(length.isNull() | (F.col("place") <= length)).select("account_id", "advertiser", "list", "place", "value", "ads", "spend")


def new_entrants(ads: DataFrame, batch: int) -> DataFrame:
    """Products, creatives and channels of an advertiser that no earlier batch has."""
    out = None
    for kind, column in (("product", "product"), ("creative", "advt_theme"), ("channel", "channel")):
        pairs = ads.select("account_id", "advertiser", F.lit(kind).alias("kind"), F.col(column).alias("value"), "batch")
        now = pairs.filter(F.col("batch") == batch).drop("batch").distinct()
        new = now.join(pairs.filter(F.col("batch") < batch).drop("batch").distinct(), ["account_id", "advertiser", "kind", "value"], "left_anti")
        out = new if out is None else out.unionByName(new)
    return out


def new_items(ads: DataFrame) -> DataFrame:
    """Products, creatives and channels that an account's latest batch has and no other batch of it."""
    latest = ads.groupBy("account_id").agg(F.max("batch").alias("latest"))
    named = ads.select("account_id", "batch", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in (("product", "product"), ("creative", "advt_theme"), ("channel", "channel"))])))
    seen = named.filter("value != ''").groupBy("account_id", "kind", "value").agg(F.min("batch").alias("low"), F.max("batch").alias("high"))
    return seen.join(latest, "account_id").filter("low = latest and high = latest").select("account_id", "kind", "value")


def pressure(ads: DataFrame, least: int = 3, top: int = 3) -> DataFrame:
    """The ``top`` programmes of each account in which most advertisers meet, ``least`` at least."""
    by = ads.filter("program != ''").groupBy("account_id", "program").agg(F.countDistinct("advertiser").alias("advertisers")).filter(F.col("advertisers") >= least)
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("advertisers"), "program"))
    return by.withColumn("place", place).filter(F.col("place") <= top)


def weekend_heavy(ads: DataFrame, *by: str, least: float = 0.6) -> DataFrame:
    """The sets of ads whose weekend ads are more than ``least`` times their weekday ads, of which there must be some; and the percent at weekends."""
    weekend = F.dayofweek("ad_date").isin(1, 7)
    n = ads.groupBy(*by).agg(F.count(F.when(weekend, 1)).alias("weekend"), F.count(F.when(~weekend, 1)).alias("weekday"))
    some = (F.col("weekday") > 0) & (F.col("weekend") > least * F.col("weekday"))
    return n.filter(some).withColumn("weekend_percent", percent(F.col("weekend"), F.col("weekend") + F.col("weekday"), 0))


def counts_by(ads: DataFrame, *columns: str, n: int | None = None) -> DataFrame:
    """Ads and spend by columns; with ``n`` the leading ones of each account."""
    by = ads.groupBy("account_id", *columns).agg(F.count("*").alias("ads"), spend())
    if n:
        by = by.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("ads"), *columns))).filter(F.col("place") <= n)
    return by


def dominance(ads: DataFrame, *by: str, least: float = 40.0) -> DataFrame:
    """The leading advertiser by spend in each set of ads, where it has more than ``least`` percent of the set's spend."""
    each = ads.groupBy(*by, "advertiser").agg(spend())
    lead = each.groupBy(*by).agg(F.sum("spend").cast("decimal(20,2)").alias("total"), F.min(F.struct((-F.col("spend")).alias("s"), F.col("advertiser"))).alias("x"))
    out = lead.select(*by, F.col("x.advertiser").alias("advertiser"), (-F.col("x.s")).cast("decimal(20,2)").alias("spend"), "total")
    share = F.col("spend").cast("double") * 100.0 / F.col("total").cast("double")
    return out.filter((F.col("total") > 0) & (share > least)).withColumn("share", F.bround(share, 0))
