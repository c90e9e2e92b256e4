import datetime as dt

from pyspark.sql import functions as F

from spotcheck.operators.partials import merged, partials


def test_any_range_and_later_batches(spark):
    day = F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 60).cast("int"))
    rows = spark.range(40000).select((F.col("id") % 3).alias("scope"), day.alias("day"), (F.col("id") % 20011).alias("who"), (F.col("id") % 7 == 0).alias("hit"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, None)], rows.schema))
    first = partials(rows.filter("day < '2025-02-01' or day is null"), ["scope"], "day", {"hits": F.col("hit")}, {"people": F.col("who")})
    later = partials(rows.filter("day >= '2025-02-01'"), ["scope"], "day", {"hits": F.col("hit")}, {"people": F.col("who")})
    parts = first.unionByName(later)
    for where in ("true", "day between '2025-01-20' and '2025-02-10'"):
        got = {r["scope"]: r for r in merged(parts.filter(where), ["scope"], "day", ["people"]).collect()}
        want = {r["scope"]: r for r in rows.filter(where).groupBy("scope").agg(F.count("*").alias("rows"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.countDistinct("who").alias("people"), F.min("day").alias("first")).collect()}
        assert set(got) == set(want)
        for scope, w in want.items():
            g = got[scope]
            assert (g["rows"], g["hits"], g["first_date"]) == (w["rows"], w["hits"], w["first"])
            assert abs(g["people"] - w["people"]) <= 0.02 * w["people"]
    assert merged(parts.limit(0), ["scope"], "day", ["people"]).count() == 0
