"""Scalars, ingest and projections on tiny frames."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spotcheck.functions import scalars as s
from spotcheck.operators import mapping, quality
from spotcheck.sources import ingest, sinks


def values(spark, rows, column, name="x", kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"{name} {kind}").select(column(F.col(name))).collect()]


def test_times(spark):
    assert values(spark, ["20:30:00", "7:05", "0.5", "1.5", "x", None, "01:02:03.9", "5"], s.seconds_of_day) == [73800, 25500, 43200, None, None, None, 3723, None]
    assert values(spark, ["5", "20:30"], lambda x: s.seconds_of_day(x, hours_alone=True, fractions=False)) == [18000, 73800]
    assert values(spark, [None, 0, 21599, 21600, 43200, 68399, 68400, 82800, 86399, 86400], lambda x: s.time_band(x), kind="int") == ["unknown", "latenight", "latenight", "morning", "daytime", "daytime", "primetime", "primetime", "primetime", "latenight"]
    assert values(spark, ["10:11:12:13"], s.drop_frames) == ["10:11:12"]
    assert values(spark, ["January 2025", "soon"], s.next_month_end) == [dt.date(2025, 2, 28), None]


def test_text(spark):
    assert values(spark, [" A\tb \n", None], s.normalize) == ["a\tb", ""]
    assert values(spark, ["TV - Channel One", "radio -X", "Plain"], s.clean_channel) == ["channel one", "x", "plain"]
    assert values(spark, ["TV - Channel One", "Plain"], s.media_type) == ["tv", "other"]
    assert values(spark, ["a| b ||c", None], s.pipe_list) == [["a", "b", "c"], []]
    assert values(spark, ["LKR 1,250.50", "none"], s.money_text) == [Decimal("1250.50"), None]
    assert values(spark, [1_240_000.0, 45_000.0, 12.0], s.compact_number, kind="double") == ["1.2M", "45.0K", "12"]
    assert values(spark, ["NaN", " ok "], s.safe_text) == ["", "ok"]
    overlap = spark.createDataFrame([("Evening News", "news"), ("", "x"), ("a", None)], "a string, b string").select(s.word_overlap(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in overlap] == [0.5, 1.0, 0.0]


def test_keys(spark):
    import hashlib

    row = spark.createDataFrame([(1, "c", "d", "t", "th", 30)], "a long, b string, c string, d string, e string, f int").select(s.log_key(*[F.col(x) for x in "abcdef"], F.lit(None), F.lit(0), F.lit("X"), F.lit("")).alias("k"), s.certificate_key(*[F.col(x) for x in "abcde"], F.lit(None)).alias("t")).first()
    assert row["k"] == hashlib.sha256(b"1|c|d|t|th|30|||X|").hexdigest()[:32]
    assert row["t"] == hashlib.sha256(b"tc|1|c|d|t|th|None").hexdigest()[:32]


def test_pivot_sheet(spark):
    grid = [["Plan", "", "", "", "", ""], ["PROGRAMME", "DAY", "TIME", "DUR", "2025-01-01", "2025-01-02"], ["COMMERCIAL BENEFITS", "", "", "", "", ""], ["Brand A", "", "", "", "", ""],
            ["News", "Mon", "20:00", "30", "2", ""], ["TOTAL", "", "", "", "2", ""], ["SPONSORSHIP", "", "", "", "", ""], ["Drama", "Tue", "21:00", "10", "", "1"]]
    cells = spark.createDataFrame([("f", "s", i, j, v) for i, row in enumerate(grid) for j, v in enumerate(row) if v], "file string, sheet string, row int, col int, value string")
    assert ingest.header_rows(cells).first()["header_row"] == 1
    spots = ingest.flatten_pivot(cells)
    got = sorted((r["section"], r["programme"], r["brand"], r["duration"], str(r["date"]), r["spot_number"]) for r in spots.collect())
    assert got == [("COMMERCIAL BENEFITS", "News", "Brand A", 30, "2025-01-01", 1), ("COMMERCIAL BENEFITS", "News", "Brand A", 30, "2025-01-01", 2), ("SPONSORSHIP BENEFITS", "Drama", "Drama", 10, "2025-01-02", 1)]
    p = ingest.profile_sheets(spots).first()
    assert (p["commercial"], p["sponsorship"], p["month"]) == (2, 1, "January 2025")


def test_competitor_file(spark):
    df = spark.createDataFrame([("X", "P", "15", "1", "2025", "1,000.5"), ("X", "P", "15", "1", "2025", "1,000.5"), ("X", "P", "40", "1", "2025", "1")], "ADVERTISER string, Product string, Dd string, Mn string, Yr string, cost string")
    out = ingest.competitor_ads(df, 7).collect()
    assert len(out) == 1
    assert str(out[0]["cost"]) == "1000.50"
    seen = ingest.upload_preview(ingest.competitor_ads(df, 7), ingest.competitor_ads(df, 7)).first()
    assert (seen["rows"], seen["duplicates"], seen["advertisers"]) == (1, 1, ["X"])


def test_flat_schedule_and_feeds(spark):
    df = spark.createDataFrame([("COMMERCIAL BENEFITS", "News", "2025-01-15", "20:00", "21:00", "30", "A"), ("SPONSORSHIP", "News", "bad", "", "", "", "A")], "Advertisement_Type string, Programme string, Date string, Start_Time string, End_Time string, Duration string, Brand string")
    out = ingest.flat_schedule(df).collect()
    assert len(out) == 1 and out[0]["date"] == dt.date(2025, 1, 15)


def test_similarity_and_audit(spark):
    names = spark.createDataFrame([("milk powder",), ("soap",)], "n string")
    known = spark.createDataFrame([("milk powders",), ("soda",)], "k string")
    got = {r["n"]: r["k"] for r in mapping.look_alikes(names, known, "n", "k", 0.6).collect()}
    assert got["milk powder"] == "milk powders"
    m = spark.createDataFrame([(1, "A", "t", None, ""), (1, "B", "T ", None, ""), (1, "C", "u", None, "p")], "account_id long, brand string, theme string, duration int, product string")
    assert sorted((r["theme"], r["finding"]) for r in quality.audit_mappings(m).collect()) == [("t", "several brands"), ("u", "product without duration")]
    checks = quality.name_check(spark.createDataFrame([("", "f"), ("Soap Ltd", "soap ltd plan"), ("Soap", "zzz")], "account_name string, file_name string"))
    assert [r["result"] for r in checks.collect()] == ["blocked", "ok", "warning"]


def test_report_files(spark, tmp_path):
    v = spark.createDataFrame([(1, "c", "A", "matched", 11), (2, "c", "A", "not_aired", None)], "spot_id long, channel string, brand string, status string, log_id long")
    r = spark.createDataFrame([(11, dt.date(2025, 1, 1), 5, "t"), (12, dt.date(2025, 1, 1), 6, "t")], "log_id long, log_date date, air_secs long, advt_theme string")
    sheets = sinks.report_sheets(v, r)
    sinks.write_report(sheets, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/full")).count() == 2
    assert spark.read.parquet(str(tmp_path / "report/unmatched_log")).first()["log_id"] == 12


def test_refresh_of_scopes(spark, tmp_path):
    from spotcheck.streaming import jobs

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "account_id long, channel string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.refresh_scopes(stream, lambda scopes: scopes.withColumn("n", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ledger")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_near_pairs_stream(spark, tmp_path):
    from spotcheck.streaming import jobs

    t = dt.datetime(2025, 1, 1, 10)
    certs = spark.createDataFrame([(1, 1, "c", 30, t)], "cert_id long, account_id long, channel string, duration int, cert_ts timestamp")
    logs = spark.createDataFrame([(11, 1, "c", 30, t + dt.timedelta(seconds=5)), (12, 1, "c", 30, t + dt.timedelta(seconds=6))], "log_id long, account_id long, channel string, duration int, log_ts timestamp")
    certs.write.parquet(str(tmp_path / "c"))
    logs.write.parquet(str(tmp_path / "l"))
    read = lambda p, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / p))
    out = jobs.near_pairs(read("c", certs), read("l", logs))
    out.writeStream.option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "o")).awaitTermination()
    assert [r["log_id"] for r in spark.read.schema(out.schema).parquet(str(tmp_path / "o")).collect()] == [11]


def test_look_alikes_of_short_names(spark):
    import difflib
    import random

    rng = random.Random(1)
    some = lambda n: sorted({"".join(rng.choice("abé1 x") for _ in range(rng.randrange(1, 9))).strip() for _ in range(n)} - {""})
    a, b = [*some(60), "tv5", "ab1cd", "ab"], [*some(60), "tv6", "ab2cd", "abc"]
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    for least in (0.0, 0.55, 0.8):
        got = {(r["n"], r["k"]) for r in mapping.look_alikes(frame(a, "n"), frame(b, "k"), "n", "k", least, top=1000).collect()}
        assert got == {(x, y) for x in a for y in b if difflib.SequenceMatcher(None, x, y).ratio() > least}
