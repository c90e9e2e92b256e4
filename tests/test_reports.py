"""Rules of report rows, profiles, searches and audits on tiny frames."""

import datetime as dt
import difflib
import json
from decimal import Decimal

from pyspark.sql import functions as F

from spotcheck.operators import certificates, market, quality, recon, summary, workflows

DAY = dt.date(2025, 1, 15)
KIND = "account_id long, channel string, brand string, duration int, planned long, aired long, third_party long, missed long, extra long"


def test_report_rows_notes_and_costs(spark):
    sold = spark.createDataFrame([(1, "a", "Tea", 10, 5, 3, 3, 2, 0), (1, "a", "Tea", 30, 4, 4, 4, 0, 0), (1, "a", None, None, 1, 2, 2, 0, 1), (2, "b", "Tea", 10, 1, 0, 0, 1, 0), (3, "c", "Tea", 10, 1, 0, 0, 1, 0)], KIND)
    spon = spark.createDataFrame([(1, "a", "Tea", 10, 2, 1, 0, 1, 0), (1, "a", "Tea", 10, 2, 2, 0, 0, 0)], KIND)
    labels = json.dumps({"Tea|10": " Own label", "Tea|30": "  "})
    notes = json.dumps({"Tea|10": {"reason": "late", "dev_value": "LKR 1,000.50"}, "spon|Tea|10": {"dev_value": "25"}, "Tea|30": {"dev_value": "9999"}})
    noted = spark.createDataFrame([(1, "a", labels, notes), (2, "b", "no json", None), (9, "z", None, None)], "account_id long, channel string, spot_labels string, deviation_notes string")
    rows = recon.report_rows(sold, spon, noted).cache()
    got = sorted((r["account_id"], r["key"], r["label"], r["reason"], r["dev_value"]) for r in rows.collect())
    assert got == sorted([
        (1, "Tea|10", "Own label", "late", "LKR 1,000.50"), (1, "Tea|30", "Tea 30s", "", "9999"), (1, "|0", "", "", ""), (1, "spon|Tea|10", "Tea 10s", "", "25"), (1, "spon|Tea|10", "Tea 10s", "", "25"),
        (2, "Tea|10", "Tea 10s", "", ""), (3, "Tea|10", "Tea 10s", "", ""),
    ])
    total = {r["account_id"]: (r["planned"], r["aired"], r["third_party"]) for r in recon.spot_table(rows).filter("key is null").collect()}
    assert total == {1: (14, 12, 9), 2: (1, 0, 0), 3: (1, 0, 0)}
    off = recon.deviations(rows)
    assert sorted((r["account_id"], r["key"], r["deviated"], r["not_aired"]) for r in off.collect()) == [(1, "Tea|10", 0, 2), (1, "spon|Tea|10", 0, 1), (1, "|0", 1, 0), (2, "Tea|10", 0, 1), (3, "Tea|10", 0, 1)]
    stored = spark.createDataFrame([(1, "a", "LKR 5,000", None, Decimal("7")), (2, "b", "on request", Decimal("80.00"), Decimal("7")), (3, "c", None, None, None)], "account_id long, channel string, schedule_value string, schedule_cost decimal(16,2), deviated_cost decimal(16,2)")
    cost = {r["account_id"]: (r["schedule_cost"], r["deviated_cost"]) for r in recon.deviated_costs(off, stored).collect()}
    assert cost == {1: (Decimal("5000.00"), Decimal("1025.50")), 2: (Decimal("80.00"), Decimal("7.00")), 3: (Decimal("0.00"), Decimal("0.00"))}
    assert recon.report_rows(sold.limit(0), spon.limit(0), noted).count() == 0


def test_profile_lists_rank_and_cut(spark):
    rows = [(1, "X", f"ch{i}", "" if i == 3 else "show", 30, "p", "t", DAY + dt.timedelta(i), 1 if i else None, 4, 70000, Decimal(i * 10)) for i in range(12)]
    rows += [(1, "X", "ch0", "show", 10, "p", "t", DAY, 4, 4, 70000, Decimal(1000)), (1, "X", "ch1", None, None, "p", "t", DAY, 2, 4, None, None)]
    ads = spark.createDataFrame(rows, "account_id long, advertiser string, channel string, program string, duration int, product string, advt_theme string, ad_date date, ad_position int, total_ads int, air_secs long, cost decimal(16,2)")
    got = {}
    for r in market.profile_lists(ads).orderBy("list", "place").collect():
        got.setdefault(r["list"], []).append((r["value"], r["ads"]))
    assert [v for v, _ in got["channel"]] == ["ch0", "ch11", "ch10", "ch9", "ch8", "ch7", "ch6", "ch5"]
    assert got["programme"] == [("show", 12)] and got["duration"] == [("30", 12), ("10", 1)]
    assert len(got["peak_day"]) == 7 and got["peak_day"][0] == (str(DAY), 3)
    assert [v for v, _ in got["day"]] == [str(DAY + dt.timedelta(i)) for i in range(12)]
    assert got["position"] == [("First", 11), ("Last", 1), ("Middle", 1)]
    assert "language" not in got and market.profile_lists(ads.limit(0)).count() == 0
    tongue = market.profile_lists(ads.withColumn("language", F.when(F.col("cost") > 50, "Sinhala"))).filter("list = 'language'").collect()
    assert [(r["value"], r["ads"]) for r in tongue] == [("Sinhala", 7)]


def test_candidates_of_unknown_distance_come_last(spark):
    spots = spark.createDataFrame([(1, 1, "a", DAY, 3600), (2, 1, "a", DAY, None), (3, 1, "b", DAY, None), (4, 1, None, None, None)], "spot_id long, account_id long, channel string, spot_date date, start_secs long")
    logs = spark.createDataFrame([(10, 1, "TV - A", DAY, 4000), (11, 1, "a", DAY, 3000), (12, 1, "a", DAY, None), (13, 1, "a", DAY, 50000)], "log_id long, account_id long, channel string, log_date date, air_secs long").withColumns({"advt_theme": F.lit("t"), "duration": F.lit(30)})
    got = {}
    for r in quality.candidate_search(spots, logs, n=3, claims=logs.filter("log_id = 12")).orderBy("spot_id", "place").collect():
        got.setdefault(r["spot_id"], []).append((r["log_id"], r["gap"], r["locked"]))
    assert got == {1: [(10, 400, False), (11, 600, False), (12, None, True)], 2: [(11, None, False), (10, None, False), (13, None, False)]}


def test_forgotten_themes_equal_plain_ratios(spark):
    brands = [(1, "Green Tea", "green tea 30"), (1, "Red Soap", "soap red"), (2, "Green Tea", "other"), (2, "Soap", None)]
    themes = [(1, "Green Tea 30"), (1, " green teas"), (1, "red soup"), (1, "nothing"), (2, "GREEN TEA 30"), (2, "soaps"), (2, ""), (2, None), (3, "green tea")] + [(2, f"green tea {i}") for i in range(12)]
    got = quality.forgotten_themes(spark.createDataFrame(brands, "account_id long, brand string, theme string"), spark.createDataFrame(themes, "account_id long, advt_theme string"))
    norm = lambda x: (x or "").strip().lower()
    want = set()
    for a, b, _ in brands:
        mapped = {norm(t) for x, y, t in brands if (x, norm(y)) == (a, norm(b))}
        want |= {(a, norm(b), norm(t)) for x, t in themes if x == a and norm(t) and norm(t) not in mapped and difflib.SequenceMatcher(None, norm(t), norm(b)).ratio() > 0.6}
    assert len(want) > 10 and {(r["account_id"], r["brand_key"], r["theme"]) for r in got.collect()} == want


def test_sponsored_brands_ignore_durations_on_their_channel_and_month(spark):
    maps = spark.createDataFrame([(1, "Brand A", "Theme A", "TC A*|Other A", None, ""), (1, "Brand B", "Theme B", "TC B", None, "")], "account_id long, brand string, theme string, tc_theme string, duration int, product string")
    spots = spark.createDataFrame([(1, "TV - One", DAY, "brand a", "SPONSORSHIP"), (1, "One", DAY, "Brand B", "COMMERCIAL BENEFITS")], "account_id long, channel string, spot_date date, brand string, ad_type string")
    cert = lambda i, theme, day=DAY, channel="One", at=0: (i, 1, channel, day, 1000 + at, 30, theme)
    rows = [cert(1, "TC A long"), cert(2, "TC B", at=100), cert(3, "TC A", dt.date(2025, 2, 1)), cert(4, "Other A", channel="Two"), cert(5, "Other A", at=200)]
    certs = spark.createDataFrame(rows, "cert_id long, account_id long, channel string, cert_date date, air_secs long, duration int, tc_theme string")
    logs = spark.createDataFrame([(i * 10, 1, c, d, s, 15, f"Theme {t.split()[1 if t.startswith('TC') else 1]}", "") for i, _, c, d, s, _, t in rows], "log_id long, account_id long, channel string, log_date date, air_secs long, duration int, advt_theme string, product string")
    free = certificates.sponsored_themes(spots, certs, maps)
    got = certificates.confirm(certs, logs, maps, any_duration=free)
    assert {(r["cert_id"], r["log_id"]) for r in got.collect()} == {(1, 10), (5, 50)}


def test_board_states_and_alerts(spark):
    d = lambda n: dt.date(2025, 1, n)
    headers = spark.createDataFrame([(1, "One", 5, d(10), True), (1, "TV - One", 3, d(20), None), (1, "Two", 1, d(10), True), (2, "One", 1, None, False)], "account_id long, channel string, row_count long, end_date date, is_locked boolean")
    logs = spark.createDataFrame([(1, "one", d(27)), (1, "Two", d(16))], "account_id long, channel string, log_date date")
    runs = spark.createDataFrame([(1, "One", d(21)), (1, "One", d(22))], "account_id long, channel string, run_at date")
    got = {(r["account_id"], r["channel"]): (r["planned"], r["period_over"], r["covered"], r["is_locked"], r["last_run"]) for r in summary.board_states(headers, logs, runs, F.lit(d(21))).collect()}
    assert got == {(1, "One"): (8, True, True, False, d(22)), (1, "Two"): (1, True, False, True, None), (2, "One"): (1, False, False, False, None)}
    verdicts = spark.createDataFrame([(1, "One", "not_aired", None), (1, "One", "matched", 5), (1, "Two", "matched", 6)], "account_id long, channel string, status string, log_id long")
    ends = spark.createDataFrame([(1, "One", d(10)), (1, "Two", d(10)), (2, "One", None), (3, "One", d(25))], "account_id long, channel string, end_date date")
    certs = spark.createDataFrame([(1, "One"), (1, "One"), (4, "Four")], "account_id long, channel string")
    pairs = spark.createDataFrame([(1, "One", 5), (1, "One", 7)], "account_id long, channel string, log_id long")
    got = {tuple(r) for r in workflows.scope_alerts(verdicts, ends, certs, pairs, F.lit(d(21))).collect()}
    assert got == {("missed_spots", 1, "One", 1, None, None), ("certificate_reminder", 1, "Two", None, None, d(10)), ("reconciliation_done", 1, "One", 1, 2, None), ("reconciliation_done", 4, "Four", 0, 0, None)}
