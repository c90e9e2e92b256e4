"""Rules of the verification of spots on tiny frames."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from spotcheck.operators import sponsorship, summary, verify, workflows
from spotcheck.operators.assign import assign, assign_by_scope, assign_in_turn

DAY = dt.date(2025, 1, 15)
SPOT = "spot_id long, account_id long, channel string, spot_date date, start_secs long, end_secs long, duration int, brand string, programme string, ad_type string, schedule_number string"
LOG = "log_id long, account_id long, channel string, log_date date, air_secs long, duration int, advt_theme string, program string"
MAP = "account_id long, brand string, theme string, tc_theme string, duration int, product string"


def spot(i, start=72000, end=75600, day=DAY, brand="Brand A", number="101", dur=30, programme="Test Show"):
    return (i, 1, "Channel One", day, start, end, dur, brand, programme, "COMMERCIAL BENEFITS", number)


def log(i, at=73800, day=DAY, theme="Theme A", dur=30, program="other", channel="Channel One"):
    return (i, 1, channel, day, at, dur, theme, program)


def run(spark, spots, logs, maps=((1, "Brand A", "Theme A", "TC Theme A", None, ""),), **more):
    out = verify.verify(spark.createDataFrame(spots, SPOT), spark.createDataFrame(logs, LOG), spark.createDataFrame(list(maps), MAP), **more)
    return {r["spot_id"]: (r["status"], r["log_id"]) for r in out.collect()}


def test_passes_and_boundaries(spark):
    spots = [spot(1), spot(2, day=dt.date(2025, 1, 16)), spot(3, day=dt.date(2025, 1, 17)), spot(4, day=dt.date(2025, 1, 18), programme="news at ten"), spot(5, brand="Brand Z"), spot(6, dur=15)]
    logs = [log(11, 75600), log(12, 76200, dt.date(2025, 1, 16)), log(13, 73000, dt.date(2025, 1, 19)), log(14, 3600, dt.date(2025, 1, 18), program="News")]
    got = run(spark, spots, logs)
    assert got[1] == ("matched", 11)  # the window's last second is inside
    assert got[2] == ("mismatch", 12)  # ten minutes after it
    assert got[3] == ("late_telecast", 13)
    assert got[4] == ("not_aired", None)  # one word of three in common
    assert got[5] == ("no_mapping", None)
    assert got[6] == ("not_aired", None)


def test_schedule_order_and_single_use(spark):
    got = run(spark, [spot(1, number="102"), spot(2, number="101"), spot(3, number="101", day=dt.date(2025, 1, 14))], [log(11)])
    assert got[2] == ("matched", 11)
    assert got[1][1] is None and got[3][1] is None


def test_midnight_wildcard_prefix_and_product(spark):
    got = run(spark, [spot(1, 79200, 0)], [log(11, 86000, theme="theme a long", channel="TV - CHANNEL ONE")], [(1, " brand a", "THEME A*", "", None, "")])
    assert got[1] == ("matched", 11)
    assert run(spark, [spot(1)], [log(11)], [(1, "Brand A", "Theme A", "", 15, "")])[1] == ("not_aired", None)


def test_smart_manual_claims_and_cap(spark):
    spots, logs = [spot(1), spot(2), spot(3, day=dt.date(2025, 1, 20))], [log(11), log(12), log(13)]
    ids = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    assert run(spark, spots, logs, done=ids([(1,)], "spot_id"))[2] == ("matched", 11)
    assert run(spark, spots, logs, claimed=ids([(11,)], "log_id"))[1] == ("matched", 12)
    assert run(spark, spots, logs, manual=ids([(2, 11)], "spot_id", "log_id"))[2] == ("matched", 11)
    cap = spark.createDataFrame([(1, "Channel One", dt.date(2025, 1, 17))], "account_id long, channel string, last_date date")
    assert run(spark, spots, logs, cap=cap)[3] == ("pending", None)


@pytest.mark.parametrize("seed", range(2))
def test_assignment_is_serial_greedy(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(40), rng.randrange(40), rng.randrange(5)): 0 for _ in range(300)})
    df = spark.createDataFrame(edges, "l long, r long, p long").withColumn("scope", F.lit(1))
    order = ["p", "l", "r"]
    got = {(x["l"], x["r"], x["p"]) for x in assign(df, "l", "r", [F.col(c) for c in order]).collect()}
    used_l, used_r, want = set(), set(), set()
    for left, right, p in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if left not in used_l and right not in used_r:
            used_l.add(left)
            used_r.add(right)
            want.add((left, right, p))
    assert got == want
    assert {(x["l"], x["r"], x["p"]) for x in assign_by_scope(df, "l", "r", order, ["scope"]).collect()} == want


def test_assignment_in_turn(spark):
    a = spark.createDataFrame([(1, 5), (1, 3), (2, 1)], "g long, l long")
    b = spark.createDataFrame([(1, 9), (1, 8), (1, 7)], "g long, r long")
    got = assign_in_turn(a, b, ["g"], [F.col("l")], [F.col("r")]).collect()
    assert {(x["l"], x["r"]) for x in got} == {(3, 7), (5, 8)}


def test_versions(spark):
    h = spark.createDataFrame([(1, 1, "c", "m", "101", 1), (2, 1, "c", "m", "101", 2), (3, 1, "c", "m", "102", 1)], "schedule_id long, account_id long, channel string, month string, schedule_number string, version int")
    assert {r["schedule_id"] for r in verify.latest_versions(h).collect()} == {2, 3}
    assert {r["schedule_id"]: r["is_superseded"] for r in workflows.supersede(h).collect()} == {1: True, 2: False, 3: False}
    assert {r["version"] for r in workflows.next_versions(h, h.filter("schedule_id = 1").drop("version")).collect()} == {3}


def test_manual_assignment_guards(spark):
    spots = spark.createDataFrame([(1,), (2,), (3,)], "spot_id long")
    logs = spark.createDataFrame([(11,), (12,), (13,)], "log_id long")
    claims = spark.createDataFrame([(13, 3)], "log_id long, left_id long")
    ask = spark.createDataFrame([(1, 1, 11), (2, 2, 11), (3, 9, 12), (4, 2, 13), (5, 3, 12)], "request_id long, spot_id long, log_id long")
    got = {r["request_id"]: r["result"] for r in sponsorship.manual_assign(ask, spots, logs, claims).collect()}
    assert got == {1: "created", 2: "asked before", 3: "missing", 4: "log taken", 5: "spot taken"}


def test_summary_arithmetic(spark):
    key = "account_id long, channel string, brand string, duration int"
    spots = spark.createDataFrame([(1, "c", "A", 30)] * 3 + [(1, "c", "B", 30)] * 2, key)
    have = spark.createDataFrame([(1, "c", "A", 30)] * 4 + [(1, "c", "B", 30)], key)
    manual = spark.createDataFrame([(1, "c", "A", 30), (1, "c", "B", 30)], key)
    out = {r["brand"]: r for r in summary.commercial(spots, have, spark.createDataFrame([(1, "A")], "account_id long, brand string"), manual).collect()}
    assert (out["A"]["aired"], out["A"]["missed"], out["A"]["extra"]) == (5, 0, 1)
    assert (out["B"]["aired"], out["B"]["third_party"], out["B"]["missed"]) == (1, 0, 1)


def test_link_extra(spark):
    v = spark.createDataFrame([(1, "not_aired", None), (2, "matched", 11)], "spot_id long, status string, log_id long")
    links = spark.createDataFrame([(1, 12), (2, 11)], "spot_id long, log_id long")
    assert {r["spot_id"]: (r["status"], r["log_id"]) for r in workflows.link_extra(v, links).collect()} == {1: ("matched", 12), 2: ("matched", 11)}


def test_financials(spark):
    row = summary.financials(spark.createDataFrame([("1000.00", "100.00")], "schedule_cost string, deviated_cost string")).first()
    assert [str(row[c]) for c in ("net", "levy", "sub_total", "vat", "total_with_taxes", "media_house", "agency", "client", "split_total")] == ["900.00", "22.50", "922.50", "166.05", "1088.55", "765.00", "96.75", "38.25", "900.00"]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables are not here")
def test_known_verdicts(spark):
    """Counts of the serial engine over the smallest test tables."""
    import __spark_entry__

    got = {r["status"]: r["count"] for r in __spark_entry__.entry(spark).groupBy("status").count().collect()}
    assert got == {"matched": 434, "mismatch": 62, "late_telecast": 64, "not_aired": 102, "no_mapping": 105}


def test_ends_of_data_by_clean_channel(spark):
    d = dt.date(2025, 1, 1)
    spots = spark.createDataFrame([(1, 1, "One", "A", d, 0, 100, 30, "p", "1"), (2, 1, "One", "A", dt.date(2025, 1, 9), 0, 100, 30, "p", "1")], "spot_id long, account_id long, channel string, brand string, spot_date date, start_secs long, end_secs long, duration int, programme string, schedule_number string")
    logs = spark.createDataFrame([(5, 1, "TV - One", d, 50, 30, "t", "q", "")], "log_id long, account_id long, channel string, log_date date, air_secs long, duration int, advt_theme string, program string, product string")
    maps = spark.createDataFrame([(1, "A", "t", None, "")], "account_id long, brand string, theme string, duration int, product string")
    cap = logs.select("account_id", "channel", F.col("log_date").alias("last_date"))
    got = {r["spot_id"]: (r["status"], r["log_id"]) for r in verify.verify(spots, logs, maps, cap=cap).collect()}
    assert got == {1: ("matched", 5), 2: ("pending", None)}
    headers = spark.createDataFrame([(1, "tv - one", d, d, None)], "account_id long, channel string, start_date date, end_date date, makeup_end_date date")
    row = verify.scope_window(headers, spots, logs).collect()
    assert [(r["channel"], r["last_date"], r["cap_date"]) for r in row] == [("One", d, d)]


def test_ordered_export(spark, tmp_path):
    from spotcheck.sources import sinks

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, n int")
    path = f"file://{tmp_path}/out"
    sinks.export_ordered(df, path, [F.asc_nulls_last("k"), F.desc_nulls_last("n"), F.asc("id")])
    got = sorted((tuple(r) for r in sinks.read_ordered(spark, path, df.schema).collect()), key=lambda r: r[3])
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))
    assert [r[:3] for r in got] == want and [r[3] for r in got] == list(range(1, 501)) and all(r[4] for r in got)
    sinks.export_ordered(df.limit(0), f"{path}-none", [F.asc("id")])
    assert sinks.read_ordered(spark, f"{path}-none", df.schema).count() == 0
