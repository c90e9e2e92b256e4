import datetime as dt
import random

import pytest

from spotcheck.operators import sponsorship
from spotcheck.operators.spans import rows_in_spans, winning_spans

DAY = dt.date(2025, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_days(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        a = rng.randrange(200)
        rows.append((rng.choice(["x", "y", None]), i, DAY + dt.timedelta(a), DAY + dt.timedelta(a + rng.choice([-1, 0, 3, 40, 90]))))
    rows += [("z", 500, None, DAY), ("z", 501, DAY, None), ("z", 502, DAY, DAY), ("z", 502, DAY, DAY)]
    df = spark.createDataFrame(rows, "k string, id long, a date, b date")
    spans = winning_spans(df, ["k"], "id", "a", "b")
    got = {}
    for r in spans.collect():
        for n in range((r["to_day"] - r["from_day"]).days + 1):
            assert (r["k"], r["from_day"] + dt.timedelta(n)) not in got  # spans are disjoint
            got[r["k"], r["from_day"] + dt.timedelta(n)] = r["id"]
    want = {}
    for k, i, a, b in rows:
        for n in range((b - a).days + 1 if a and b else 0):
            want[k, a + dt.timedelta(n)] = min(i, want.get((k, a + dt.timedelta(n)), i))
    assert got == want
    days = spark.createDataFrame([("x", DAY + dt.timedelta(n)) for n in range(-5, 320)] + [("x", None)], "k string, d date")
    found = {(r["k"], r["d"]): r["id"] for r in rows_in_spans(days, spans, ["k"], "d").collect()}
    assert found == {key: i for key, i in want.items() if key[0] == "x"}
    assert winning_spans(df.limit(0), ["k"], "id", "a", "b").count() == 0


def test_cover_of_overlapping_deals(spark):
    d = lambda n: DAY + dt.timedelta(n)
    deals = spark.createDataFrame([(3, 1, "TV - One", "A", 30, d(0), d(9), None), (2, 1, "one", "A", None, d(5), d(6), " "), (1, 1, "one", "B", 30, d(8), d(20), "t*")], "deal_id long, account_id long, channel string, brand string, duration int, start_date date, end_date date, theme string")
    logs = spark.createDataFrame([(n, 1, "One", "theme", dur, d(n)) for n, dur in ((0, 30), (5, 30), (6, 10), (7, 10), (9, 30), (15, 30), (21, 30))], "log_id long, account_id long, channel string, advt_theme string, duration int, log_date date")
    m = spark.createDataFrame([(1, "A", "Theme", 30), (1, "A", "other", None)], "account_id long, brand string, theme string, duration int")
    got = {r["log_id"]: r["deal_id"] for r in sponsorship.cover(deals, logs, m).collect()}
    assert got == {0: 3, 5: 2, 6: 2, 9: 1, 15: 1}
