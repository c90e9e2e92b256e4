"""Deferred acceptance against serial loops."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from spotcheck.operators import assign as assigning, certificates, settle as settling, verify
from spotcheck.operators.assign import assign
from spotcheck.operators.settle import settle, wish


def greedy(edges):
    """(left, right) of edges taken one by one in their order."""
    a, b, out = set(), set(), set()
    for left, right in edges:
        if left not in a and right not in b:
            a.add(left)
            b.add(right)
            out.add((left, right))
    return out


def first(x):
    return (x is not None, x or 0)


def test_assign_takes_edges_in_order(spark):
    rng = random.Random(12)
    rows = sorted({(s, f"{s}l{rng.randrange(12)}", f"{s}r{rng.randrange(12)}", rng.randrange(4)) for s in range(4) for _ in range(60)})
    rows += [(None, "xl", "xr", 1), (None, "xl", "yr", None)]
    df = spark.createDataFrame(rows, "scope int, l string, r string, p int")
    got = {(x["l"], x["r"]) for x in assign(df, "l", "r", [F.col("p")], scope=["scope"]).collect()}
    want = greedy((left, right) for _, left, right, _ in sorted(rows, key=lambda x: (first(x[3]), x[1], x[2])))
    assert got == want and ("xl", "yr") in got  # a null comes first
    assert assign(df.limit(0), "l", "r", [F.col("p")], scope=["scope"]).columns == ["l", "r", "p"]


def test_one_scope_of_300000_edges(spark):
    rng = random.Random(8)
    rows = [(left, (left + rng.randrange(400)) % 30000, rng.randrange(1000)) for left in range(30000) for _ in range(10)]
    df = spark.createDataFrame(rows, "l long, r long, p int")
    got = {(x["l"], x["r"]) for x in assign(df, "l", "r", [F.col("p")]).collect()}
    assert got == greedy((left, right) for left, right, _ in sorted(rows, key=lambda x: (x[2], x[0], x[1])))


@pytest.mark.parametrize("seed,places", [(1, 1 << 20), (2, 0), (3, 1 << 20)])
def test_shared_lists_against_a_loop(spark, monkeypatch, seed, places):
    monkeypatch.setattr(settling, "BROADCAST_PLACES", places)
    rng = random.Random(seed)
    lists = {n: rng.sample(range(60), rng.randint(5, 40)) for n in range(6)}  # they share rights
    wishes, bounds = [], {n: [0, rng.randint(0, 3)] for n in lists}
    for left in range(80):  # keys rise with left, and so do the bounds of each list
        own = rng.sample(sorted(lists), rng.randint(1, 3))
        for seg, n in enumerate(own):
            lo, hi = bounds[n]
            lo, hi = min(lo + rng.choice([0, 0, 1]), len(lists[n])), min(max(hi + rng.choice([0, 0, 1, 2]), lo), len(lists[n]) - 1)
            bounds[n] = [lo, hi]
            wishes.append((left, seg, n, lo, hi))
    df = spark.createDataFrame(wishes, "left long, seg int, list long, lo long, hi long").filter("lo <= hi")
    each = df.groupBy("left").agg(F.sort_array(F.collect_list(wish(F.col("seg"), "list", F.col("left")))).alias("wishes"))
    table = settling.materialize(spark.createDataFrame([(n, i, r) for n, rights in lists.items() for i, r in enumerate(rights)], "list long, pos long, right long"))
    got = {(r["left"], r["right"]) for r in settle(each, table, rounds=2).collect()}
    assert got == greedy((left, lists[n][i]) for left, _, n, lo, hi in wishes for i in range(lo, hi + 1))


def test_a_long_chain_is_one_round(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(settling, "materialize", lambda df, write=settling.materialize: jobs.append(1) or write(df))
    n = 3000
    table = settling.materialize(spark.range(n).select(F.lit(0).cast("long").alias("list"), F.col("id").alias("pos"), F.col("id").alias("right")))
    jobs.clear()
    all_want = spark.range(n).select(F.col("id").alias("left"), F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")).select("left", F.array(wish(0, F.lit(0).cast("long"), F.col("left"))).alias("wishes"))
    assert {(r["left"], r["right"]) for r in settle(all_want, table, rounds=1).collect()} == {(i, i) for i in range(n)}
    assert len(jobs) == 1


def test_no_python_in_verification_and_confirmation(spark, monkeypatch):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("test tables are not here")
    from spotcheck.plans import catalog

    plans, write = [], settling.materialize

    def seen(df, *by):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *by)

    for module in (settling, verify, certificates, assigning):
        monkeypatch.setattr(module, "materialize", seen)
    for name in ("verify_spots", "cert_confirmed"):
        last = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        plans.append(last._jdf.queryExecution().optimizedPlan().toString())
        last.count()
    assert len(plans) > 10 and not [p for p in plans if "Python" in p or "Pandas" in p or "InArrow" in p]


def loop(certs, spots):
    """Certificates by day and id; the first brand with a free spot up to the day decides."""
    free, out = sorted((s for s in spots if s[3] is not None), key=lambda s: (s[3], s[0])), []
    for cert, account, brands, day, air in sorted((c for c in certs if c[3] is not None), key=lambda c: (c[3], c[0])):
        for brand in brands:
            valid = [s for s in free if (s[1], s[2]) == (account, brand) and s[3] <= day]
            if not valid:
                continue
            at = lambda s: air + 86400 if s[5] > 86400 and air < s[4] else air  # noqa: E731, B023
            timed = [s for s in valid if air is not None and s[4] is not None and s[5] is not None]
            inside = [s for s in timed if s[4] <= at(s) <= s[5] + 600]
            near = [s for s in timed if abs(at(s) - (s[4] + s[5]) / 2) <= 7200]
            won = valid[0] if air is None else inside[0] if inside else min(near, key=lambda s: abs(at(s) - (s[4] + s[5]) / 2)) if near else None
            if won:
                out.append((cert, won[0]))
                free.remove(won)
            break
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
def test_certificates_by_time_against_a_loop(spark, seed):
    rng = random.Random(seed)
    day = lambda n: dt.date(2025, 1, 1 + n)
    certs = [(i, rng.choice([0, 1, None]), rng.choice([["a"], ["b", "a"], ["a", "b"], ["c", "b"], []]), rng.choice([None, *map(day, range(8))]), rng.choice([None, *range(70000, 86400, 900), 300])) for i in range(120)]
    spots = [(i, rng.choice([0, 1, None]), rng.choice(["a", "b"]), rng.choice([None, *map(day, range(8))]), rng.choice([None, 70000, 80000, 85000]), rng.choice([75000, 84000, 88000, None])) for i in range(90)]
    k = spark.createDataFrame(certs, "cert_id long, account_id long, brands array<string>, cert_date date, air_secs long").withColumns({"ch": F.lit("x"), "duration": F.lit(None).cast("int")})
    p = spark.createDataFrame(spots, "spot_id long, account_id long, brand_key string, spot_date date, start_secs long, stop long").withColumns({"ch": F.lit("x"), "duration": F.lit(None).cast("int")})
    got = sorted((r["cert_id"], r["spot_id"]) for r in certificates.place_by_time(k, p).collect())
    assert got == loop(certs, spots) and len(got) > 30
    assert certificates.place_by_time(k.limit(0), p).count() == certificates.place_by_time(k, p.limit(0)).count() == 0


def test_brands_of_a_certificate_in_the_order_of_mappings(spark):
    rows = [(1, "B", "t1", "x|y*", None), (1, "A", "t2", "y*", None), (1, "C", "t3", "x", 10), (1, "D", "t4", "yz", None)]
    m = spark.createDataFrame(rows, "account_id long, brand string, theme string, tc_theme string, duration int")
    k = spark.createDataFrame([(1, "x", 10), (1, "X ", None), (1, "yz", 5)], "account_id long, tc_theme string, duration int")
    got = {(r["tc_theme"], r["cert_dur"]): r["brands"] for r in certificates.certified_brands(k, m).collect()}
    assert got == {("x", 10): ["b", "c"], ("X ", 0): ["b"], ("yz", 5): ["a", "b", "d"]}  # y* is first in A's mapping


def test_unconfirmed_certificates_without_a_duration_meet(spark):
    d = dt.date(2025, 1, 2)
    m = spark.createDataFrame([(1, "A", "t", "x|w*", None)], "account_id long, brand string, theme string, tc_theme string, duration int")
    k = spark.createDataFrame([(1, 1, "TV - One", "x", None, d, 50), (2, 1, "one", "w2", 0, d, 10), (3, 1, "one", "w1", None, d, 5), (4, 1, "one", "x", 10, d, 60)], "cert_id long, account_id long, channel string, tc_theme string, duration int, cert_date date, air_secs long")
    p = spark.createDataFrame([(i, 1, "One", "a ", None, d, i) for i in (7, 8, 9)] + [(6, 1, "One", "A", None, None, 1), (5, 1, "One", "A", 10, dt.date(2025, 1, 3), 1)], "spot_id long, account_id long, channel string, brand string, duration int, spot_date date, start_secs long")
    got = {(r["spot_id"], r["cert_id"]) for r in certificates.unconfirmed_to_schedule(k, p, m).collect()}
    assert got == {(7, 1), (8, 2), (9, 3)}  # w2 has the first certificate of the names of w*
