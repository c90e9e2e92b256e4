"""What plans make on the way: rows that stand alike or near in time must not meet one by one."""

import datetime as dt
import random

import pytest

from spotcheck.operators import quality, settle as settling, verify, workflows
from spotcheck.streaming import jobs

DAY = dt.date(2025, 1, 1)


def most_rows(df) -> int:
    """The most rows that any node of the plan made; the plan is run."""
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children, metric = node.children(), node.metrics().get("numOutputRows")
        todo += [children.apply(i) for i in range(children.size())]
        seen = max(seen, metric.get().value() if metric.isDefined() else 0)
    return seen


def test_accounts_of_clients_are_not_made_distinct(spark):
    users = spark.createDataFrame([(u, u, u % 2) for u in range(60)] + [(1, 2, 0), (2, 500, None), (None, 3, 0), (4, None, 1)], "user_id long, account_id long, client_id int")
    clients = spark.createDataFrame([(a, a % 2) for a in range(100, 160)] + [(100, 1), (100, 0), (1, 1)], "account_id long, client_id int")
    u, c = [tuple(r) for r in users.collect()], [tuple(r) for r in clients.collect()]
    want = {(x, a) for x, a, _ in u if a is not None} | {(x, a) for x, _, k in u for a, k2 in c if k == k2 and k is not None}
    out = workflows.expand_access(users, clients)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    out.collect()
    sizes, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if kind == "HashAggregateExec":
            sizes.append(node.metrics().get("numOutputRows").get().value())
    assert sizes and max(sizes) < 300 < len(want)  # pairs pass no aggregate


def test_candidates_near_a_start_are_not_compared_one_by_one(spark):
    spots = spark.createDataFrame([(i, 1, "One", DAY, 36000 + i % 3) for i in range(200)], "spot_id long, account_id long, channel string, spot_date date, start_secs long")
    logs = spark.createDataFrame([(i, 1, "one", DAY, 36000 + (i * 7919) % 1800 - 900, "t", 5) for i in range(300)], "log_id long, account_id long, channel string, log_date date, air_secs long, advt_theme string, duration int")
    out = quality.candidate_search(spots, logs)
    rows = [(r["log_id"], r["air_secs"]) for r in logs.collect()]
    want = {(p, i + 1, x) for p in range(200) for i, (_, _, x) in enumerate(sorted((abs(a - 36000 - p % 3), a, x) for x, a in rows)[:10])}
    assert {(r["spot_id"], r["place"], r["log_id"]) for r in out.collect()} == want
    assert most_rows(out) <= 2000  # the result; pairs would be 60,000


def test_near_pairs_meet_by_blocks_of_time(spark, tmp_path):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    certs, logs = [(i, 1, "x", 5, at(i * 7)) for i in range(300)], [(i, 1, "x", 5, at(i * 11)) for i in range(200)]
    read = {}
    for name, rows in (("cert", certs), ("log", logs)):
        df = spark.createDataFrame(rows, f"{name}_id long, account_id long, channel string, duration int, {name}_ts timestamp")
        df.write.parquet(f"{tmp_path}/{name}")
        read[name] = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")
    out = jobs.near_pairs(read["cert"], read["log"])
    assert "block" in out._jdf.queryExecution().analyzed().toString().split("Join Inner")[1].split("\n")[0]
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = [(r["cert_id"], r["log_id"]) for r in spark.read.schema("cert_id long, log_id long").parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, *_ in certs for j, *_ in logs if abs(i * 7 - j * 11) <= 5}


def crowd(spark, n):
    """Spots and airings of one class on two days, in two hours of each."""
    spots = spark.createDataFrame([(i, 1, "One", "A", 10, dt.date(2025, 1, 1 + i % 2), 36000 + i % 3 // 2 * 18000, 39599 + i % 3 // 2 * 18000, f"prg{i % 4}", "1") for i in range(n)],
                                  "spot_id long, account_id long, channel string, brand string, duration int, spot_date date, start_secs long, end_secs long, programme string, schedule_number string")
    logs = spark.createDataFrame([(i, 1, "One", "t", 10, dt.date(2025, 1, 1 + i % 2), 36000 + i % 3 // 2 * 18000 + i * 97 % 4300, f"prg{i % 8}") for i in range(n)],
                                 "log_id long, account_id long, channel string, advt_theme string, duration int, log_date date, air_secs long, program string")
    return spots, logs, spark.createDataFrame([(1, "A", "t", None, "")], "account_id long, brand string, theme string, duration int, product string")


def test_candidates_are_counted_without_pairs(spark, monkeypatch):
    spots, logs, m = crowd(spark, 240)
    pairs = verify.candidates(spots, logs, m).collect()
    want = {(n, len(p), len({r["spot_id"] for r in p}), len({r["log_id"] for r in p})) for n in (1, 2, 3, 4) if (p := [r for r in pairs if r["pass"] == n])}
    made, write = [], verify.materialize

    def seen(df, *by):
        out = write(df, *by)
        made.append(out.count())
        return out

    monkeypatch.setattr(verify, "materialize", seen)
    got = verify.candidate_counts(spots, logs, m)
    assert {(r["pass"], r["n"], r["spots"], r["logs"]) for r in got.select("pass", "n", "spots", "logs").collect()} == want and len(want) == 4
    assert max(made) <= 3000 < len(pairs) / 5


def test_each_pass_joins_by_what_its_pairs_share(spark):
    spots, logs, m = crowd(spark, 240)
    c = verify.candidates(spots, logs, m)
    for n, key in ((1, "_hour"), (2, "_block"), (3, "program")):
        joins = [x for x in c.filter(f"pass = {n}")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "spot_date" in x]
        assert joins and (key in joins[0] or n == 1 and "_hour" in joins[1])
        assert not [x for x in joins if "array_intersect" in x]  # words are compared by distinct names


def test_candidates_by_their_definition(spark):
    rng = random.Random(3)
    some = lambda *x: rng.choice([None, *x])
    day = lambda: dt.date(2025, 1, rng.randint(1, 2))
    spots = [(i, 1, "One", "A", 10, day(), some(0, 3600, 7000, 40000), some(3599, 7200, 41000, 300), some("late show", "news", "", "show"), "1") for i in range(60)]
    logs = [(i, 1, "One", "t", 10, day(), some(-3, 0, 3600, 7200, 7205, 7801, 40500, 41600, 41601), some("show", "news at ten", "late news", "")) for i in range(60)]
    want = set()
    for s in spots:
        for r in logs:
            (start, stop, air), words = (s[6], s[7], r[6]), [set((x or "").split()) for x in (s[8], r[7])]
            low, high = (None if None in (air, start) else air >= start), (None if None in (air, stop) else air <= stop)
            inside = False if False in (low, high) else True if low and high else start is None or stop is None
            over = None if None in (air, stop) else air - stop
            if r[5] == s[5]:
                like = not words[0] or len(words[0] & words[1]) / len(words[0]) >= 0.5
                want |= {(s[0], r[0], 1 if inside else 2 if over is not None and 0 < over <= 600 else 3)} if inside or like or (over is not None and 0 < over <= 600) else set()
    c = verify.candidates(
        spark.createDataFrame(spots, "spot_id long, account_id long, channel string, brand string, duration int, spot_date date, start_secs long, end_secs long, programme string, schedule_number string"),
        spark.createDataFrame(logs, "log_id long, account_id long, channel string, advt_theme string, duration int, log_date date, air_secs long, program string"),
        spark.createDataFrame([(1, "A", "t", None, "")], "account_id long, brand string, theme string, duration int, product string"),
    )
    got = [(r["spot_id"], r["log_id"], r["pass"]) for r in c.filter("pass < 4").collect()]
    assert len(got) == len(set(got)) and set(got) == want


SPOT = "spot_id long, account_id long, channel string, brand string, duration int, spot_date date, start_secs long, end_secs long, programme string, schedule_number string"
LOG = "log_id long, account_id long, channel string, advt_theme string, duration int, log_date date, air_secs long, program string"
MAPPING = "account_id long, brand string, theme string, duration int, product string"


def serially(spots, logs, brands):
    """spot_id: (pass, log_id) of spots taken one by one, by schedule, pass, day, start and id."""
    taken, out = set(), {}
    for number in sorted({s[9] for s in spots}):
        for n in (1, 2, 3, 4):
            for s in sorted((s for s in spots if s[9] == number and s[0] not in out), key=lambda s: (s[5], s[6] is not None, s[6] or 0, s[0])):
                best = []
                for r in logs:
                    if r[0] in taken or r[3] not in brands[s[3]]:
                        continue
                    start, stop, air = s[6], s[7], r[6]
                    low, high = (None if start is None else air >= start), (None if stop is None else air <= stop)
                    inside = False if False in (low, high) else True
                    words = [set(s[8].split()), set(r[7].split())]
                    over = None if stop is None else air - stop
                    fits = {1: r[5] == s[5] and inside, 2: r[5] == s[5] and over is not None and 0 < over <= 600,
                            3: r[5] == s[5] and (not words[0] or len(words[0] & words[1]) / len(words[0]) >= 0.5), 4: r[5] > s[5] and inside}[n]
                    best += [(r[5], air, r[0])] if fits else []
                if best:
                    out[s[0]] = (n, min(best)[2])
                    taken.add(min(best)[2])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crowded_spots_against_a_loop(spark, seed):
    rng = random.Random(seed)
    day = lambda: dt.date(2025, 1, rng.randint(1, 3))
    windows = [(36000, 39599), (36000, 39600), (36000, 37800), (37000, 40000), (39600, 43199), (-3600, 0), (None, 39000), (40000, None)]
    spots = [(i, 1, "One", rng.choice("AB"), 10, day(), *rng.choice(windows[: 4 + 2 * seed - 2]), rng.choice(["late show", "show", "news", ""]), str(rng.randint(1, 2))) for i in range(120)]
    logs = [(i, 1, "One", rng.choice(["t", "t", "tu"]), 10, day(), rng.choice([39600, 0, rng.randrange(35000, 44500)]), rng.choice(["show", "news at ten", "late news"])) for i in range(110)]
    m = spark.createDataFrame([(1, "A", "t*", None, ""), (1, "B", "t", None, "")], MAPPING)
    got = verify.place_spots(spark.createDataFrame(spots, SPOT), spark.createDataFrame(logs, LOG), m)
    assert {r["spot_id"]: (r["pass"], r["log_id"]) for r in got.collect()} == serially(spots, logs, {"A": {"t", "tu"}, "B": {"t"}})


def test_rounds_do_not_grow_with_a_crowd(spark, monkeypatch):
    jobs, write = [], settling.materialize
    monkeypatch.setattr(settling, "materialize", lambda df, *by: jobs.append(1) or write(df, *by))
    rng = random.Random(7)
    name = lambda i: "show prg" if i % 3 else "prg"
    spots = [(i, 1, "One", "A", 10, dt.date(2025, 1, 1), 36000, 39599 + (i % 2), name(i), "1") for i in range(300)]
    logs = [(i, 1, "One", "t", 10, dt.date(2025, 1, 1 + i % 3 // 2), rng.randrange(36000, 43000), "prg") for i in range(300)]
    got = verify.place_spots(spark.createDataFrame(spots, SPOT), spark.createDataFrame(logs, LOG), spark.createDataFrame([(1, "A", "t", None, "")], MAPPING))
    assert {r["spot_id"]: (r["pass"], r["log_id"]) for r in got.collect()} == serially(spots, logs, {"A": {"t"}})
    assert len(jobs) <= 8
