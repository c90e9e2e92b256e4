import random

from pyspark.sql import functions as F

from spotcheck.operators import repair
from spotcheck.operators.assign import assign

EDGE = "s long, r long, k int"


def serial(edges):
    """Greedy one by one in the order of (k, s, r)."""
    ss, rs, out = set(), set(), set()
    for s, r, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if s not in ss and r not in rs:
            ss.add(s)
            rs.add(r)
            out.add((s, r))
    return out


def parts(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, r, _ in edges:
        a, b = find(s * 2), find(r * 2 + 1)
        root[max(a, b)] = min(a, b)
    return {(s, r): find(s * 2) for s, r, _ in edges}


def ids(spark, rows, name):
    return spark.createDataFrame([(x,) for x in rows], f"{name} long")


def test_regions_and_repair_equal_a_full_run(spark):
    rng = random.Random(5)
    # a long chain, a hub that all want, and random small groups
    edges = [(i, i + d, rng.randrange(9)) for i in range(150) for d in (0, 1)] + [(1000 + i, 1000, rng.randrange(9)) for i in range(60)]
    edges += sorted({(2000 + rng.randrange(90), 2000 + rng.randrange(90)) for _ in range(120)})
    edges = [(*e, rng.randrange(9)) if len(e) == 2 else e for e in edges]
    full = repair.regions(spark.createDataFrame(edges, EDGE), "s", "r")
    assert {(x["s"], x["r"]): x["region"] for x in full.collect()} == parts(edges)
    pairs = assign(full, "s", "r", [F.col("k")])
    assert {(x["s"], x["r"]) for x in pairs.collect()} == serial(edges)
    gone_s, gone_r, hand = {3, 70, 1007, 2003, 9999}, {20, 1000, 2011}, [(40, 90), (2020, 77777)]
    got = repair.repaired(full, pairs, "s", "r", [F.col("k")], ids(spark, [*gone_s, 3], "s"), ids(spark, gone_r, "r"), spark.createDataFrame(hand, "s long, r long"))
    out_s, out_r = gone_s | {s for s, _ in hand}, gone_r | {r for _, r in hand}
    want = serial([e for e in edges if e[0] not in out_s and e[1] not in out_r]) | set(hand)
    assert sorted((x["s"], x["r"]) for x in got.collect()) == sorted(want)
    touched = {x["region"] for x in repair.reached(pairs, "s", "r", ids(spark, gone_s, "s")).collect()}
    assert touched and touched < set(parts(edges).values())


def test_nothing_withdrawn_and_empty(spark):
    edges = repair.regions(spark.createDataFrame([(1, 1, 0), (2, 1, 1)], EDGE), "s", "r")
    pairs = assign(edges, "s", "r", [F.col("k")])
    assert [tuple(x) for x in repair.repaired(edges, pairs, "s", "r", [F.col("k")]).collect()] == [(1, 1)]
    assert [tuple(x) for x in repair.repaired(edges, pairs, "s", "r", [F.col("k")], gone_left=ids(spark, [1], "s")).collect()] == [(2, 1)]
    none = repair.regions(spark.createDataFrame([], EDGE), "s", "r")
    assert none.count() == 0
