"""Sharding, quality rules, mixing and quotations on small tables with every odd case."""

import zlib
from collections import defaultdict

import pytest

from spotcheck.llm import mixing, quality_rules, quotations, sharding
from spotcheck.llm.frames import materialize

SPACE = " \t\n\x0b\f\r"


def smallest_capacity(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid, n, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                n, load = n + 1, 0
            load += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(rows, docs, shards):
    out = sharding.shard_documents(docs, shards).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    groups, slots, load = {}, defaultdict(list), defaultdict(int)
    for r in out:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode()), "bytes")
        assert groups.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {}
    for i in sorted(texts):
        sizes[texts[i]] = sizes.get(texts[i], 0) + len(texts[i].encode()) + 1
    assert max(load.values()) == smallest_capacity(list(sizes.values()), shards)
    assert set(slots) <= set(range(shards))


def test_sharding_of_repeated_and_no_rows(docs, nothing):
    assert sharding.shard_documents(docs.union(docs)).groupBy("shard", "slot").count().filter("count > 1").count() == 0
    assert sharding.shard_documents(nothing).count() == 0


def test_refined_search_with_a_tiny_fanout(spark):
    import random

    rng = random.Random(2)
    sizes = [rng.choice([1, 5, 40, 300]) for _ in range(400)]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    groups = spark.createDataFrame([(e - s, e, s) for e, s in zip(ends, sizes, strict=True)], "start long, end long, size long")
    cuts = sharding.minimax_cuts(groups, 7, fanout=8)
    loads = [b - a for a, b in zip([0, *cuts], [*cuts, ends[-1]], strict=True)]
    assert max(loads) == smallest_capacity(sizes, 7)
    assert set(cuts) <= set(ends)


@pytest.mark.parametrize(("n", "share", "at", "fanout"), [(50000, 0.1, 0.5, 64), (50000, 0.5, 0.0, 64), (50000, 0.02, 0.9, 64), (100000, 0.1, 0.3, 16384)])
def test_search_ends_with_one_large_group(spark, monkeypatch, n, share, at, fanout):
    import random

    rng = random.Random(n)
    sizes = [rng.randrange(20, 301) for _ in range(n)]
    sizes[int(at * n)] = int(sum(sizes) * share / (1 - share))
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    import bisect

    rounds = []

    def ends_in(groups, gaps, each, grid):  # the aggregate on a list
        rounds.append(len(gaps))
        assert len(rounds) < 40
        out = []
        for a, b in gaps:
            buckets, step = {}, -(-(b - a + 1) // each)
            for e in ends[bisect.bisect_left(ends, a) : bisect.bisect_right(ends, b)]:
                buckets.setdefault((e - a) // step, []).append(e)
            out.append([(min(x), max(x), len(x)) for _, x in sorted(buckets.items())])
        return out

    monkeypatch.setattr(sharding, "ends_in", ends_in)
    table = spark.createDataFrame([(ends[-1], max(sizes))], "end long, size long")
    cuts = sharding.minimax_cuts(table, 16, fanout=fanout)
    loads = [b - a for a, b in zip([0, *cuts], [*cuts, ends[-1]], strict=True)]
    assert max(loads) == smallest_capacity(sizes, 16)
    assert set(cuts) <= set(ends)


def test_sharding_with_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text of very many documents', concat('text ', id, repeat('x', cast(id % 50 as int)))) as text")
    out = sharding.shard_documents(df).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).toPandas()
    sizes = {}
    for i in range(30000):
        text = "one text of very many documents" if i % 3 == 0 else f"text {i}" + "x" * (i % 50)
        sizes[text] = sizes.get(text, 0) + len(text) + 1
    assert out["sum(size)"].max() == smallest_capacity(list(sizes.values()), 16)
    assert out["count(1)"].sum() == 30000 and (out["max(slot)"] + 1 == out["count(1)"]).all()


def split(text):
    out, word = [], ""
    for c in text:
        if c in SPACE:
            out, word = [*out, word] if word else out, ""
        else:
            word += c
    return [*out, word] if word else out


def test_quality_statistics(rows, docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = (r[1] or "").replace("\x00", "")
        w = split(text)
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in text.split("\n") if split(x)]
        g = got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (g["kept"] and g["base_failed"])


def test_quality_rules_adapt_and_drop_outliers(spark, nothing):
    plain = " ".join(["word"] + [f"w{i}" for i in range(60)])
    data = [(i, f"{plain} n{i}", "en", "a") for i in range(60)] + [(100, plain.replace("w", "%|"), "en", "a")] + [(200 + i, plain.replace("w", "%|") + f" n{i}", "en", "b") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[100]
    assert sum(got.values()) == len(data) - 1  # what is odd in one source is usual in the other
    assert quality_rules.quality_rules(nothing).count() == 0
    lines = "one\ntwo\none\n \n \none\n" + "x#|" * 3
    g = quality_rules.quality_rules(spark.createDataFrame([(1, lines, None, None)], "doc_id long, text string, lang string, source string")).first()
    assert (g["n_dup_lines"], g["n_symbols"]) == (2, 6)


def test_mixing(spark, rows, docs):
    out = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    source = {r[0]: r[3] for r in rows}
    words_ = {r[0]: len(split(r[1] or "")) for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == words_[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        assert target.setdefault(s, r["target"]) == r["target"]
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2 * sizes[s]
        left -= sum(goal[s] for s in over)
        open_ -= over
    goal |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        assert abs(target[s] - goal[s]) < 1e-6 * goal[s]
        largest = max(words_[i] for i in words_ if source[i] == s)
        assert abs(taken[s] - target[s]) <= min(0.5 * largest, 0.05 * target[s] if largest < 1000 else 0.5 * largest) + 5
        assert all(r["source_size"] == sizes[s] for r in out if source[r["doc_id"]] == s)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, out))


def test_mixing_of_no_words(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_rounds_of_mixing_share_a_plan_without_joins(spark, monkeypatch):
    plans = []

    def write(df, *by):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, *by)

    monkeypatch.setattr(mixing, "materialize", write)
    rows = [(s, size, size % 7 + 1) for k, s in enumerate(("a", "b", None, "d")) for size in [*range(0, 60 * (k + 1), k + 2), 5000]]
    share = {"a": 0.4, "b": 1.7, None: 1.1, "d": 2.0}
    words = {s: sum(z * n for x, z, n in rows if x == s) for s in share}
    docs_ = {s: sum(n for x, _, n in rows if x == s) for s in share}
    classes = spark.createDataFrame([(s, z, n, words[s], docs_[s], share[s] * words[s]) for s, z, n in rows], "source string, size long, n long, source_size long, source_n long, target double")
    got = defaultdict(float)
    for r in mixing.balance(classes).collect():
        assert 0 <= r["rate"] <= 2
        got[r["source"]] += r["n"] * r["size"] * r["rate"]
    for s in share:
        assert abs(got[s] - share[s] * words[s]) < 1e-5 * words[s]
    assert len(plans) <= 60 / mixing.STEPS and not any("Join" in p for p in plans)  # a plan and two joins for each round before


MESSAGES = [
    (1, 0, "user", "Hello there\nHow do I cook rice?"), (1, 1, "assistant", "On Monday, X wrote:\n> Hello there\n> How do I cook rice?\nBoil it.\nStir well."), (1, 2, "user", "> Boil it.\nOK and pasta?"),
    (1, 3, "user", ">> How do I cook rice?\n> Stir well.\nReally?"), (1, 4, "assistant", "> How do I   cook RICE?\nAgain: boil"), (2, 0, "a", None), (2, 1, "b", ""), (2, 1, "b", ""),
    (None, 0, "x", "> nothing"), (None, 1, "y", "> > deep\n>nothing\nz"), (3, None, "r", "q"), (3, 5, "r", ">q\n"),
]


def test_quotations(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotations.link_quotations(df).collect() if (r["conv_id"], r["turn"]) != (2, 1)}
    links = {k: (r["reply_to"], r["link"], r["thread"], r["position"]) for k, r in out.items()}
    assert links[1, 0] == (None, "first", 0, 0)
    assert links[1, 1] == (0, "quote", 0, 1)
    assert links[1, 2] == (1, "quote", 0, 2)
    assert links[1, 3] == (1, "quote", 3, 0)
    assert links[1, 4] == (0, "quote", 4, 0)
    assert links[None, 1] == (0, "previous", 0, 1)
    assert links[3, 5] == (None, "quote", None, 1)
    assert out[1, 1]["body"] == "Boil it.\nStir well."
    assert out[1, 3]["quote_depth"] == 2
    assert quotations.link_quotations(df).count() == len(MESSAGES)
    assert quotations.link_quotations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.range(3000).selectExpr("7 as conv_id", "id as turn", "'r' as role", "concat('m ', id) as text", "1 as msg")
    out = quotations.link_quotations(df).selectExpr("max(position) p", "count(distinct position) n", "count(distinct thread) t").first()
    assert tuple(out) == (2999, 3000, 1)


def test_quotations_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    own = [m for m in MESSAGES if m[0] != 2]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(own, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = con.sql(quotations.SQL)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    got = quotations.link_quotations(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == want
