"""Neighbours, near copies, repeated passages, the classifier and the pipeline."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from spotcheck.llm import filters, near_copies, neighbours, quality_model, suffixes
from spotcheck.llm.components import components


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    x[100:130] = x[100]  # copies
    x[5] = 0.0
    data = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] * 12), (2003, [1.0] * 5), (3, [float(v) for v in x[3]]), (None, [1.0] * 12)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as rank")
    got = {}
    for r in neighbours.search(df, every=20, k=20, recall=0.97, leaf_rows=40, shelf_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [i for i in range(900) if i != 5]
    assert sorted(got) == [i for i in ok if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        want = sorted((i for i in ok if i != q), key=lambda i: (-score[i], i))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.search(df.limit(0)).count() == 0
    assert sorted(neighbours.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")).collect())[0][:3] == (0, 1, 1)


def test_floors_keep_the_best_and_leave_out_most():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2400, 16))
    q, leaf = x[::20], rng.integers(0, 30, len(x))
    leaves = [rng.choice(30, 24, replace=False) for _ in q]
    some = rng.choice(len(x), 800, replace=False)
    low = neighbours.floors(q, leaves, x[some], leaf[some], 21, float(np.sqrt((x * x).sum(1).max())))
    kept = 0
    for i, row in enumerate(q @ x.T):
        there = np.sort(row[np.isin(leaf, leaves[i])])[::-1]
        assert low[i] <= there[20]  # none of the 21 best is lost
        kept += int((there >= low[i]).sum())
    assert kept < 24 * 21 * len(q) / 5  # of those that 24 shelves of a leaf would return
    none = neighbours.floors(q[:3], leaves[:3], x[some[:5]], leaf[some[:5]], 21, 9.0)
    assert np.isneginf(none).all()


def shingled(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark, rows, docs, nothing):
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(docs).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    texts = {r[0]: r[1] or "" for r in rows}
    sets = {i: shingled(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j:
                union = len(sets[i] | sets[j])
                alike = texts[i] == texts[j] or (union and len(sets[i] & sets[j]) / union >= 0.9)
                if alike:
                    assert got[i] == got[j], (i, j)
                elif not union or len(sets[i] & sets[j]) / union < 0.5:
                    assert got[i] != got[j], (i, j)
    assert near_copies.near_copies(nothing).count() == 0
    assert near_copies.near_copies(docs.union(docs)).count() == 2 * len(rows)


def test_weights_are_of_shingles(spark):
    common = " ".join(f"w{i}" for i in range(94))
    rows = [(i, common + "".join(f" d{i}x{j}" for j in range(7))) for i in range(60)]  # 90 shingles of all, 7 of each alone
    df = spark.createDataFrame([*rows, (90, rows[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(df).collect()}
    assert got == {i: i for i in range(60)} | {90: 0}  # 0.76 by true counts, 0.86 by a full table


def test_links_in_large_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 8)  # so that buckets are large
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(260):  # copies about the limit of similarity, more and less changed ones
        t = list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            t[at] = f"x{i}n{at}"
        texts.append(" ".join(t))
    for i in range(80):  # texts that share a passage and nothing more
        texts.append(" ".join(passage + [f"y{i}n{j}" for j in range(40)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(df).collect()}
    sets = [shingled(t) for t in texts]
    n = {}
    for x in sets:
        for g in x:
            n[g] = n.get(g, 0) + 1
    total, base_n = len(texts), max(1.0, near_copies.COMMON * len(texts))
    weight = {g: 1 - np.log(max(c, base_n) / base_n) / (2 * np.log(total / base_n)) for g, c in n.items()}
    size = [sum(weight[g] for g in x) for x in sets]
    lost, linked = 0, 0
    for i in range(total):
        for j in range(i):
            shared = sum(weight[g] for g in sets[i] & sets[j])
            alike = shared / (size[i] + size[j] - shared)
            if alike >= 0.8 + 1e-4:
                linked += 1
                lost += got[i] != got[j]
    assert linked > 1500 and lost <= linked / 1000
    root = list(range(total))  # no class without links

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(total):
        for j in range(i):
            shared = sum(weight[g] for g in sets[i] & sets[j])
            if shared / (size[i] + size[j] - shared) >= 0.8 - 1e-4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(find(i) == find(got[i]) for i in range(total))


def planted(spark, monkeypatch):
    """Texts in large buckets and the few pairs of them that are links; before, rounds of representatives lost one."""
    monkeypatch.setattr(near_copies, "SMALL", 4)  # so that buckets and groups of shingles are large
    monkeypatch.setattr(near_copies, "BLOCK", 300, raising=False)
    rng = np.random.default_rng(4)
    slots = 14  # a text is a choice between two passages in each place: a link differs in one, all others in two at least
    even = [x for x in range(1 << slots) if x.bit_count() % 2 == 0]
    odd = [int(x) for x in rng.choice([x for x in range(1 << slots) if x.bit_count() % 2], 4, replace=False)]
    close = {x: [x ^ (1 << i) for i in range(slots)] for x in odd}
    near = {x: next(y for y in close[x] if sum(y in c for c in close.values()) == 1) for x in odd}
    apart = {y for c in close.values() for y in c}
    chosen = [int(x) for x in rng.choice([x for x in even if x not in apart], 1500, replace=False)] + odd + list(near.values())
    chosen = [chosen[i] for i in rng.permutation(len(chosen))]
    text = {x: " ".join(f"s{i}v{x >> i & 1}w{j}" for i in range(slots) for j in range(20)) for x in chosen}
    at = {x: i for i, x in enumerate(chosen)}
    df = spark.createDataFrame([(i, text[x]) for i, x in enumerate(chosen)], "doc_id long, text string")
    return df, {max(at[x], at[y]): min(at[x], at[y]) for x, y in near.items()}


def test_links_that_no_round_meets(spark, monkeypatch):
    df, links = planted(spark, monkeypatch)
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(df).collect()}
    assert got == {i: i for i in got} | links


def test_pipeline_keeps_one_of_links_that_no_round_meets(spark, monkeypatch):
    df, links = planted(spark, monkeypatch)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == set(range(df.count())) - set(links)


def test_later_links_join_classes_and_not_all_links_anew(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 8)  # so that buckets are large
    given = []

    def counted(links):
        given.append(links.count())
        return components(links)

    monkeypatch.setattr(near_copies, "components", counted)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):  # copies of one text, one or two of 150 words changed
        words = [f"w{j}" for j in range(150)]
        for at in rng.choice(150, rng.integers(1, 3), replace=False):
            words[at] = f"x{i}n{at}"
        rows.append((i, " ".join(words)))
    rows += [(60 + i, rows[0][1].rsplit(" ", 75)[0] + "".join(f" y{i}n{j}" for j in range(75))) for i in range(30)]  # half a copy each
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_copies(df).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(90)}
    assert given[0] >= 59 and sum(given[1:]) < given[0]


def test_overlaps_are_sums_of_smaller_weights():
    rng = np.random.default_rng(8)
    one = rng.uniform(0.5, 1.0, 60).astype(np.float32)
    sides = []
    for n in (7, 5):
        of, code = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(60), indexing="ij"))
        take = rng.random(len(of)) < 0.4
        sides.append((of[take], code[take].astype(np.uint64), one[code[take]]))
    got = near_copies.overlaps(*sides)
    want = [[sum(float(one[c]) for c in set(sides[0][1][sides[0][0] == i]) & set(sides[1][1][sides[1][0] == j])) for j in range(5)] for i in range(7)]
    assert np.allclose(got, want, atol=1e-4)


def test_bands_follow_the_similarity():
    for s in (0.5, 0.6, 0.7, 0.8, 0.9):
        bands, rows, least = near_copies.bands_for(s)
        assert bands * rows <= near_copies.SAMPLES and (1 - s**rows) ** bands <= near_copies.LOSS
        assert least < near_copies.SAMPLES * s
    assert near_copies.bands_for(0.8)[:2] == (16, 4)


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    code = np.sort(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    weight = rng.uniform(0.2, 2.0, 400).astype(np.float32)
    a, b = np.arange(0, 300), np.arange(100, 400)
    both = near_copies.sketch(np.concatenate([code[a], code[b]]), np.concatenate([weight[a], weight[b] * 1.5]), np.array([300, 300]))
    true = near_copies.weighted_jaccard((code[a], weight[a]), (code[b], weight[b] * 1.5))
    assert abs((both[0] == both[1]).mean() - true) < 0.2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (600, 600)], "a long, b long")
    root = {r["id"]: r["root"] for r in components(links).collect()}
    assert set(root[i] for i in range(201)) == {0}
    assert root[500] == root[400] == 400
    assert components(links.limit(0)).count() == 0


def removed(texts, length):
    first = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        out[i] = gone
    return out


@pytest.mark.parametrize("length", [25, 50])
def test_repeats_against_brute_force(spark, rows, docs, nothing, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    gone = removed(texts, length)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, length).collect()}
    assert len(got) == len(rows)
    for i, t in texts:
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[i]])
        spans = int((gone[i] & ~np.append(False, gone[i][:-1])).sum()) if len(t) else 0
        g = got[i]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(t), int(gone[i].sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffixes.remove_repeats(nothing).count() == 0


def test_crowded_seed_is_split_and_merged(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 400)
    passage = "the very same twenty bytes and some more of them here."
    rows = [(i, f"{i * 7919 % 1000:04d}{'x' if i % 2 else 'y'}" * 3 + passage + f"{i % 3}" * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = removed([(i, t.encode()) for i, t in rows], 50)
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(df).collect()}
    assert got == {i: int(g.sum()) for i, g in gone.items()}


def test_copies_that_pass_the_filter_leave_the_first_text(spark, monkeypatch):
    monkeypatch.setattr(filters, "MAX_BITS", 3)  # eight bits: every document is a hit
    monkeypatch.setattr(filters, "SLICE_BITS", 3)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abcdefgh "), 120)) for _ in range(6)]
    rows = [(i + 10 * k, t) for k in range(4) for i, t in enumerate(texts)]
    rows += [(50, texts[0]), (50, "another text of this document, which no other document has at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_text"] is None) for r in suffixes.kept_texts(df).collect())
    assert got == sorted((i, len(t), 0 if i < 10 or t not in texts else len(t), i < 10 or t not in texts) for i, t in rows)


def test_suffix_array_order():
    rng = np.random.default_rng(4)
    for top in (2, 3, 20):
        text = rng.integers(0, top, 300).astype(np.uint8)
        sa, same = suffixes.suffix_array(text, 12)
        raw = text.tobytes()
        cut = [raw[i : i + 12] for i in sa]
        assert sorted(sa) == list(range(300))
        # short suffixes end before any byte; they differ from longer ones beyond their end
        assert [c for c in cut if len(c) == 12] == sorted(c for c in cut if len(c) == 12)
        full = [(a, b, s) for a, b, s in zip(cut[:-1], cut[1:], same[1:], strict=True) if len(a) == len(b) == 12]
        assert all(s == (a == b) for a, b, s in full)


def test_classifier_learns(spark, nothing):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"], 30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "the", "of"], 30)) for _ in range(60)]
    data = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as label")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_model.classify(docs, labels).collect()}
    assert len(out) == len(data)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    assert np.mean([out[i]["predicted"] == int(i < 150) for i in range(210)]) > 0.97
    kept = quality_model.accepted(docs, quality_model.learn(docs, labels))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["predicted"]}
    assert quality_model.classify(nothing, labels).count() == 0
    assert quality_model.classify(docs, labels.limit(0)).count() == len(data)
    assert quality_model.classify(docs, labels.filter("quality = 1")).filter("predicted = 1").count() == len(data)


def test_dual_descent_against_an_exact_solver():
    rng = np.random.default_rng(2)
    index = [np.sort(rng.choice(40, rng.integers(3, 12), replace=False)) for _ in range(30)]
    label = (np.array([i.sum() for i in index]) > np.median([i.sum() for i in index])).astype(np.int64)
    flat, counts = np.concatenate(index), np.array([len(i) for i in index])
    ratio, damp, cost = rng.normal(size=40), 0.7, 10.0
    w, bias = quality_model.dual_coordinate_descent(flat, counts, label, ratio, damp, cost, passes=4000)
    x = np.zeros((30, 41))
    for i, j in enumerate(index):
        x[i, j] = ratio[j] / np.sqrt(ratio[j] @ ratio[j] + damp)
    x[:, 40] = 1.0  # the bias
    y = np.where(label == 1, 1.0, -1.0)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(30), 1.0 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200000):  # projected gradient on the whole dual
        alpha = np.clip(alpha - step * (q @ alpha - 1.0), 0.0, cost)
    exact = x.T @ (alpha * y)
    primal = lambda v: v @ v / 2 + cost * np.maximum(0, 1 - y * (x @ v)).sum()
    assert abs(primal(np.append(w, bias)) - primal(exact)) < 1e-2 * primal(exact)
    assert np.abs(np.append(w, bias) - exact).max() < 0.05


def test_the_mean_model_is_the_one_calibrated():
    rng = np.random.default_rng(3)
    models = [{"fold": f, "weights": rng.normal(size=8) * r, "ratio": r, "bias": rng.normal(), "damp": 1.0} for f in range(4) for r in [rng.normal(size=8)]]
    mean = quality_model.averaged(models)
    assert np.allclose(mean["weights"], sum(m["weights"] for m in models) / 4)  # of the products, not the product of means
    left = quality_model.averaged(models, without=2)
    assert np.allclose(left["weights"] * 3, sum(m["weights"] for m in models) - models[2]["weights"])
    assert quality_model.averaged(models[:1], without=0)["bias"] == models[0]["bias"]


def test_classifier_of_repeated_rows_and_long_texts(spark):
    texts = [("good plain words here " * 8 + str(i), 1) for i in range(60)] + [("## $$ buy " * 8 + str(i), 0) for i in range(60)]
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(texts)] * 2, "doc_id long, quality int")
    once = spark.createDataFrame(rows + [(500, "good plain words " * 20000)], "doc_id long, text string")
    often = spark.createDataFrame(rows + [rows[0]] * 200 + [(500, "good plain words " * 20000)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in quality_model.classify(d, labels).collect()} for d in (once, often))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a) and a[500] > 0.7  # a repeated row teaches once
    assert quality_model.classify(often, labels).count() == 321


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = np.random.default_rng(8)
    pick = lambda n: " ".join(rng.choice([a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "den", "pol", "s")], n))
    shared = pick(20)
    texts = [pick(60) for _ in range(40)] + ["SPAM!! " * 40 + str(i) for i in range(12)]
    texts += [texts[0], texts[1] + " end", pick(20) + " " + shared + " " + pick(20), pick(20) + " " + shared + " " + pick(20)]
    n = len(texts)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 40 or i >= 52), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    a = stage["quality"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in a.collect()} == set(range(n)) - set(range(40, 52))
    b = stage["near_dedup"](spark, a, str(tmp_path))
    assert {r["doc_id"] for r in b.collect()} == set(range(n)) - set(range(40, 52)) - {52, 53}
    c = {r["doc_id"]: r for r in stage["suffix_dedup"](spark, b, str(tmp_path)).collect()}
    assert shared in c[n - 2]["text"]
    assert shared not in c[n - 1]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in c.values())
    assert b.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) <= set(c)
    assert (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_stages_keep_documents_without_id_and_rows_once(spark):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    pick = lambda n: " ".join(rng.choice([a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "den", "pol", "s")], n))
    texts = [pick(60) for _ in range(12)]
    shared = pick(20)
    rows = [(i, t) for i, t in enumerate(texts[:8])] + [(None, texts[8]), (None, texts[8]), (None, texts[9]), (None, texts[0])]
    rows += [(20, shared + " " + pick(30))] + [(21, shared + " " + texts[10])] * 4 + [(22, texts[11])] * 5
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert seen(stage["near_dedup"](spark, docs, "")) == sorted(set(rows) - {(None, texts[0])}, key=repr)
    cut = seen(stage["suffix_dedup"](spark, docs, ""))
    assert len(cut) == len(rows)
    assert sum(shared in t for i, t in cut if i == 21) == 0 and sum(i == 21 for i, _ in cut) == 4
    taken = seen(stage["mixture"](spark, docs, ""))
    words = sum(len(t.split()) for _, t in rows)
    assert abs(sum(len(t.split()) for _, t in taken) - 1.5 * words) <= 60
    assert all(taken.count(r) <= 2 * rows.count(r) for r in taken) and any(i is None for i, _ in taken)


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = np.random.default_rng(31)
    pick = lambda n: " ".join(rng.choice([a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "den", "pol", "s")], n))
    more = ["_id", "_text", "_sha", "_kept", "_copy", "_n", "_turn", "_source", "_size", "_sum", "_rows", "slack", "offset", "class_id", "label", "score"]
    rows = [(i, pick(30), "en", "s", 0) for i in range(6)] + [(6, None, None, None, 0), (7, "", "en", None, 0), (None, pick(30), "en", "s", 0)]
    rows.append((9, pick(20000), "en", "t", 0))
    docs = spark.createDataFrame([(*r, *more) for r in rows + rows[:2]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)))
            assert kept.columns == docs.columns, name
            assert kept.filter("`_kept` != '_kept' or score != 'score'").count() == 0, name
            if name == "near_dedup" and start is docs:
                assert kept.count() == 9  # the null text and the empty one are one class
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert (packed.count() > 0) == (start is docs)
