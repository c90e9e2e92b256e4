import random
import re
from collections import Counter

from spotcheck.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def brute(rows, least, top):
    counts, docs, groups = {}, {}, {}
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = Counter(lower(t) for t in TERM.findall(text))
        groups.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(terms.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = sorted(((sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pair)]
            term = sorted((((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(term[:top])]
    return sorted(out)


def check(spark, rows, least, top):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": divergence.F.lit("clash"), "term": divergence.F.lit(1), "doc_id": divergence.F.lit(None).cast("long")})
    got = divergence.audit_sources(df, least=least, top=top)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_audit_against_plain_counts(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "É", "ſo", "Zz", "中", "x") for b in ("ra", "POL", "é", "", "th")]
    rows = []
    for i in range(400):
        source = rng.choice(["s0", "s0", "s1", "s2", "ü", None])
        own = vocabulary[: 10 + 3 * len(source or "")] if source != "s1" else vocabulary
        text = " ".join(rng.choice(own) + rng.choice(["", ".", "7", "-", "\n"]) for _ in range(rng.choice([0, 2, 30])))
        rows.append((rng.choice(["en", "de", None]), source, text if rng.random() > 0.05 else None))
    check(spark, rows, 10, 10)
    check(spark, rows, 1, 3)


def test_ties_repeats_long_words_and_groups_without_terms(spark):
    same = [("en", "a", "one two three four five six")] * 12  # repeated rows, all terms tie
    rows = [*same, ("en", "b", "seven one"), ("en", "c", None), ("en", None, "123 ..."), ("fr", "a", "un"), ("fr", "b", "w" * 300_000), ("fr", "b", "mot " * 20_000), (None, None, None)]
    check(spark, rows, 10, 4)
    check(spark, rows, 1, 10)


def test_empty(spark, nothing):
    assert divergence.audit_sources(nothing).count() == 0
