import hashlib
import itertools
import random
import re
import zlib

import pytest

from spotcheck.llm import turns

LEGAL = re.compile(r"(s?(ua)+)?\Z")
ROLES = {"user": "u", "assistant": "a"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """All ways to edit the rows with at most two inserts in a gap, the cheapest and ASCII-least of those that are legal."""
    each = faults(rows)
    choices = []
    for (role, _), fault in zip(rows, each, strict=True):
        more = 3 if fault == "truncated" else 0
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", more, role), ("R", 3 + more, "user"), ("R", 3 + more, "assistant")]
        gaps = [("", 0, [])] + [("I" * n, 3 * n, list(r)) for n in (1, 2) for r in itertools.product(ROLES, repeat=n)]
        choices.append([(g[0] + o[0], g[1] + o[1], g[2], o[2]) for g in gaps for o in own])
    ends = [("", 0, [])] + [("I" * n, 3 * n, list(r)) for n in (1, 2) for r in itertools.product(ROLES, repeat=n)]
    best = None
    for picked in itertools.product(*choices):
        roles = [(r, "") for r in ()]
        for (_, text), (_, _, put, role) in zip(rows, picked, strict=True):
            roles += [(r, "") for r in put] + ([(role, text)] if role is not None else [])
        for edits, price, put in ends:
            whole = roles + [(r, "") for r in put]
            if LEGAL.match("".join(r[:1] or "-" for r, _ in whole)):
                found = (sum(p[1] for p in picked) + price, "".join(p[0] for p in picked) + edits, whole)
                best = found if best is None or found[:2] < best[:2] else best
    return best


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_reports_against_all_edits(spark, seed):
    rng = random.Random(seed)
    table, convs = [], {}
    for conv in range(25):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c! ", "d?", f"{conv}.", "e\n"])) for _ in range(rng.randint(0, 3))]
        convs[conv] = rows
        table += [(conv, i, r, t) for i, (r, t) in enumerate(rows)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in turns.repair_report(df).collect()}
    assert set(got) == {c for c, rows in convs.items() if rows}
    for conv, r in got.items():
        rows, (cost, audit, whole) = convs[conv], brute(convs[conv])
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, digest(whole))
        each = faults(rows)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [each.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)) and r["gaps"] == 0


def test_nulls_ties_repeats_and_dropped_conversations(spark):
    rows = [
        (None, 0, "user", "a."), (None, None, None, None), (None, None, "system", "b."),  # a conversation without a name
        (7, 3, "user", "x."), (7, 3, "user", "x."), (7, 9, "assistant", "y."),  # a repeated row, a gap
        (8, None, "assistant", "z."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"alive": turns.F.expr("true"), "_conv": turns.F.lit("clash"), "place": turns.F.lit(1)})
    df = df.unionByName(df.limit(1).selectExpr("9L as conv_id", "1L as turn", "'user' as role", "'gone.' as text", "false as alive", "_conv", "place"))
    got = {r["conv_id"]: r for r in turns.repair_report(df).collect()}
    assert got[7].asDict() == {"conv_id": 7, "gaps": 5, "blank": 0, "duplicate": 1, "truncated": 0, "illegal": 1, "cost": 4, "audit": "KDK", "repaired_sha256": digest([("user", "x."), ("assistant", "y.")])}
    assert (got[8]["gaps"], got[8]["audit"], got[8]["cost"]) == (0, "IK", 3)
    assert (got[9]["audit"], got[9]["cost"], got[9]["repaired_sha256"]) == ("", 0, digest([]))
    assert (got[None]["blank"], got[None]["illegal"]) == (1, 1)  # the nulls come first: " ", "system", then "user"
    assert got[None]["audit"] == "DKKI" and got[None]["cost"] == 7
    assert turns.repair_report(df.limit(0)).count() == 0


def test_long_conversation_is_spooled(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", f"{i}.", "w " * rng.choice([1, 20000]) + "."])) for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = turns.repair_report(df).collect()
    monkeypatch.setattr(turns, "SPOOL", 1 << 12)
    assert turns.repair_report(df).collect() == want
    out = turns.repair(df).filter("place >= 0").orderBy("place").collect()
    assert LEGAL.match("".join(r["role"][0] for r in out)) and digest([(r["role"], r["text"]) for r in out]) == want[0]["repaired_sha256"]
    assert [r["edit"] for r in out] == [c for c in want[0]["audit"] if c != "D"]
    each, cost = faults([(r, t) for _, _, r, t in rows]), {0: 0}
    for (_, _, role, _), fault in zip(rows, each, strict=True):  # costs alone, by states and no more than two inserts in a gap
        new = {}
        for state, c in cost.items():
            for n in range(3):
                steps = [(4, state)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    steps += [(3 + more, turns.NEXT[state])]
                    if role == "system" and state == 0:
                        steps += [(more, 1)]
                    if role == turns.NAME[turns.NEXT[state]]:
                        steps += [(more, turns.NEXT[state])]
                for price, to in steps:
                    new[to] = min(new.get(to, 1 << 60), c + 3 * n + price)
                state = turns.NEXT[state]
        cost = new
    assert want[0]["cost"] == min(c + 3 * len(turns.ENDING[s]) for s, c in cost.items())


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c}?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in turns.damage(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["alive"]))
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        assert got[c, t] == [("user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
