"""Quotation links against a plain reading of the messages."""

import random
import re
from collections import defaultdict

from spotcheck.llm import quotations

MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")


def normal(x):
    return re.sub(r"\s+", " ", x.lower()).strip(" ")


def units(text):
    """(level, text, words) of every passage and every line in it that has words."""
    lines = [(m.group(0).count(">"), x[m.end() :]) if (m := MARKS.match(x)) else (0, x) for x in re.split("\r?\n", text or "")]
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j][0] == lines[i][0]:
            j += 1
        part = [b for _, b in lines[i:j]]
        out += [(lines[i][0], normal(x)) for x in [*part, " ".join(part)] if normal(x)]
        i = j
    return [(lv, x, len(x.split(" "))) for lv, x in out], sum(lv > 0 for lv, _ in lines), max(lv for lv, _ in lines)


def links(messages):
    """reply_to, link, thread and position of each (conv, turn), one conversation after the other."""
    by_conv, out = defaultdict(list), {}
    for m in messages:
        by_conv[m[0]].append(m)
    for conv, own in by_conv.items():
        own.sort(key=lambda m: (m[1] is not None, m[1]))
        read, seen, heirs, place = [units(m[3]) for m in own], {}, {}, []
        for i, m in enumerate(own):
            us, quoted, _ = read[i]
            votes = defaultdict(int)
            if quoted:
                outer = min((lv for lv, _, _ in us if lv > 0), default=None)
                for lv, x, n in us:
                    if lv == outer and x in seen:
                        votes[seen[x]] += n
            for lv, x, _ in us:
                if lv == 0:
                    seen[x] = i
            origin = max(((n, j) for j, n in votes.items()), default=(0, None))
            parent, link = (origin[1], "quote") if votes else (i - 1, "previous") if i else (None, "first")
            if parent is not None and parent not in heirs:
                heirs[parent] = i
                place.append((place[parent][0], place[parent][1] + 1))
            else:
                place.append((i, 0))
            out[conv, m[1]] = (None if parent is None else own[parent][1], link, own[place[i][0]][1], place[i][1], origin[0], quoted, read[i][2])
    return out


def test_against_a_plain_reading(spark):
    rng = random.Random(17)
    say = lambda n: " ".join(rng.choice("ask tell rice boil water salt pan stove cook dish bowl spoon heat mix stir".split()) for _ in range(n))
    rows = []
    for conv in [*range(30), None]:
        texts = []
        for turn in range(rng.randrange(1, 16)):
            lines = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if texts:
                    source = rng.choice(texts).split("\n")
                    part = source[rng.randrange(len(source)) :][: rng.randrange(1, 4)]
                    if rng.random() < 0.4:  # broken anew
                        flat = " ".join(part).split(" ")
                        part = [" ".join(flat[k : k + 3]) for k in range(0, len(flat), 3)]
                    mark = rng.choice(["> ", ">", " >  ", ">> ", "> > "])
                    lines += [mark + (x.upper() if rng.random() < 0.2 else x) for x in part]
                    lines += [rng.choice(["", "On Monday X wrote:"])] * rng.randrange(2)
            lines += [say(rng.randrange(1, 6)) for _ in range(rng.randrange(0, 4))] + ["Thanks all"] * (rng.random() < 0.3)
            texts.append(rng.choice(["\n", "\r\n"]).join(lines) if rng.random() < 0.95 else "")
            rows.append((conv, turn if turn or rng.random() < 0.9 else None, "r", texts[-1] or None, "x", 0))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent string, msg int")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["link"], r["thread"], r["position"], r["matched_words"], r["quoted_lines"], r["quote_depth"]) for r in quotations.link_quotations(df).collect()}
    want = links(rows)
    assert len(want) == len(rows)
    assert got == want
    assert sum(v[1] == "quote" for v in want.values()) > 50
    assert any(v[3] == 0 and v[1] == "quote" for v in want.values())
