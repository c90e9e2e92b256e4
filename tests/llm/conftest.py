import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, `size` string"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "vé") for b in ("ra", "den", "pol", "s", "x.", "th,")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones, and repeated rows."""
    rng = random.Random(5)
    passage = words(rng, 25)
    texts = [words(rng, rng.choice([3, 30, 80, 200])) for _ in range(40)]
    near = texts[3] = words(rng, 120)
    texts += [near, near.replace(near.split()[50], "changed", 1), near, None, "", "   ", None, words(rng, 4000), "aaaa" * 60, "b" + "aaaa" * 40]
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(4)]
    out = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", "ü", None][i % 4] if i % 2 else "src0", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
