"""Token counts and packing against the library itself."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from spotcheck.llm.packing import best_fit_decreasing, cut_pieces, lower_bound, pack, pack_documents  # noqa: E402
from spotcheck.llm.tokencounts import count_tokens  # noqa: E402

ODD = [
    "it's 'S 'se  'll\n\n 've\t'm x''s !'s \n'd don't  end  ", "  ", "\n", "a\n", "a \n b", "'", "''s", "x'", "x's", "日本 it's", "ΣΑΣ İstanbul", "<|endoftext|> hi <|startoftext|>",
    "é'É ÀÇ 12 345a ²3 × ÷ª", "a b c", "\x1c x", "ŒUVRE œuvre Ÿ ĳ ŀ", "<|", "emoji 😀 x", "é nfc", "1'd 's", "\r\n x", "A'LL B'VE c'Re", "\x85 a", "   'x", "'re'", "'l", "'r", "a'", "a" * 3000,
]


ODD += ["plain words — and a dash, ’quoted’ words", "a\u00a0b c\u2003d plain", "x<|endoftext|>y z <|endoftext|> w", "co\u0301mbining \u0301 mark e \u0301f", "ΑΣ Σ ΣΑ word ǅ ﬁne", "日本 日本 plain 日本", "tab\tand\x0bvertical\x0cfeed — x", "it’s it's—'s 'S—x"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(name)))


def test_counts_are_the_librarys(spark, rows, docs):
    tok = library("word_bpe_49k.json")
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in count_tokens(docs.select("doc_id", "text").union(odd), str(public_tokenizers.path("word_bpe_49k.json")), limit=100).collect()}
    for i, t in [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t


def test_counts_of_repeated_and_no_rows(docs, nothing):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert count_tokens(docs.union(docs), path).count() == 2 * docs.count()
    assert count_tokens(nothing, path).count() == 0


def test_pieces_and_packing(spark, rows, docs):
    tok = library("byte_bpe_50k.json")
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = pack_documents(df, str(public_tokenizers.path("byte_bpe_50k.json")), capacity=64, per_partition=40).toPandas()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = out[out["doc_id"] == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own)))
        at = 0
        for k, p in enumerate(own.itertuples()):
            assert p.start == at
            assert p.length == 64 or k == 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        assert s["length"].sum() <= 64
    best = lower_bound(np.bincount(out["length"], minlength=65))
    assert best <= out["sequence_id"].nunique() <= best * 1.05 + 2


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 21, rng.integers(1, 60))
        bins, fill = best_fit_decreasing(lengths, 20)
        assert np.bincount(bins, lengths).tolist() == fill.tolist()
        assert fill.max() <= 20
        assert -(-lengths.sum() // 20) <= lower_bound(np.bincount(lengths, minlength=21)) <= len(fill)
    assert lower_bound(np.bincount([11] * 7, minlength=21)) == 7
    assert lower_bound(np.bincount([7] * 6, minlength=21)) == 3


def test_packing_of_no_rows_and_ids(spark, docs, nothing):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert pack_documents(nothing, path).count() == 0
    row = cut_pieces(docs.limit(1), path, with_ids=True).first()
    assert zlib.crc32(bytes(row["ids"])) == row["ids_crc32"]
    assert pack(spark.createDataFrame([(1, 10)] * 3, "doc_id long, length long"), capacity=20).select("sequence_id").distinct().count() == 2


def test_packing_near_the_bound_and_equal_rows_apart(spark):
    rows = spark.createDataFrame([(1, 10, "a")] * 3000, "doc_id long, length long, offset string")
    out = pack(rows, capacity=20, per_partition=100).toPandas()
    assert out.groupby("sequence_id").size().tolist() == [2] * 1500
    mixed = spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.random.default_rng(6).integers(1, 30, 4000))], "doc_id long, length long")
    packed = pack(mixed, capacity=64, per_partition=500).toPandas()
    bound = lower_bound(np.bincount(packed["length"], minlength=65))
    assert packed["sequence_id"].nunique() <= bound + 1
    assert (packed.groupby("sequence_id")["length"].sum() <= 64).all()
