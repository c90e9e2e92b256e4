import re
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest

from spotcheck.llm import queries, tokenfiles


@pytest.fixture(scope="module")
def written(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tokens')}/ids"
    tokenfiles.write_token_files(docs, queries.tokenizer("word_bpe_49k.json"), path, stripe_bytes=1 << 14, index_rows=1000)
    return path


def library(rows):
    from tokenizers import Tokenizer

    worker = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    return [e.ids + [2] for e in worker.encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False)]


def test_files_hold_the_ids_of_the_library(spark, rows, written):
    ids, start = library(rows), 0
    got = sorted(tokenfiles.read_token_files(spark, written).collect(), key=lambda r: r["doc_id"])
    sums = {r["doc_id"]: r["ids_crc32"] for r in tokenfiles.id_checksums(tokenfiles.read_token_files(spark, written)).collect()}
    assert len(got) == len(rows)
    for r, own in zip(got, ids, strict=True):
        assert (list(r["ids"]), r["start"], r["n_tokens"]) == (own, start, len(own))
        assert sums[r["doc_id"]] == zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)
    index = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in tokenfiles.token_index(spark, written).collect()}
    assert index == {r["doc_id"]: (r["start"], r["n_tokens"]) for r in got}


def test_odd_characters_keep_their_places(spark, tmp_path):
    texts = ["plain words here", "a 中文 b Ａ１ c", "<|endoftext|> in a<|startoftext|>b text", "İstanbul ǅ x’s it's don't 12345 ½ é́", " nbsp em ​zero", "😀 smile😀d", "ſtrange ﬁne K", None, ""]
    rows = list(enumerate(texts))
    path = f"file://{tmp_path}/odd"
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer("word_bpe_49k.json"), path)
    got = {r["doc_id"]: list(r["ids"]) for r in tokenfiles.read_token_files(spark, path).collect()}
    assert [got[i] for i in range(len(texts))] == library(rows)


def test_files_are_sorted_ranges_and_lookups_are_pushed_down(spark, rows, written):
    import glob

    spans = []
    for name in sorted(glob.glob(written.removeprefix("file://") + "/*.orc")):
        ids = orc.ORCFile(name).read(columns=["doc_id"]).column("doc_id").to_pylist()
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    some = tokenfiles.read_token_files(spark, written, [3, 17, 999_999])
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "doc_id" in "".join(re.findall(r"PushedFilters: (.*)", plan)), re.findall(r"(?:Pushed|Filter).*", plan)
    got = sorted(some.collect(), key=lambda r: r["doc_id"])
    whole = {r["doc_id"]: r for r in tokenfiles.read_token_files(spark, written).collect()}
    assert got == [whole[3], whole[17]]


def test_nulls_repeats_long_and_empty(spark, nothing, tmp_path):
    long = "word " * 20000 + "end"
    rows = [(None, "b c"), (None, "a"), (None, None), (5, "x"), (5, "x"), (5, "y"), (2, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": tokenfiles.F.lit("clash"), "ids": tokenfiles.F.lit(1), "_tie": tokenfiles.F.lit(0)})
    path = f"file://{tmp_path}/some"
    tokenfiles.write_token_files(df, queries.tokenizer("word_bpe_49k.json"), path)
    got = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, None, 2, 5, 5, 5]
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert sorted(map(len, (r["ids"] for r in got))) == sorted(map(len, library([(i, t) for i, t in rows])))
    tokenfiles.write_token_files(nothing, queries.tokenizer("word_bpe_49k.json"), f"{path}-none")
    assert tokenfiles.id_checksums(tokenfiles.read_token_files(spark, f"{path}-none")).count() == 0
