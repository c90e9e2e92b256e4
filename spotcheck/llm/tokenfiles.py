"""Token ids of texts as ORC files, in the order of the documents.

Documents are range-partitioned by id and sorted, then encoded in that order, so each file
holds a range of ids and nothing is moved after it was encoded.  ORC's writer stores ids in
stripes as run-length encoded integers, with a row index and Bloom filters on doc_id; readers
take stripes in parallel, skip those whose statistics or filters rule a document out, and read
only the columns they need.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from spotcheck.llm.frames import text_batches
from spotcheck.llm.textbytes import chunks, tidy
from spotcheck.llm.tokencounts import encoder

SCHEMA = "doc_id long, part int, begin long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, spaces: bool = False, stripe_bytes: int = 8 << 20, index_rows: int = 1000) -> None:
    """Write the ids of each whole text and ``end_id`` to ORC files at ``path``, in ascending doc_id order.

    tokenizer: a file of the tokenizers library; spaces: whether its pre-tokens hold blanks.
    A row has doc_id, part (the number of its file's range), begin (ids before it in that
    range), n_tokens and ids (as 32-bit integers).

    A null text is empty (``end_id`` alone); null ids come first; documents of one id stand
    by the hash of their texts, so that the rows of a frequent id spread over ranges; repeated
    rows are written one by one; further columns are left out; an empty table writes an empty
    one.  A text is one value in memory, as in the table that it comes from.
    """

    def encode(batches):
        from pyspark import TaskContext

        worker, part, begin = encoder(tokenizer, spaces), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch, "text"):
                counts, flat = worker.encode(data, offsets, want_ids=True)
                stops = np.cumsum(counts)
                ids = np.insert(flat.astype(np.int32), stops, end)
                size = counts + 1
                starts = begin + np.cumsum(size) - size
                begin += int(size.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids))
                names = ["doc_id", "part", "begin", "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(starts), pa.array(size), lists], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_tie", F.xxhash64("text"))
    lined = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true"}
    text_batches(lined).mapInArrow(tidy(encode, keep=True), SCHEMA).write.mode("overwrite").options(**options).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, without reading any ids.

    The table of ranges has a row for each file's range.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return _with_start(rows.select("doc_id", "part", "begin", "n_tokens"), rows)


def _with_start(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    ranges = all_rows.groupBy("part").agg(F.max(F.col("begin") + F.col("n_tokens")).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = rows.join(F.broadcast(bases), "part").withColumn("start", F.col("begin") + F.col("_base"))
    return placed.select("doc_id", "start", "n_tokens", *[c for c in rows.columns if c == "ids"])


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents, or of those with the given ids alone.

    With ``doc_ids`` the reader drops stripes and groups of rows by their statistics and Bloom
    filters; the starts still follow from the small columns of all ranges.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    some = rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))
    return _with_start(some, rows)


def id_checksums(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_token_files`` with the crc32 of their ids as little-endian unsigned 32-bit integers in place of the ids."""

    def sums(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return text_batches(rows.select("doc_id", "start", "n_tokens", "ids")).mapInArrow(tidy(sums, keep=True), "doc_id long, start long, n_tokens long, ids_crc32 long")
