"""The corpus pipeline: quality, near copies, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but
the last return the columns of ``documents``; doc_id names a document until the mixture,
which gives a document a row for each of its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from spotcheck.llm import mixing, near_copies, packing, quality_model, queries, suffixes
from spotcheck.llm.frames import materialize


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, whatever its further columns are called."""
    have, lead = {c.lower() for c in docs.columns}, "_"
    while any(lead + n in have for n in names):
        lead += "_"
    return [lead + n for n in names]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels that are not held out, does not reject.

    Null texts are scored as empty ones; documents without a doc_id have no label and are
    scored alike; repeated rows are judged one by one; further columns stay; an empty table
    gives an empty one, and without labels every score is the threshold, so all stay.
    """
    model = quality_model.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)
    return quality_model.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: of the document of the smallest doc_id.

    A document without a doc_id is named by its text, so it stays if no other is like it;
    such names come after usual ids.  Null and empty texts are one class; of repeated rows
    one stays; further columns stay; an empty table gives an empty one.
    """
    id_, same = free_names(docs, "id", "text")
    name = F.expr("coalesce(cast(doc_id as long), (xxhash64(text) & 4611686018427387903) | 4611686018427387904)")
    classes = near_copies.near_copies(docs.select(name.alias("doc_id"), "text"), similarity=0.8)
    firsts = classes.filter("doc_id = class_id").select(F.col("doc_id").alias(id_)).distinct()
    kept = docs.withColumn(id_, name).join(firsts, id_, "left_semi")
    return kept.withColumn(same, F.xxhash64("text")).dropDuplicates([id_, same]).select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a document of smaller doc_id has.

    Rows without a doc_id come first and are one document; a null text stays null; repeated
    rows lose the same bytes; n_chars follows the text; further columns stay; an empty table
    gives an empty one.
    """
    id_, sha, kept = free_names(docs, "id", "sha", "kept")
    left = suffixes.kept_texts(docs, length=50).filter("n_removed > 0").select(F.col("doc_id").alias(id_), F.col("sha256").alias(sha), F.col("kept_text").alias(kept))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.sha2(F.col("text").cast("binary"), 256) == F.col(sha))  # a row meets the result for its own text
    out = docs.join(left.dropDuplicates([id_, sha]), same, "left").withColumn("text", F.coalesce(kept, "text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it, two at most.

    A null text has no words and is never taken; a null source is a source of its own, the
    last one; documents without a doc_id and repeated rows share the copies of rows like them,
    none gets those of another twice; further columns stay; an empty table gives an empty one.
    """
    id_, source, size, sum_, rows, turn, n, copy = free_names(docs, "id", "source", "size", "sum", "rows", "turn", "n", "copy")
    mixed = mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2, with_source=True)
    copies = mixed.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size)).agg(F.sum("copies").alias(sum_), F.count("*").alias(rows)).filter(F.col(sum_) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (mixing.word_count(F.col("text")) == F.col(size))
    taken = docs.join(copies, same).withColumn(turn, F.row_number().over(Window.partitionBy(id_, source, size).orderBy(F.xxhash64("text"))))
    own = F.floor(F.col(sum_) / F.col(rows)) + F.when(F.col(turn) <= F.col(sum_) % F.col(rows), 1).otherwise(0)
    return taken.withColumn(n, own).filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence of at most 1024 tokens.

    A null or empty text is one piece of the end token; repeated rows, as the copies of the
    mixture, are packed one by one; ids may be null; further columns end here; an empty table
    gives an empty one.
    """
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixture", mixture), ("pack", pack)]
#: The classifier, the sampler and the tokenizer have no SQL form; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
