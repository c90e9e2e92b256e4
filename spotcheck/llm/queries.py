"""The operators as queries over whole tables, and their SQL for DuckDB where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotcheck.llm import divergence, mixing, neighbours, quality_rules as rules, quotations, sharding, suffixes, tokenfiles, turns
from spotcheck.llm.frames import fresh_path
from spotcheck.llm.near_copies import near_copies
from spotcheck.llm.packing import pack_documents
from spotcheck.llm.quality_model import classify, held_out
from spotcheck.llm.sharding import shard_documents
from spotcheck.llm.tokencounts import count_tokens

TOKENIZERS: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """A public tokenizer's file; TOKENIZERS may name another place."""
    if name in TOKENIZERS:
        return TOKENIZERS[name]
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=16)


def op3_weighted_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir), similarity=0.8)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), limit=2048)


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), length=50)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(turns.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    tokenfiles.write_token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), path, end_id=2)
    return tokenfiles.id_checksums(tokenfiles.read_token_files(spark, path))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir), least=10, top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kmeans_tree_neighbours,
        op2_minimax_sharding,
        op3_weighted_minhash_dedup,
        op4_token_counts,
        op5_quotation_linking,
        op6_entropy_mixing,
        op7_best_fit_packing,
        op8_quality_classifier,
        op9_adaptive_quality_rules,
        op10_suffix_array_dedup,
        op11_conversation_repair,
        op12_orc_token_files,
        op13_source_divergence,
    )
}
SQL: dict[str, str] = {
    "op2_minimax_sharding": sharding.SQL,
    "op5_quotation_linking": quotations.SQL,
    "op9_adaptive_quality_rules": rules.SQL,
    "op10_suffix_array_dedup": suffixes.SQL,
    "op11_conversation_repair": turns.SQL,
    "op13_source_divergence": divergence.SQL,
}
