"""Registered queries of the subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.llm import (
    byte_bpe, conversation_trie, decontamination, exact_dedup, ngram_join, periodic, pii, quality_fm, quality_rules, secrets, sharding, url_filter, wavelet,
)
from docreg.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, root, "documents"))


def op2_factorisation_machine(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return quality_fm.score(documents, quality_fm.train(documents, table(spark, root, "labels")))


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return quality_rules.judge(documents, quality_rules.learn(documents, table(spark, root, "labels")))


def op4_sampled_splitters(spark: SparkSession, root: str) -> DataFrame:
    return sharding.report(table(spark, root, "documents"))


def op5_bootstrapped_pii(spark: SparkSession, root: str) -> DataFrame:
    return pii.report(table(spark, root, "documents"))


def multilingual_bpe(documents: DataFrame) -> byte_bpe.ByteBpe:
    ranks = byte_bpe.read_ranks(documents.sparkSession, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN).with_words(documents, sample_rows=20_000, keep=300_000)


def list_entries(spark: SparkSession, root: str) -> DataFrame:
    """A dated list from the event log: an event adds or removes the host of the page of its user's number."""
    hosts = table(spark, root, "pages").select(F.col("page_id").alias("user_id"), url_filter.host_of(F.col("url")).alias("host"))
    return table(spark, root, "events").join(hosts, "user_id").select(
        F.col("event_id").alias("entry_id"), "host", F.col("ts").alias("at"),
        F.when(F.col("event_type").isin("purchase", "error"), "add").otherwise("remove").alias("action"))


def captures(spark: SparkSession, root: str) -> DataFrame:
    """Every page, fetched at the time of the event that bears its number."""
    times = table(spark, root, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at"))
    return table(spark, root, "pages").select("page_id", "url").join(times, "page_id", "left").select(
        F.col("page_id").alias("capture_id"), "url", "fetched_at")


def op6_temporal_list_join(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.judge_captures(captures(spark, root), list_entries(spark, root))


def op7_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return byte_bpe.report(documents, multilingual_bpe(documents))


def op8_benchmark_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op10_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secrets.report(table(spark, root, "documents"))


def op9_wavelet_shards(spark: SparkSession, root: str) -> DataFrame:
    return wavelet.round_trip(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_zfast_trie(spark: SparkSession, root: str) -> DataFrame:
    return conversation_trie.trie(table(spark, root, "conversations"))


def op12_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periodic.report(table(spark, root, "documents"))


def op13_extendible_hash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.report(table(spark, root, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_factorisation_machine": op2_factorisation_machine,
    "op3_quality_rules": op3_quality_rules,
    "op4_sampled_splitters": op4_sampled_splitters,
    "op5_bootstrapped_pii": op5_bootstrapped_pii,
    "op6_temporal_list_join": op6_temporal_list_join,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_secret_scan": op10_secret_scan,
    "op11_zfast_trie": op11_zfast_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_extendible_hash_dedup": op13_extendible_hash_dedup,
}
