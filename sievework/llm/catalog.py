"""The registered queries of the corpus operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import bpe, contamination, lines, near_duplicates, quality_model, quality_rules, secrets, shards, substrings, token_counts
from sievework.session import table

Query = Callable[[SparkSession, str], DataFrame]


def vocab_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocab_path())


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), config=near_duplicates.NearConfig(shingle=4))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocab_path())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_secret_scan, op3_quality_classifier, op4_sharding, op5_line_dedup, op6_decontamination, op7_token_counts, op8_minhash_near_dedup, op9_bpe_round_trip, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": lines.ORACLE, "op6_decontamination": contamination.ORACLE, "op8_minhash_near_dedup": near_duplicates.links_oracle(4)}
