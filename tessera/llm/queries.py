"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, kd_shards, language_model, licenses, negatives, ngram_join, packing, periodic, preferences, quality, token_store, url_rules
from .runtime import dealt, table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store.read_documents(token_store.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(dealt(table(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(dealt(table(spark, sf_dir, "documents")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.flat(preferences.format_preferences(preferences.pairs_by_parity(table(spark, sf_dir, "conversations"))))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(dealt(table(spark, sf_dir, "documents")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_ids, op2_decontaminate, op3_url_rules, op4_quality, op5_licenses, op6_ngram_join, op7_language_model, op8_preferences, op9_bpe, op10_kd_shards, op11_periodic_runs, op12_packing,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": url_rules.ORACLE_SQL,
    "op6_ngram_join": ngram_join.ORACLE_SQL,
    "op8_preferences": preferences.ORACLE_SQL,
}
