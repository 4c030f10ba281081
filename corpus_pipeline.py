"""A training corpus from raw documents: good ones, one of each group of copies, none with benchmark text, as token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, ngram_join, quality
from tessera.llm.runtime import prepare, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, with the columns they came with.

    Null, empty and very short texts fail; equal rows get equal verdicts and all stay; a null lang is judged by the
    base rules alone; an empty table stays empty. Columns named like those of the verdict are left as they are."""
    prepare(spark)
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, the smallest doc_id, with the columns it came with.

    Texts without words are no one's copies and stay, as do rows without a doc_id; a row repeated in full stays once; texts
    of any length are compared whole; an empty table stays empty. Columns named like those of the join are left as they are."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark, with the columns they came with.

    Null and empty texts hold none; rows with one doc_id are judged each by its own text; items without words match nothing, so
    an empty benchmark leaves all; an empty table stays empty. Columns named like those of the findings are left as they are."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row a document.

    Null and empty texts have no ids; repeated rows give repeated results; a null doc_id stays null; texts of any length are
    encoded whole; an empty table gives no rows. Other columns, whatever their names, are left out."""
    prepare(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The stages learn histograms, fingerprint windows and merge tokens: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
