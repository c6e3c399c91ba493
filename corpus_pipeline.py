"""Documents from raw to packed, in five stages; each is stored and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tunestrata.llm import packing, pii, quality, rules, simhash
from tunestrata.llm.common import read, ship_package, written


def likely_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.7 or above."""
    ship_package(spark)
    return quality.keep_likely_good(docs, read(spark, sf_dir, "labels"))


def rules_passed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    ship_package(spark)
    return rules.keep_good(docs)


def near_duplicates_dropped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Near is what op1 calls near: fingerprints of three-word shingles that differ in at most 3 of 64
    bits. Copies with a few changed words mostly differ in more and stay; the README has the recall.
    """
    ship_package(spark)
    return simhash.keep_one(docs)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    ship_package(spark)
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", likely_good),
    ("quality_rules", rules_passed),
    ("near_duplicates", near_duplicates_dropped),
    ("personal_data", personal_data_masked),
    ("packing", packed),
]

#: Tokenizing, compressing and learning have no counterpart in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
