"""From raw documents to packed training sequences: clean, drop copies and near copies, mask, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.block_naming import drop_exact_duplicates
from quotelake.llm.group_join import drop_near_duplicates
from quotelake.llm.line_rules import keep_clean
from quotelake.llm.packing import pack
from quotelake.llm.pseudonyms import pseudonymize
from quotelake.llm.tables import keep, table

KEY = b"quotelake demonstration key"  # users set their own
ORACLE_SQL = None  # keyed permutations and packing cannot be said in SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep; a null or short text is rejected."""
    return keep_clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of repeated rows one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles are similar to 0.8 or more."""
    return drop_near_duplicates(docs, size=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated personal numbers, addresses and dates replaced by keyed pseudonyms; `n_chars` follows the text."""
    masked = pseudonymize(docs, KEY)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in masked.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii),
          ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
