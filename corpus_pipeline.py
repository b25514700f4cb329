"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents; the last returns the packed pieces. ORACLE_SQL is None: near-duplicate components by signatures
and byte-level BPE ids are nothing that SQL expresses; a test compares every stage and run() with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import bytebpe, exact_dedup, minhash_join, packing, quality_rules, shared, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go; documents that fail the base rules or lose too much go."""
    return quality_rules.filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the one with the largest doc_id stays."""
    return exact_dedup.unique(docs, shared.scratch(spark, "digest-index"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return minhash_join.representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 13 words or more that a document with a smaller doc_id has too are cut out."""
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids, each a sequence."""
    return packing.pack(docs.select("doc_id", "text"), bytebpe.installed("byte_bpe_50k.json")).drop("row")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("minhash near-dedup", near), ("substring dedup", substrings), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
