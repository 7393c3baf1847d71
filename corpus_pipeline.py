"""The corpus pipeline: language ID, exact de-duplication, near-duplicates, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfolk.llm.storage import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told."""
    from kinfolk.llm.langid import keep_identified

    return keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    from kinfolk.llm.exact_dedup import drop_duplicates

    return drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    from kinfolk.llm.ngram_join import keep_first

    return keep_first(docs, words=5, percent=80)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept at rates that bring the domains' tokens to the target weights."""
    from kinfolk.llm.mixing import thin

    return thin(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    from kinfolk.llm.packing import pack

    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: Language ID, mixing and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
