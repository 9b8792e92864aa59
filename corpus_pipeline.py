"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm import jaccard_join, mixing, packing, quality_rules, substring_dedup
from receivia.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies stays."""
    return jaccard_join.keep_one(docs, n=5, num=8, den=10)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id holds are cut out of the text."""
    shorter = substring_dedup.remove_repeats(docs)
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shorter


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered weight of their source uses them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in its sequence."""
    return packing.pack(docs, carry="crc32")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings), ("mixing", mix), ("packing", pack)]
#: The stages iterate, hash and tokenise, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
