"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("html_extract", "jaccard_join", "license_scan", "language_id", "minhash_dedup", "mixing", "packing", "quality_classifier", "quality_rules", "substring_dedup", "token_alignment", "topk_search", "vector_codes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in import_module(f"receivia.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"receivia.llm.{m}").ORACLES.items()}
