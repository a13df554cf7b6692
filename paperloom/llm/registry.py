"""The queries of the operators in this package and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "query_packing", "query_lm", "query_toxicity", "query_secret_scan", "query_bpe", "query_exact_dedup", "query_warc",
    "query_jaccard", "query_topk", "query_substring", "query_simhash", "query_trie", "query_whitening",
]


def _each():
    return [importlib.import_module(f"paperloom.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {module.NAME: module.run for module in _each()}


def oracle_sql() -> dict[str, str]:
    return {module.NAME: module.ORACLE_SQL for module in _each() if module.ORACLE_SQL is not None}
