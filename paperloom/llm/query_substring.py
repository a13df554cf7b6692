"""op6: repeated passages of 20 words or more removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import substring_dedup

NAME = "op6_substring_dedup"
ORACLE_SQL = None  # too slow in SQL on whole tables: the tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup.digests(docs, substring_dedup.repeated_spans(docs))
