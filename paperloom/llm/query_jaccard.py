"""op9: near-duplicate components of all documents by five-word shingles and a similarity of 0.75."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import jaccard_join

NAME = "op9_jaccard_join"
ORACLE_SQL = None  # too slow in SQL on whole tables: the tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
