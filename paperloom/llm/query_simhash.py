"""op11: near-duplicate components of all documents by 64-bit fingerprints at most two bits apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import simhash

NAME = "op11_simhash"
ORACLE_SQL = None  # the hash is not in SQL: the tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
