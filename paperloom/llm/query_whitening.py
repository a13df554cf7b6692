"""op13: all embeddings on the 16 leading components of their exact covariance, whitened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import whitening

NAME = "op13_whitening"
ORACLE_SQL = None  # SQL has no eigenvectors: the tests hold it against fractions and a direct decomposition


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
