"""op2: a Kneser-Ney model of nine tenths of the documents, and the score of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import kneser_ney

NAME = "op2_lm_score"
ORACLE_SQL = None  # a brute-force model in the tests gives the same scores


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()))
    scored = kneser_ney.score(docs, model)
    return scored.select(
        "doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
