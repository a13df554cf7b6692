"""op1: all documents packed into sequences of at most 1024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import packing

NAME = "op1_packing"
ORACLE_SQL = None  # SQL has no BPE; tests hold pieces against the tokenizers library and the bins against their limits
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)
