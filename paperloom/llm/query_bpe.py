"""op5: every document encoded and decoded with the public byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe_lexicon

NAME = "op5_bpe"
ORACLE_SQL = None  # SQL has no BPE; tests hold the result against the tokenizers library
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_lexicon.digests(docs, VOCABULARY, lexicon_uri=bpe_lexicon.build(docs, VOCABULARY))
