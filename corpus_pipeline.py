"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as
the next one's docs. All stages but the last return the columns of documents.

Defined results, the operators' own: null text is empty text (not toxic unless the labels say so of no terms,
one group of copies, linked with nothing, without secrets, one end token); very long texts are used whole; of
ties the id decides; rows that repeat id and text are one document after the second stage; a row without an
id stays only if no row with an id has its text; extra columns stay until the last stage; empty tables
give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, jaccard_join, packing, query_toxicity, secret_scan, shared, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ORACLE_SQL = None  # a fitted model and BPE: tests hold each stage against brute force or labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels (without those that are held out for measuring) and drop what the model rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels.where(~query_toxicity.held_out("doc_id"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.75 on five-word shingles the one with the smallest id stays."""
    return jaccard_join.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by a mark; examples that many owners copied stay."""
    masked = secret_scan.redact(docs, repository=F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of 1024 tokens."""
    return packing.pack(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with shared.tidied() as tidy:
        for name, stage in STAGES:
            docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
            tidy()  # what the stage needed, and what the one before it gave, is not read again
    return docs
