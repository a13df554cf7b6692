"""Rows that are hard on operators, and plain versions of what the operators compute."""

import re

import pyarrow as pa

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, `_id` string, `_key` string, size string, hash string, `_live` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs(spark, rows):
    """documents with columns whose names clash with working columns; rows of (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 7, "x", "i", "k", "z", "h", "l") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def column(texts):
    return pa.array(texts, pa.string())
