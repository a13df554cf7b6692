"""Text similarity by matching blocks, and accent folding: the two text functions Spark has no expression for."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [None if x is None or y is None else (x, y) for x, y in zip(a, b, strict=True)]
    of = {pair: None if pair is None else SequenceMatcher(None, *pair).ratio() for pair in set(pairs)}  # a pair is compared once in a batch
    return pd.Series([of[pair] for pair in pairs], dtype="float64")


def ratio_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Whether the similarity ratio reaches the threshold.

    Equal texts and texts whose lengths alone rule the ratio out are decided without Python.
    """
    la, lb = F.char_length(a), F.char_length(b)
    bound = 2 * F.least(la, lb) >= threshold * (la + lb)
    open_ = (a != b) & bound
    # Python sees only the pairs that are open; for the others it gets nulls.
    ratio = _ratio(F.when(open_, a), F.when(open_, b))
    return F.when(a == b, True).when(~bound, False).otherwise(ratio >= threshold)


def ratios_reach(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """The same for texts that differ, inside a task."""
    close = (2 * min(len(x), len(y)) >= threshold * (len(x) + len(y)) and SequenceMatcher(None, x, y).ratio() >= threshold for x, y in zip(a, b, strict=True))
    return np.fromiter(close, bool, len(a))


@F.pandas_udf(T.StringType())
def without_accents(s: pd.Series) -> pd.Series:
    def fold(x):
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(fold)
