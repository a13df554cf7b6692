"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import shared

HOT_ROWS, HOT_KEYS = 200, 100_000


def met(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key and, in `rows`, how many rows of left have it.

    A key of very many rows would put them all into one task. So the keys of more than HOT_ROWS rows are
    broadcast, at most HOT_KEYS of them, those of most rows first; all others are joined by shuffle. A key
    that isn't broadcast has no more than its share of HOT_KEYS equal ones. how: inner, left, left_semi, left_anti.
    """
    keys = [key] if isinstance(key, str) else key
    right = shared.written(right, "keys")
    hot = right.where(F.col("rows") > HOT_ROWS)
    n = hot.count()
    if not n:
        return left.join(right, keys, how)
    if n > HOT_KEYS:
        hot = shared.written(hot.orderBy(F.desc("rows"), *keys).limit(HOT_KEYS), "hot-keys")
    first = left.join(F.broadcast(hot), keys, "inner" if how == "left" else how)
    rest = right.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    if how == "left_anti":
        return first.join(rest, keys, how)
    return first.unionByName(left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys, how))
