"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import shared

#: Up to so many edges (16 bytes each) one task joins them; the rounds of the stars would cost more than the work.
ONE_TASK_EDGES = 1 << 20


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least neighbour of u) of each edge.

    The join key has another form than the aggregation key: a node of very many edges can then be
    split by adaptive execution, as both sides are dealt out for the join itself.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").cast("decimal(20,0)").alias("node"), "least")
    return edges.join(least, F.col("u").cast("decimal(20,0)") == F.col("node")).select("u", "v", "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both).withColumn("least", F.least("least", "u"))
    return met.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(met.select("u", F.col("least").alias("v"))).where("u <> v")


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and for each the smallest node it is joined with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        for side in (a, b):
            np.minimum.at(now, side, low)
            np.minimum.at(now, label[side], low)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, label):
            return nodes, nodes[label]
        label = now


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if parts:
            found = least_labels(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "label"])

    return edges.coalesce(1).mapInArrow(run, "node long, label long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (u, v): label is the smallest node it is joined with.

    Each round is written to the shared folder, which cuts the lineage; rounds grow with the logarithm
    of the longest chain. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    now = shared.written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    if now.count() <= ONE_TASK_EDGES:
        return shared.written(_in_one_task(now), "components")
    mark = None
    while True:
        now = shared.written(_small_star(_large_star(now)).distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_if(F.col("u") < F.col("v"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.union(found.select(F.col("label").alias("node"), "label").distinct())
