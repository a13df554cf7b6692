"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Query vectors are written to the shared folder in blocks; every task memory-maps one block after the
other, so neither queries nor rows pass through the driver and nothing that grows is broadcast. A
task holds its rows in vertical layout (one array for each dimension). For each query it adds up
inner products dimension block by dimension block; after each block the mass that remains (the
product of the norms over the dimensions to come) bounds what a row can still reach, and rows whose
bound is below the k-th best score so far are dropped from the candidates, which are compacted. A task
sends k rows for each query to the final merge.

Vectors are integers floor(scale * x). Sums stay exact: in doubles while they stay below 2**53, else in
Python integers of any size; the merge orders scores by texts that sort as the numbers do.

Query blocks are searched in groups of `QUERY_GROUP`, one job for each, whose merged lists are written before the next
begins: what a task holds and sends does not grow with the number of queries.

Defined results: a score beyond a long is null, in its right place; vectors that are null, empty or hold null or non-finite components take no part; only
vectors of the same length meet; ties go to the smaller id; every query row has its own list, also
when ids repeat; rows with the query's id are no candidates; rows with a null id take no part; a query
without candidates, or empty input, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import shared

QUERY_BLOCK = 512
QUERY_GROUP = 64
ROW_BLOCK = 8192
DIMENSION_BLOCK = 16
EXACT = float(1 << 52)


def _vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number matrix) for each length of vector in the batch of (id, vector)."""
    ids, column = batch.column(0), batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == d) & known)
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.floor(values[starts[rows][:, None] + np.arange(d)] * scale)
        good = np.isfinite(m).all(axis=1)
        if good.any():
            yield keys[rows[good]], m[good]


def _write_queries(queries: DataFrame, target: str, scale: float, block: int) -> DataFrame:
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, {}

        def flush(d: int):
            ids, m = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            shared.put(f"{target}/{part:06d}-{n:06d}-{d}", np.concatenate([ids.view(np.float64)[:, None], m], axis=1))
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], ["n"])

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                for ids, m in _vectors(batch.slice(start, block), scale):
                    held.setdefault(m.shape[1], []).append((ids, m))
                    if sum(len(x) for x, _ in held[m.shape[1]]) >= block:
                        yield flush(m.shape[1])
                        n += 1
        for d in list(held):
            yield flush(d)
            n += 1

    return queries.mapInArrow(put, "n long")


class _Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0)] * n, [np.empty(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > 4 * self.k:  # all ties of the k-th best stay for the order by id
            at = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            kept = scores >= at
            scores, ids = scores[kept], ids[kept]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = scores[order[-1]]


def _search(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: _Best, step: int) -> None:
    """Branch-and-bound of a block of queries (n, d) over rows in vertical layout (d, rows)."""
    d = queries.shape[1]
    cuts = list(range(0, d, step))
    row_mass = [np.sqrt((rows[c:] ** 2).sum(axis=0)) for c in cuts] + [np.zeros(rows.shape[1])]
    query_mass = [np.sqrt((queries[:, c:] ** 2).sum(axis=1)) for c in cuts] + [np.zeros(len(queries))]
    first = queries[:, :step] @ rows[:step]
    # The rows of greatest bound are finished first: they raise the floor that prunes the others.
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != own[q])
        score = first[q, alive]
        seeds = min(4 * best.k, len(alive))
        if best.floor[q] == -np.inf and len(alive) > 8 * seeds:
            lead = np.argpartition(-score, seeds)[:seeds]
            best_first = queries[q] @ rows[:, alive[lead]]
            if len(lead) >= best.k:
                floor = np.partition(best_first, len(lead) - best.k)[len(lead) - best.k]
            else:
                floor = -np.inf
        else:
            floor = best.floor[q]
        for n, c in enumerate([*cuts[1:], d], 1):
            bound = score + query_mass[n][q] * row_mass[n][alive]
            kept = bound + 1e-9 * np.abs(bound) + 1e-6 >= floor
            if not kept.all():
                alive, score = alive[kept], score[kept]
            if c == d or not len(alive):
                break
            score = score + queries[q, c : c + step] @ rows[c : c + step][:, alive]
        if len(alive):
            best.add(q, score, ids[alive])


def _search_large(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: dict, k: int) -> None:
    """The same result in Python integers, for components too large for exact doubles."""
    whole = [[int(x) for x in column] for column in rows.T]
    for q, vector in enumerate(queries):
        v = [int(x) for x in vector]
        scored = [(-sum(a * b for a, b in zip(v, row, strict=True)), int(i)) for row, i in zip(whole, ids, strict=True) if i != own[q]]
        best[q] = sorted(best.get(q, []) + scored)[:k]


def sortable(score: int) -> str:
    """A text that sorts among others as the number does: sign, number of digits, digits; turned round below zero."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK,
    dimension_block: int = DIMENSION_BLOCK,
) -> DataFrame:
    """The k rows of greatest inner product for each row for which is_query holds."""
    spark = rows.sparkSession
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    queries = narrow.where("is_query").select("id", "vector")
    target = shared.folder(spark, "topk-queries")
    blocks = max(1, queries.count() // query_block)
    _write_queries(queries.repartition(blocks), target, scale, query_block).agg(F.sum("n")).collect()

    files = [(n, x, int(x.rsplit("-", 1)[1])) for n, x in enumerate(shared.listed(target))]

    def search(batches: Iterator[pa.RecordBatch], names: list[tuple[int, str, int]]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        large: dict[tuple[int, int], dict] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, row_block):
                for ids, m in _vectors(batch.slice(start, row_block), scale):
                    d, vertical = m.shape[1], np.ascontiguousarray(m.T)
                    for n, name, length in names:
                        if length != d:
                            continue
                        block = shared.mapped(name, np.float64).reshape(-1, d + 1)
                        own, q = block[:, 0].copy().view(np.int64), np.ascontiguousarray(block[:, 1:])
                        if n in large or np.abs(q).max() * np.abs(m).max() * d >= EXACT:
                            if n in best:  # what doubles gave so far was exact
                                b = best.pop(n)
                                large[n] = {i: [(-int(s), int(x)) for s, x in zip(b.scores[i], b.ids[i], strict=True)] for i in range(len(own))}
                            _search_large(q, own, vertical, ids, large.setdefault(n, {}), k)
                        else:
                            _search(q, own, vertical, ids, best.setdefault(n, _Best(len(own), k)), dimension_block)
        for n, name, d in names:
            found = [(i, int(s), int(x)) for i in range(len(best[n].ids)) for s, x in zip(best[n].scores[i], best[n].ids[i], strict=True)] if n in best else [(i, -s, x) for i, pairs in large.get(n, {}).items() for s, x in pairs]
            if found:
                own = shared.mapped(name, np.float64).reshape(-1, d + 1)[:, 0].copy().view(np.int64)
                at, score, ids = zip(*found, strict=True)
                at, ids = np.array(at, np.int64), np.array(ids, np.int64)
                exact = [x if -(1 << 63) <= x < 1 << 63 else None for x in score]
                arrays = [pa.array(np.full(len(at), n, np.int64)), pa.array(at), pa.array(own[at]), pa.array(ids), pa.array(exact, pa.int64()), pa.array(list(map(sortable, score)))]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "place", "query_id", "vec_id", "score", "order"])

    def merged(names: list[tuple[int, str, int]]) -> DataFrame:
        local = narrow.select("id", "vector").mapInArrow(lambda b: search(b, names), "block long, place long, query_id long, vec_id long, score long, order string")
        order = Window.partitionBy("block", "place").orderBy(F.col("order").desc(), "vec_id")
        ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    if len(files) <= QUERY_GROUP:
        return merged(files)
    out = None
    for start in range(0, len(files), QUERY_GROUP):
        part = shared.written(merged(files[start : start + QUERY_GROUP]), "topk")
        out = part if out is None else out.union(part)
    return out
