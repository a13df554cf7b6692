"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (bytes other than white space and ASCII punctuation, A-Z lower-cased) and
their first 4 and 6 bytes, hashed to `1 << SLOT_BITS` slots; a text either has a term or not. The machine
adds a bias, a weight for each term and, for each pair of terms, the product of their factor vectors, so
that two terms can count together for more (or less) than each alone.

Fitting uses at most MAX_TRAIN labelled rows, those with the smallest hashes of id and text, so the model's
cost is bounded and the choice is the same at every run. All terms of these rows go into the machine: none
is judged by its own odds beforehand, as a term may matter in pairs only. It is fitted by Adam on lists of
slot numbers under a prior that keeps weights and factors at zero unless the data insist (SHRINK times the
root of the number of rows); a term in no more rows than that can't have a weight, and is left out for
that alone. The terms that keep a weight or a factor are written to the shared folder and mapped by
workers. Scoring covers every text whole.

Defined results: null and empty texts get the score of no terms; document rows that repeat an id are all
scored, and each that has a label is learned from once for each text and label it has; rows with a null
id are scored, not learned from; labels other than 0 and 1 are ignored; labels that differ for an id each
count; if the labels are all alike or none are there, every score is their mean (0 without any); very long
texts are read whole; extra columns are ignored by `score`, kept by `keep_clean`; empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import shared, words

SLOT_BITS = 22
MAX_TRAIN = 8_000
FACTORS = 8
EPOCHS, LEAST_STEPS, BATCH = 8, 600, 256
SHRINK, RATE = 0.073, 0.05
PREFIXES = (4, 6)
THRESHOLD = 0.3

#: Bytes of terms: white space and ASCII punctuation separate them.
_TERM = words.IS_WORD & ~np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
_TERM[:32] = False


@dataclass(frozen=True)
class Model:
    """`uri` has the sorted slots that count, their weights and their factors; None: every score is the prior."""

    prior: float
    bias: float = 0.0
    uri: str | None = None


@lru_cache(4)
def _arrays(uri: str) -> tuple[np.ndarray, np.ndarray]:
    slots = shared.mapped(f"{uri}/slots", np.int64)
    return slots, shared.mapped(f"{uri}/weights", np.float32).reshape(len(slots), -1) if len(slots) else np.empty((0, 1 + FACTORS), np.float32)


def _terms(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every term of every row."""
    data, offsets = words.buffers(column)
    data = words.LOWER[data]
    starts, ends, first = words.spans(np.where(_TERM[data], data, np.uint8(0x20)), offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, slots, shift = [row], [words.hashes(data, starts, ends)], np.uint64(64 - SLOT_BITS)
    for n in PREFIXES:
        longer = ends - starts > n
        rows.append(row[longer])
        slots.append(words.mix(words.hashes(data, starts[longer], starts[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(slots) >> shift).astype(np.int64)


def _found(row: np.ndarray, slot: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in known) of the slots that are known."""
    at = np.minimum(np.searchsorted(known, slot), max(0, len(known) - 1))
    hit = known[at] == slot if len(known) else np.zeros(len(slot), bool)
    distinct = np.unique(row[hit] * len(known) + at[hit]) if hit.any() else np.empty(0, np.int64)
    return distinct // max(1, len(known)), distinct % max(1, len(known))


class _Batch:
    """Some rows: their labels, their terms end to end, and the same terms in the order of their places."""

    def __init__(self, lists: list[np.ndarray], y: np.ndarray):
        self.y, self.n = y.astype(np.float32), np.array([len(x) for x in lists])
        self.known, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        row = np.repeat(np.arange(len(lists), dtype=np.int16), self.n)
        order = np.argsort(self.inverse, kind="stable")
        self.row, self.heads = row[order], np.flatnonzero(np.diff(self.inverse[order], prepend=-1)).astype(np.int32)
        self.full = np.flatnonzero(self.n)
        self.starts = (np.cumsum(self.n) - self.n)[self.full]

    def forward(self, bias: float, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and for each row the sums of its terms' parameters."""
        each = p[self.inverse]
        sums, squares = np.zeros((len(self.n), p.shape[1]), np.float32), np.zeros(len(self.n), np.float32)
        if len(self.full):
            sums[self.full] = np.add.reduceat(each, self.starts)
            squares[self.full] = np.add.reduceat((each[:, 1:] ** 2).sum(axis=1), self.starts)
        return bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), sums

    def gradient(self, error: np.ndarray, sums: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of the weights and factors of the batch's terms."""
        with_one = np.concatenate([np.ones((len(sums), 1), np.float32), sums[:, 1:]], axis=1)
        g = np.add.reduceat((error[:, None] * with_one)[self.row], self.heads) if len(self.heads) else np.zeros_like(p)
        g[:, 1:] -= g[:, :1] * p[:, 1:]
        return g


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fitted(lists: list[np.ndarray], y: np.ndarray, size: int, factors: int, epochs: int, shrink: float) -> tuple[float, np.ndarray]:
    """Bias, and weight and factors of each of `size` terms, from the places of each row's terms.

    Adam with a proximal step: after each step a parameter moves towards zero by its share of the prior,
    in the step's own metric, and stays there unless its gradient outweighs the prior.
    """
    rng = np.random.default_rng(7)
    order, rows = rng.permutation(len(y)), np.zeros(size, np.int64)
    batches = [_Batch([lists[i] for i in order[at : at + BATCH]], y[order[at : at + BATCH]]) for at in range(0, len(y), BATCH)]
    for one in batches:
        rows[one.known] += 1
    bias = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    p = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, factors))], axis=1).astype(np.float32)
    first, second = np.zeros_like(p), np.zeros_like(p)
    epochs = max(epochs, -(-LEAST_STEPS // len(batches)))
    bias_first = bias_second = step = 0.0
    for _ in range(epochs):
        for n in rng.permutation(len(batches)):
            one = batches[n]
            own = p[one.known]
            z, sums = one.forward(bias, own)
            error = ((_sigmoid(z) - one.y) / len(one.y)).astype(np.float32)
            share = 1 / (len(one.y) * rows[one.known]).astype(np.float32)[:, None]
            g = one.gradient(error, sums, own) + 0.1 * own * share
            step += 1
            rate = RATE * (1 - step / (epochs * len(batches) + 1))
            m, v = first[one.known], second[one.known]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            first[one.known], second[one.known] = m, v
            metric = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            moved = own - metric * (m / (1 - 0.9**step))
            p[one.known] = np.sign(moved) * np.maximum(np.abs(moved) - metric * np.float32(shrink) * share, 0)
            total = float(error.sum())
            bias_first += 0.1 * (total - bias_first)
            bias_second += 0.01 * (total**2 - bias_second)
            bias -= rate * (bias_first / (1 - 0.9**step)) / (math.sqrt(bias_second / (1 - 0.99**step)) + 1e-8)
    return bias, p


def _learned_from(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> pa.Table:
    """(label, terms) of at most `most` labelled rows, in an order that is the same at every run."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = usable.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).distinct()
    # Two rows for an id at most, so at most twice `most` rows of two numbers: the size of the broadcast is bounded.
    ids = chosen.select("label_id").distinct().orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    sample = chosen.join(F.broadcast(ids), "label_id")
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("text_id") == F.col("label_id")).select(F.xxhash64("text_id", "text").alias("place"), "label", "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                row, slot = _terms(block.column(2))
                distinct = np.unique((row << SLOT_BITS) | slot)
                offsets = np.searchsorted(distinct >> SLOT_BITS, np.arange(block.num_rows + 1)).astype(np.int32)
                terms = pa.array((distinct & ((1 << SLOT_BITS) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.ListArray.from_arrays(pa.array(offsets), terms)], ["place", "label", "terms"])

    marked = rows.mapInArrow(mark, "place long, label int, terms array<int>")
    once = marked.groupBy("place", "label").agg(F.first("terms").alias("terms"))  # a text that stands in many rows is one before it travels
    return once.orderBy("place", "label").limit(most).select("label", "terms").toArrow()


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_train: int = MAX_TRAIN, factors: int = FACTORS, epochs: int = EPOCHS, shrink: float = SHRINK,
) -> Model:
    """Fit on labels joined to the texts of docs."""
    found = _learned_from(docs, labels, id_col, text_col, label_col, max_train)
    y = found.column("label").to_numpy().astype(np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    if prior in (0.0, 1.0):
        return Model(prior)
    column = found.column("terms").combine_chunks()
    flat, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    least = shrink * math.sqrt(len(y))
    slots = np.flatnonzero(np.bincount(flat, minlength=1 << SLOT_BITS) > least)
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    lists = [x[x >= 0] for x in np.split(place[flat], np.cumsum(sizes)[:-1])]
    del found, column, flat, place
    bias, p = _fitted(lists, y, len(slots), factors, epochs, least)
    del lists
    words.give_back()
    counts = np.flatnonzero(p.any(axis=1))
    uri = shared.folder(docs.sparkSession, "toxicity")
    shared.put(f"{uri}/slots", slots[counts].astype(np.int64))
    shared.put(f"{uri}/weights", p[counts])
    return Model(prior, bias, uri)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row of docs."""
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(scores(model, block.column(1)))], [id_col, "score"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[id_col].dataType.simpleString()}, score double")


def scores(model: Model, column) -> np.ndarray:
    """Score of each row of an Arrow text column."""
    n = len(column)
    if model.uri is None:
        return np.full(n, model.prior)
    slots, p = _arrays(model.uri)
    row, place = _found(*_terms(column), slots)
    z = model.bias + np.bincount(row, p[place, 0], n)
    for f in range(1, p.shape[1]):
        v = p[place, f]
        z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v**2, n))
    return _sigmoid(z)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [str(i) for i in range(batch.num_columns)])
            for block in words.blocks(named, str(place)):
                clean = pa.array(scores(model, block.column(place)) < threshold)
                kept = block.filter(clean)
                yield pa.RecordBatch.from_arrays(kept.columns, batch.schema.names)

    return docs.mapInArrow(run, schema)
