"""PCA whitening from an exact scatter: modular products over several primes, put together by Chinese remaindering.

1. Entries become whole numbers x = floor(scale * c) + shift. The fit list has each distinct vector once: rows
   whose hash surely stands alone (a bitmap of fixed size says so) are in it as they are, only the others are
   shuffled to be made distinct, a common vector as one row of each task.
2. Each task multiplies its part of the fit list, a column of ones before it, with itself modulo each of a few
   primes. Residues are centred and of 21 bits, so `ROWS` rows at a time are exact in double precision. A task
   sends residues of sums, (d + 1)**2 numbers for each prime, however many rows it read, and tasks add
   them up by row of the matrix.
3. The driver gets one sum of each entry and prime, and remainders give the exact count, sums and products:
   there are enough primes for n * max(x)**2. The covariance (n * P - S * S') / n**2 is rounded once, so a mean
   that is large beside the deviations costs no digits. Its eigenvectors are found in double precision.
4. Rows are projected in tasks: n * x - S is exact, and only then divided and multiplied.

The identity error is measured, not assumed: a pass over the fit list sums the whitened rows and their
products, and the covariance of these, centred, is set against the identity.

Defined results: vectors that are null, empty, hold null or non-finite entries or entries whose x is beyond 62
bits take no part; repeated rows and rows without an id have rows of their own; vectors of another length are
fitted and whitened among themselves; a component without variance (its eigenvalue is not above what rounding
gives) can't be whitened and is left out, so one distinct vector gives no rows; a deviation beyond a long is
null; a component's sign is that of its largest entry; extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, packed, shared

COMPONENTS = 16
ROWS = 4096
PRIME_BITS = 21
LIMIT = 1 << 62
MAX_LENGTH = 1 << 20


def primes(bound: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS, so many that their product is above 2 * bound."""
    out, product, now = [], 1, 1 << PRIME_BITS
    while product <= 2 * bound:
        now -= 1
        if all(now % q for q in range(2, int(now**0.5) + 1)):
            out.append(now)
            product *= now
    return out


def reconstructed(residues: list[int], moduli: list[int]) -> int:
    """The whole number of least magnitude with these remainders."""
    whole = 1
    for p in moduli:
        whole *= p
    total = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return total - whole if 2 * total > whole else total


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, whole numbers) of the vectors of each length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, values[starts[rows][:, None] + np.arange(d)]


def _vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """id, x, again (whether another row may have the same x) of the rows that take part; written once."""
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    held = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < F.lit(float(LIMIT))))
    known = rows.where((F.size(vector_col) > 0) & held)
    whole = F.transform(vector_col, lambda c: F.floor(scaled(c)) + F.lit(shift).cast("long"))
    narrow = known.select(F.col(id_col).alias("id"), whole.alias("x"))
    many = narrow.groupBy(F.xxhash64("x").alias("hash")).count().where("count > 1")
    bits = exact_dedup.FILTER_BITS
    again = exact_dedup._hit(exact_dedup._bitmap(many, F.col("hash"), bits), F.xxhash64("x"), bits)
    return shared.written(narrow.withColumn("again", again), "whole-vectors")


def _scatter(fit: DataFrame, moduli: dict[int, list[int]]) -> dict[int, list[list[int]]]:
    """For each length the exact products of (1, x) with itself, summed over the fit list."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for d, _, m in _matrices(batch.column(0)):
                total = sums.setdefault(d, np.zeros((len(moduli[d]), d + 1, d + 1), np.int64))
                for start in range(0, len(m), ROWS):
                    part = m[start : start + ROWS]
                    for k, p in enumerate(moduli[d]):
                        r = part % p
                        r = np.concatenate([np.ones((len(r), 1)), r - p * (2 * r > p)], axis=1, dtype=np.float64)
                        total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        for d, total in sums.items():
            for k in range(len(total)):
                keys = ((d * 64 + k) * MAX_LENGTH) + np.arange(d + 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.tobytes() for x in total[k]], pa.binary())], ["key", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in packed.by_key(batches):
            p, total = moduli[key // MAX_LENGTH // 64][key // MAX_LENGTH % 64], 0
            for part in parts:
                for data in part[1].to_pylist():
                    total = (total + np.frombuffer(data, np.int64)) % p
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["key", "sums"])

    sent = fit.select("x").mapInArrow(multiply, "key long, sums binary")
    met = sent.repartition("key").sortWithinPartitions("key").mapInArrow(add, "key long, sums binary")
    found = {row.key: np.frombuffer(row.sums, np.int64).tolist() for row in met.collect()}  # (d + 1)**2 for each prime
    out = {}
    for d, some in moduli.items():
        sums = [[found[(d * 64 + k) * MAX_LENGTH + i] for i in range(d + 1)] for k in range(len(some))]
        out[d] = [[reconstructed([s[i][j] for s in sums], some) for j in range(d + 1)] for i in range(d + 1)]
    return out


class Model:
    """Count, sums and scaled components of the vectors of one length."""

    def __init__(self, products: list[list[int]], components: int):
        self.n, self.sums = products[0][0], products[0][1:]
        n, s = self.n, self.sums
        v = np.array([[(n * products[i + 1][j + 1] - s[i] * s[j]) / (n * n) for j in range(len(s))] for i in range(len(s))])
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = np.flatnonzero(values > len(s) * np.finfo(float).eps * max(values[0], 0))[:components]
        self.values, vectors = values[kept], vectors[:, kept]
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))] if len(kept) else np.empty(0)
        self.scaled = vectors * np.where(largest < 0, -1.0, 1.0) / np.sqrt(self.values)
        self.explained = self.values / np.trace(v) if len(kept) else self.values
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs where they hold it, else in Python's whole numbers."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if top < LIMIT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(np.float64) @ self.scaled

    def deviations(self, y: np.ndarray) -> list[int | None]:
        if y.dtype != object and (y.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < LIMIT:
            return (y * y).sum(axis=1).tolist()
        whole = [sum(int(v) ** 2 for v in row) for row in y]
        return [v if v < 1 << 63 else None for v in whole]


def _measured(fit: DataFrame, models: dict[int, Model]) -> None:
    """Set each model's identity error from the whitened fit list."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for d, _, m in _matrices(batch.column(0)):
                w = models[d].whitened(models[d].centred(m))
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                sums[d] = sums.get(d, 0) + w.T @ w
        for d, total in sums.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), pa.array(flat)], ["d", "place", "sum"])

    found = fit.select("x").mapInArrow(multiply, "d long, place long, sum double").groupBy("d", "place").agg(F.sum("sum").alias("sum")).collect()
    for d, model in models.items():
        flat = np.array([r.sum for r in sorted((r for r in found if r.d == d), key=lambda r: r.place)])
        m = flat.reshape(len(model.values) + 1, -1) / model.n
        cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
        model.identity_error = float(np.abs(cov - np.eye(len(cov))).max(initial=0))


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
    shift: int = 1_000_000,
) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    whole = _vectors(rows, id_col, vector_col, scale, shift)
    fit = whole.where(~F.col("again")).select("x").union(whole.where("again").select("x").distinct())
    fit = shared.written(fit, "fit-list")
    largest = F.greatest(F.array_max("x"), -F.array_min("x"))
    shapes = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("top")).collect()
    models = {}
    if shapes:  # a row for each length that vectors have
        found = _scatter(fit, {r.d: primes(r.n * max(r.top, 1) ** 2) for r in shapes})
        models = {d: Model(products, components) for d, products in found.items()}
        _measured(fit, models)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, places, m in _matrices(batch.column(1)):
                model, k = models[d], len(models[d].values)
                y = model.centred(m)
                arrays = [
                    batch.column(0).take(pa.array(np.repeat(places, k))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(m)),
                    np.full(len(m) * k, model.n), pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k))),
                    model.whitened(y).ravel(), np.tile(model.explained, len(m)), np.full(len(m) * k, model.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return whole.select("id", "x").mapInArrow(project, schema)
