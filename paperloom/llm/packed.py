"""Counts of 64-bit keys inside tasks, and sorted number lists packed to travel in few bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FLUSH = 3_000_000


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts[:0]


class Counter:
    """Counts of keys; `add` says when they are so many that they should be taken out."""

    def __init__(self, flush: int = FLUSH):
        self.keys, self.counts, self.size, self.flush = [], [], 0, flush

    def add(self, keys: np.ndarray) -> bool:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.flush and len(self.keys) > 1:
            keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.size > self.flush * 2 // 3

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.int64)
        counts = np.concatenate(self.counts) if self.keys else np.empty(0, np.int64)
        self.keys, self.counts, self.size = [], [], 0
        return merged(keys, counts)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[pa.Array]]]]:
    """Rows of each key of the first column, from batches sorted by it."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if start == stop:
                continue
            if now is not None and keys[start] != now:
                yield int(now), held
                held = []
            now = keys[start]
            held.append([c.slice(start, stop - start) for c in batch.columns])
    if now is not None:
        yield int(now), held


def narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in as many byte planes as the largest needs; the first byte says how many."""
    most = int(values.max()) if len(values) else 0
    planes = max(1, (most.bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([planes]) + np.ascontiguousarray(raw[:, :planes].T).tobytes()


def wide(data: bytes) -> np.ndarray:
    planes = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    raw = np.zeros((body.shape[1], 8), np.uint8)
    raw[:, :planes] = body.T
    return raw.view("<i8").ravel()


def buckets(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in their order) for each bucket that has keys."""
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1, [len(ranked)]])
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        if stop > start:
            yield int(ranked[start]), order[start:stop]
