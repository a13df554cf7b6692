"""Sorted 64-bit hashes in the shared folder, one file for each range of the leading bits, mapped by workers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from paperloom.llm import shared


FILE_BYTES = 64 << 20


def bits_for(docs: DataFrame) -> int:
    """Leading bits for as many files as the session has shuffle partitions, or as the input has FILE_BYTES.

    Spark knows the size of inputs that are files; of others it says that they are beyond all bounds.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES if size < 1 << 55 else 0)
    return max(1, (asked - 1).bit_length())


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def save(uri: str, name: str, bucket: int, values: np.ndarray) -> None:
    shared.put(f"{uri}/{name}-{bucket:06d}", values)


class Store:
    """Sorted hashes over all files; a hash's position in the whole is its id."""

    def __init__(self, uri: str, bits: int, columns: dict[str, type]):
        have, self.bits = {x.rsplit("/", 1)[1] for x in shared.listed(uri)}, bits

        def column(name: str, kind) -> list[np.ndarray]:
            return [shared.mapped(f"{uri}/{x}", kind) if (x := f"{name}-{b:06d}") in have else np.empty(0, kind) for b in range(1 << bits)]

        self.hashes = column("hash", np.uint64)
        self.columns = {name: column(name, kind) for name, kind in columns.items()}
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.hashes])])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def find(self, h: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """For sorted hashes: id (-1 where absent) and the named columns (0 where absent)."""
        ids = np.full(len(h), -1, np.int64)
        out = [np.zeros(len(h), self.columns[n][0].dtype) for n in names]
        edges = np.searchsorted(h, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        edges = np.concatenate([[0], edges, [len(h)]])
        for b in np.flatnonzero(np.diff(edges)):
            held = self.hashes[b]
            if not len(held):
                continue
            part = h[edges[b] : edges[b + 1]]
            slot = np.minimum(np.searchsorted(held, part), len(held) - 1)
            hit = held[slot] == part
            where = edges[b] + np.flatnonzero(hit)
            ids[where] = self.starts[b] + slot[hit]
            for o, n in zip(out, names, strict=True):
                o[where] = self.columns[n][b][slot[hit]]
        return ids, *out


@lru_cache(8)
def opened(uri: str, bits: int, columns: tuple[tuple[str, type], ...]) -> Store:
    """A store, mapped once in each worker."""
    return Store(uri, bits, dict(columns))
