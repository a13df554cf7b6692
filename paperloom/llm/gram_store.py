"""Counts of n-grams inside tasks, and their sorted hash arrays with counts in the shared folder.

An n-gram is a column for each of its words' ids. Its hash begins with the leading bits of its context's
hash, so a context and all its n-grams are in one file. Files hold, for a file's n hashes, the last
REST_BITS bits of each and where each value of the bits before begins, about four hashes a value: a hash
is told from another by REST_BITS and as many leading bits as the number of hashes has, at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from paperloom.llm import packed, shared, words

REST_BITS = 32
_ODD = np.uint64(0xD6E8FEB86659FD93)


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of ids, one after the other."""
    h = np.zeros(len(columns[0]), np.uint64)
    for n, column in enumerate(columns):
        h = words.mix(h + column.astype(np.uint64) * _ODD + np.uint64(n + 1))
    return h


def of_context(columns: list[np.ndarray]) -> np.ndarray:
    return hashes(columns[:-1])


def under(context: np.ndarray, gram: np.ndarray, bits: int) -> np.ndarray:
    """The gram's hash with the context's leading bits."""
    return (context >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (gram >> np.uint64(bits))


class Counter:
    """Counts of n-grams by their hashes; `add` says when they are so many that they should be taken out."""

    def __init__(self, flush: int):
        self.parts, self.size, self.flush = [], 0, flush

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> bool:
        self.parts.append(merged(columns, np.ones(len(columns[0]), np.int64) if counts is None else counts))
        self.size += len(self.parts[-1][1])
        if self.size > self.flush and len(self.parts) > 1:
            self.parts = [self._whole()]
            self.size = len(self.parts[0][1])
        return self.size > self.flush * 2 // 3

    def _whole(self) -> tuple[list[np.ndarray], np.ndarray]:
        parts, self.parts = self.parts, []
        columns = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
        return merged(columns, np.concatenate([p[1] for p in parts]))

    def take(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        out, self.size = self._whole() if self.parts else None, 0
        return out


def merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and the sums of their counts."""
    h = hashes(columns)
    order = np.argsort(h)
    heads = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]])) if len(h) else np.empty(0, np.int64)
    return [c[order[heads]] for c in columns], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


def squeeze(arrays: list[np.ndarray]) -> bytes:
    """Arrays of non-negative numbers, their byte planes compressed together."""
    raw = b"".join(len(x).to_bytes(8, "little") + x for x in map(packed.narrow, arrays))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(packed.wide(raw[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def put_numbers(uri: str, name: str, values: np.ndarray) -> None:
    """Numbers in one byte each; those of 255 and more have their place and value in a second file."""
    large = np.flatnonzero(values >= 255)
    shared.put(f"{uri}/{name}", np.minimum(values, 255).astype(np.uint8))
    shared.put(f"{uri}/{name}-large", np.concatenate([large, values[large]]).astype(np.int64))


class Numbers:
    """The numbers that `put_numbers` wrote, mapped."""

    def __init__(self, uri: str, name: str):
        self.small, large = shared.mapped(f"{uri}/{name}", np.uint8), shared.mapped(f"{uri}/{name}-large", np.int64)
        self.at, self.values = np.split(large, 2)

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = self.small[places].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.values[np.searchsorted(self.at, places[large])]
        return out


def save(uri: str, bucket: int, bits: int, h: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    """Write one file of hashes, which begin with the bucket's number, and of a number for each in each column."""
    order = np.argsort(h)
    h, name = h[order] << np.uint64(bits), f"{bucket:06d}"
    index = max(1, (len(h) // 4).bit_length())
    slot = (h >> np.uint64(64 - index)).astype(np.int64)
    shared.put(f"{uri}/{name}-starts", np.searchsorted(slot, np.arange((1 << index) + 1)).astype(np.uint32))
    shared.put(f"{uri}/{name}-rest", (h << np.uint64(index) >> np.uint64(64 - REST_BITS)).astype(np.uint32))
    for column, values in columns.items():
        put_numbers(uri, f"{name}-{column}", values[order])


class Store:
    """The files of one kind of n-gram, mapped."""

    def __init__(self, uri: str, bits: int, columns: tuple[str, ...]):
        self.uri, self.bits, self.columns, self.files = uri, bits, columns, {}
        self.have = {x.rsplit("/", 1)[1] for x in shared.listed(uri)}

    def _file(self, bucket: int):
        name = f"{bucket:06d}"
        if bucket not in self.files:
            opened = None
            if f"{name}-starts" in self.have:
                opened = (shared.mapped(f"{self.uri}/{name}-starts", np.uint32), shared.mapped(f"{self.uri}/{name}-rest", np.uint32), [Numbers(self.uri, f"{name}-{c}") for c in self.columns])
            self.files[bucket] = opened
        return self.files[bucket]

    def find(self, h: np.ndarray) -> list[np.ndarray]:
        """Each column's number for each hash, 0 where it isn't held."""
        out = [np.zeros(len(h), np.int64) for _ in self.columns]
        order = np.argsort(h)
        bucket = (h[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b or (file := self._file(int(bucket[a]))) is None:
                continue
            starts, rest, numbers = file
            own = h[order[a:b]] << np.uint64(self.bits)
            index = len(starts).bit_length() - 1
            slot = (own >> np.uint64(64 - index)).astype(np.int64)
            low, high = starts[slot].astype(np.int64), starts[slot + 1].astype(np.int64)
            want = (own << np.uint64(index) >> np.uint64(64 - REST_BITS)).astype(np.uint32)
            live = np.flatnonzero(low < high)
            while len(live):  # a few steps: a slot has about four hashes
                held = rest[low[live]]
                hit = live[held == want[live]]
                for o, n in zip(out, numbers, strict=True):
                    o[order[a + hit]] = n[low[hit]]
                live = live[held < want[live]]
                low[live] += 1
                live = live[low[live] < high[live]]
        return out
