"""Vectorised splitting and hashing of Arrow text columns, for use inside tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses these bytes inside
a character. A word's hash is 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
BLOCK_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if ends is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch with about `limit` bytes of text each (one row at least)."""
    _, offsets = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


@lru_cache(1)
def _trim():
    """The C library's function that returns freed memory to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what a batch has used: workers live long and share a machine with the next stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (and the end)."""
    word = IS_WORD[data]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    inner = offsets[:-1][offsets[:-1] < len(word)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def _parts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges of more than eight bytes: (which range, offset of each further part, first part of each)."""
    count = (size - 1) >> 3
    first = np.cumsum(count) - count
    which = np.repeat(np.arange(len(size)), count)
    return which, 8 * (np.arange(len(which)) - first[which] + 1), first


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges.

    Eight bytes at a time are mixed with their place before they are added, so that no pattern of
    letters makes the sums of different words equal, as it does with polynomials modulo 2**64.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    eights, size = _eights(data), ends - starts
    h = mix((eights[starts] & _LOW[np.minimum(size, 8)]) + _STEP)
    longer = np.flatnonzero(size > 8)
    if len(longer):
        which, at, first = _parts(size[longer])
        part = eights[starts[longer][which] + at] & _LOW[np.minimum(size[longer][which] - at, 8)]
        h[longer] += np.add.reduceat(mix(part + _STEP * (at >> 3).astype(np.uint64) + _LONG), first)
    return mix(h + size.astype(np.uint64) * _LONG)


def same(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each byte range of a is, byte for byte, the one of b beside it."""
    if not len(a_starts):
        return np.empty(0, bool)
    size, x, y = a_ends - a_starts, _eights(a), _eights(b)
    low = _LOW[np.minimum(size, 8)]
    equal = (size == b_ends - b_starts) & ((x[a_starts] & low) == (y[b_starts] & low))
    longer = np.flatnonzero(equal & (size > 8))
    if len(longer):
        which, at, first = _parts(size[longer])
        low = _LOW[np.minimum(size[longer][which] - at, 8)]
        part = (x[a_starts[longer][which] + at] & low) == (y[b_starts[longer][which] + at] & low)
        equal[longer] = np.logical_and.reduceat(part, first)
    return equal


@lru_cache(8)
def _multipliers(k: int) -> list[int]:
    """An odd number for each place of k words, the same on every machine."""
    return [int(x) | 1 for x in np.random.default_rng(20240229).integers(1, 1 << 62, k, dtype=np.uint64)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words at each start; starts near a row's end cross into the next row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(_multipliers(k)):
        out += h[j : j + n] * np.uint64(m)
    return mix(out)


def hash_text(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the end, word starts, word ends, bytes)."""
    data, offsets = buffers(column)
    cased = LOWER[data] if lower else data
    starts, ends, first = spans(data, offsets)
    return hashes(cased, starts, ends), first, starts, ends, data
