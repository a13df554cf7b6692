"""Near duplicates by SimHash fingerprints: pigeonhole blocks, joined on blocks, verified by Hamming distance.

1. Each text's shingles (repeats included) are hashed with XXH64; a fingerprint bit is one if more than half
   of the hashes have it. Only fingerprints leave the tasks that read the texts, and equal ones are one row
   from then on, however many documents have them.
2. The 64 bits are cut into blocks. Fingerprints that differ in at most `distance` bits differ in at most as
   many blocks, so they are equal in all others: each fingerprint is put under every choice of blocks that may
   differ (4 blocks and a distance of 2: six tables with keys of 32 bits) and meets those with its key.
3. Inside a key all pairs are verified by their Hamming distance. A key of more than `CHECKED` fingerprints
   isn't: its fingerprints go on to twice as many blocks, where keys are longer. In the last round at most
   eight bits are not in the key, so no key can have more than 256 fingerprints. Nothing is dropped, and
   no fingerprint is compared with more than `CHECKED` others for a table.
4. Tasks send links that join what is joined in them, not every pair; links give components.

Defined results: null text is empty; a text without words has fingerprint zero, which is linked like any
other; with fewer words than a shingle has, the whole sequence is one; repeated rows have equal fingerprints;
a component is named by its smallest id, null only if all its ids are null; very long texts are used whole;
extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import hot, shared, words
from paperloom.llm.components import components, least_labels

CHECKED = 256
LAST_BITS = 8
VOTES = 1 << 15
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()  # eight counters of eight bits

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(state + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range of data, all ranges a step at a time."""
    eights, size = words._eights(data), ends - starts
    seeds = np.array([seed], np.uint64)
    h = np.repeat(seeds + _P5, len(size))
    long = np.flatnonzero(size >= 32)
    if len(long):
        state = [np.repeat(x, len(long)) for x in (seeds + _P1 + _P2, seeds + _P2, seeds, seeds - _P1)]
        stripes = size[long] >> 5
        for s in range(int(stripes.max())):
            on = np.flatnonzero(stripes > s)
            for j in range(4):
                state[j][on] = _round(state[j][on], eights[starts[long[on]] + 32 * s + 8 * j])
        whole = _turned(state[0], 1) + _turned(state[1], 7) + _turned(state[2], 12) + _turned(state[3], 18)
        for v in state:
            whole = (whole ^ _round(np.zeros_like(v), v)) * _P1 + _P4
        h[long] = whole
    h += size.astype(np.uint64)
    at, left = starts + (size & ~31), size & 31
    for step in range(3):
        on = np.flatnonzero(left >= 8 * (step + 1))
        if len(on):
            h[on] = _turned(h[on] ^ _round(np.zeros(len(on), np.uint64), eights[at[on] + 8 * step]), 27) * _P1 + _P4
    at, left = at + (left & ~7), left & 7
    on = np.flatnonzero(left >= 4)
    h[on] = _turned(h[on] ^ ((eights[at[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at, left = at + (left & 4), left & 3
    for step in range(3):
        on = np.flatnonzero(left > step)
        h[on] = _turned(h[on] ^ ((eights[at[on] + step] & np.uint64(0xFF)) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def fingerprints(column: pa.Array, k: int) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    data, offsets = words.buffers(column)
    starts, ends, first = words.spans(data, offsets)
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    plain = np.full(int(at[-1] + size[-1] + 1) if len(at) else 0, 0x20, np.uint8)  # the words with one space between
    inside = np.ones(len(plain), bool)
    inside[at + size] = False
    plain[inside] = words.LOWER[data[words.IS_WORD[data]]]

    n_words = np.diff(first)
    count = np.where(n_words >= k, n_words - k + 1, n_words > 0)
    row = np.repeat(np.arange(len(count)), count)
    head = first[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    last = np.minimum(head + k, first[1:][row]) - 1
    votes = np.zeros((len(count), 64), np.int64)
    for start in range(0, len(row), VOTES):
        part = slice(start, start + VOTES)
        h = xxh64(plain, at[head[part]], at[last[part]] + size[last[part]]).astype("<u8")
        edges = np.union1d(np.flatnonzero(np.diff(row[part], prepend=-1)), np.arange(0, len(h), 255))
        sums = np.add.reduceat(_LANES[h.view(np.uint8)].reshape(-1, 8), edges, axis=0).view(np.uint8)
        own = row[part][edges]  # a row has several sums if it has more than 255 hashes
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        votes[own[heads]] += np.add.reduceat(sums, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprinted(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, "text"):
                found = fingerprints(block.column(1), k).view(np.int64)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found)], ["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def rounds(distance: int) -> list[int]:
    """Numbers of blocks: twice as many each time, until so few bits are outside a key that it can't be crowded."""
    out = [distance + 2]
    while -(-64 // out[-1]) * distance > LAST_BITS and out[-1] < 64:
        out.append(min(64, 2 * out[-1]))
    return out


def masks(blocks: int, distance: int) -> list[int]:
    """The bits of a key for each choice of the blocks that may differ, as signed numbers."""
    edges = [64 * n // blocks for n in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    kept = (~sum(free) & words.MASK for free in combinations(parts, distance))
    return [x - (1 << 64) if x >> 63 else x for x in kept]


def near(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is joined with, by pairs inside a group (groups stand together)."""
    u, v, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
    while len(on := np.flatnonzero(group[step:] == group[:-step])):
        on = on[np.bitwise_count((fp[on] ^ fp[on + step]).view(np.uint64)) <= distance]
        u.append(fp[on])
        v.append(fp[on + step])
        step += 1
    return least_labels(np.concatenate(u), np.concatenate(v))


def _verified(keyed: DataFrame, distance: int) -> DataFrame:
    """(u, v): links that join what the pairs of each key (mask, value) join; no key is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray):
            if rows.shape[1] > 1:
                change = np.concatenate([[False], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])
                nodes, label = near(np.cumsum(change), rows[2], distance)
                apart = nodes != label
                if apart.any():
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(label[apart])], ["u", "v"])

        held = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if rows.shape[1]:
                last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
                held = rows[:, last]
                yield from links(rows[:, ~last])
        yield from links(held)

    met = keyed.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return shared.written(met.mapInArrow(run, "u long, v long"), "near-fingerprints")


def _links(prints: DataFrame, distance: int) -> DataFrame:
    """Links between different fingerprints (fp), enough to join whatever is joined."""
    found, now = None, prints
    for blocks in rounds(distance):
        mask = F.explode(F.array(*map(F.lit, masks(blocks, distance))))
        keyed = now.select("fp", mask.alias("mask")).select("mask", F.expr("fp & mask").alias("value"), "fp")
        crowded = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CHECKED)
        crowded = shared.written(crowded, "crowded-keys")
        full = not crowded.isEmpty()
        new = _verified(hot.met(keyed, crowded, ["mask", "value"], "left_anti") if full else keyed, distance)
        found = new if found is None else found.union(new)
        if not full:
            break
        now = shared.written(hot.met(keyed, crowded, ["mask", "value"], "left_semi").select("fp").distinct(), "crowded")
    return found


def link(docs: DataFrame, k: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, component_id of every row of docs."""
    rows = _fingerprinted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k)
    rows = shared.written(rows, "fingerprints")
    prints = shared.written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    joined = components(_links(prints.select("fp"), distance)).select(F.col("node").alias("fp"), "label")
    labelled = prints.join(joined, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = shared.written(labelled, "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = hot.met(labelled.select("label", "fp", F.col("rows").alias("copies")), least, "label")
    named = named.select("fp", "component_id", F.col("copies").alias("rows"))
    return hot.met(rows, named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
