"""Exact removal of repeated passages: FM-indexes over shards of the passages that may repeat.

A passage is a window of `window` consecutive words. A word is removed if a window that covers it stands
earlier too: in a document of smaller id, or earlier in the same document.

1. Each window has an anchor, the smallest hash of its `anchor` word runs, which equal windows share.
   All anchors are counted over all texts; a window whose anchor occurs once can't repeat.
2. Of equal windows in one block of text only the first is sent on, in stretches, to the shard of its
   anchor. A very frequent anchor has as many shards as its count asks for, dealt out by document.
3. Each shard indexes its stretches, a word being a symbol, and streams them through backward search.
   Matching statistics of `window` words are repeats; equal windows have one interval, and all but the
   first document's are removed. What a frequent anchor's shards leave, at most one document's windows
   from each, goes to the shards of the windows' own hashes and is judged there once more, so no shard
   gathers what the whole corpus shares.
4. Removed stretches are gathered by document and applied to its whole text. Texts that surely lose
   nothing (a bitmap of fixed size tells) are not shuffled.

Defined results: null text has no words; texts shorter than a window lose nothing; rows that repeat an id
are judged each for itself (rows of one id don't remove each other's words), rows that repeat id and
text alike; a null id counts as greater than all ids; very long texts are used whole; extra columns are
ignored by `repeated_spans`, kept by `remove_repeats`; empty input gives no rows. Windows are equal if
all their words are, which are compared by 40 bits of their hashes (by 64 in one block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import packed, shared, sorted_store, words
from paperloom.llm.columns import free
from paperloom.llm.exact_dedup import FILTER_BITS, _bitmap, _hit
from paperloom.llm.fm_index import FMIndex

WINDOW, ANCHOR = 20, 10
ANCHOR_BITS = 48
WORD_BITS = 40
FREQUENT = 4096
SHARD_BITS = 2  # shards are four times as many as stores have files: a task indexes one small shard after the other
LAST_ID = (1 << 63) - 1
COUNT = (("count", np.uint32),)


def _least(g: np.ndarray, span: int) -> np.ndarray:
    """Place of the first smallest of the span values from each place on."""
    n = len(g) - span + 1
    place, width = np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        right = place[step:]
        left = place[: len(right)]
        place = np.where(g[right] < g[left], right, left)
        width += step
    return place[:n]


def _windows(column, window: int, anchor: int):
    """(word hashes, first words of rows, starts of whole windows, places of their anchors, anchor hashes)."""
    h, first, _, _, _ = words.hash_text(column, lower=False)
    g = words.grams(h, anchor)
    if len(h) < window:
        empty = np.empty(0, np.int64)
        return h, first, empty, empty, g
    place = _least(g, window - anchor + 1)
    inside = np.zeros(len(place) + 1, np.int64)
    counts = np.maximum(0, np.diff(first) - window + 1)
    begin = first[:-1][counts > 0]
    inside[begin] += 1
    np.add.at(inside, begin + counts[counts > 0], -1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    return h, first, starts, place[starts], g


def _count_anchors(texts: DataFrame, window: int, anchor: int, target: str, bits: int) -> None:
    """Write the store of cut anchor hashes that occur twice or more."""
    cut = np.uint64(64 - ANCHOR_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = packed.Counter()

        def out():
            keys, n = held.take()
            keys = keys.view(np.uint64)
            for b, at in packed.buckets(keys, sorted_store.bucket_of(keys << cut, bits)):
                arrays = [pa.array([b], pa.int32()), pa.array([packed.narrow(np.diff(keys[at].view(np.int64), prepend=0))], pa.binary()), pa.array([packed.narrow(n[at])], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "keys", "n"])

        for batch in batches:
            for block in words.blocks(batch, "text"):
                _, _, _, place, g = _windows(block.column(0), window, anchor)
                if len(place) and held.add(g[np.unique(place)] >> cut):
                    yield from out()
        yield from out()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in packed.by_key(batches):
            keys = np.concatenate([np.cumsum(packed.wide(x)) for p in parts for x in p[1].to_pylist()])
            n = np.concatenate([packed.wide(x) for p in parts for x in p[2].to_pylist()])
            keys, n = packed.merged(keys, n)
            often = n > 1
            sorted_store.save(target, "hash", bucket, keys[often].view(np.uint64) << cut)
            sorted_store.save(target, "count", bucket, np.minimum(n[often], 2**32 - 1).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([int(often.sum())])], ["n"])

    sent = texts.mapInArrow(count, "bucket int, keys binary, n binary").repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    sent.mapInArrow(put, "n long").agg(F.sum("n")).collect()


def _later(group: np.ndarray, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows of equal group stand later: not in the smallest id, or not first in their document."""
    order = np.lexsort((starts, tags, ids, group))
    g, i, t, s = group[order], ids[order], tags[order], starts[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_doc = new_group | np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])

    def first(values: np.ndarray, new: np.ndarray) -> np.ndarray:
        heads = np.flatnonzero(new)
        return np.repeat(values[heads], np.diff(np.append(heads, len(values))))

    out = np.empty(len(group), bool)
    out[order] = (s > first(s, new_doc)) | (i != first(i, new_group))
    return out


def _runs(which: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of consecutive numbers in `which` with equal keys."""
    if not len(which):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.diff(which) != 1
    for k in keys:
        breaks |= k[1:] != k[:-1]
    cuts = np.flatnonzero(breaks) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(which)]]) - 1


def _repeated(own: np.ndarray, h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Names of windows by their hashes `own`; a window with a hash of other words than the first one's has a name of its own."""
    _, first, name = np.unique(own, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[name] != np.arange(len(own)))
    x, y = starts[again], starts[first[name[again]]]
    other = np.zeros(len(again), bool)
    for j in range(window):
        other |= h[x + j] != h[y + j]
    name[again[other]] = len(first) + np.arange(other.sum())
    return name


def _send(docs: DataFrame, window: int, anchor: int, store_uri: str, bits: int, shard_bits: int, frequent: int) -> DataFrame:
    """Stretches of windows that may repeat, by shard. kind 1: already known to be later ones; 2: of a frequent anchor."""
    cut = np.uint64(64 - ANCHOR_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = sorted_store.opened(store_uri, bits, COUNT)
        for batch in batches:
            for block in words.blocks(batch, "text"):
                ids = block.column(0).fill_null(LAST_ID).to_numpy()
                tags = block.column(1).to_numpy()
                h, first, starts, place, g = _windows(block.column(2), window, anchor)
                if not len(starts):
                    continue
                distinct, inverse = np.unique(g[place] >> cut << cut, return_inverse=True)
                count = store.find(distinct, "count")[1][inverse].astype(np.int64)
                may = count > 1
                starts, place, count = starts[may], place[may], count[may]
                if not len(starts):
                    continue
                row = np.searchsorted(first, starts, "right") - 1
                later = _later(_repeated(words.grams(h, window)[starts], h, starts, window), ids[row], tags[row], starts)
                known = starts[later], row[later]
                a, b = _runs(*known)
                yield from _batches(1, sorted_store.bucket_of(words.mix(tags[known[1][a]].view(np.uint64)), shard_bits), ids[known[1][a]], tags[known[1][a]], known[0][a] - first[known[1][a]], known[0][b] - known[0][a] + 1, None)
                starts, row, place, count = (x[~later] for x in (starts, row, place, count))
                a, b = _runs(starts, place, row)
                parts = -(-count[a] // frequent)
                salt = (words.mix(tags[row[a]].view(np.uint64)) % parts.astype(np.uint64)) + np.uint64(1)
                route = words.mix(g[place[a]] * salt)
                length = starts[b] - starts[a] + window
                for kind, which in ((0, np.flatnonzero(parts == 1)), (2, np.flatnonzero(parts > 1))):
                    if len(which):
                        s, n = starts[a[which]], length[which]
                        offsets = np.cumsum(n) - n
                        at = np.repeat(s - offsets, n) + np.arange(n.sum())
                        r = row[a[which]]
                        yield from _batches(kind, sorted_store.bucket_of(route[which], shard_bits), ids[r], tags[r], s - first[r], n, h[at] >> np.uint64(64 - WORD_BITS))

    return docs.mapInArrow(run, "shard int, kind int, ids binary, tags binary, starts binary, lengths binary, words binary")


def _batches(kind: int, shard, ids, tags, starts, lengths, hashed) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its stretches in packed lists."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    for b, at in packed.buckets(shard, shard):
        body = b"" if hashed is None else packed.narrow(hashed[np.repeat(offsets[at] - np.concatenate([[0], np.cumsum(lengths[at])[:-1]]), lengths[at]) + np.arange(lengths[at].sum())])
        values = [ids[at].astype("<i8").tobytes(), tags[at].astype("<i8").tobytes(), packed.narrow(starts[at]), packed.narrow(lengths[at]), body]
        arrays = [pa.array([b], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
        yield pa.RecordBatch.from_arrays(arrays, ["shard", "kind", "ids", "tags", "starts", "lengths", "words"])


JUDGED = "id long, tag long, start long, length long, shard int, words binary"


def _judge(sent: DataFrame, window: int, shard_bits: int) -> DataFrame:
    """(id, tag, start, length) of stretches of windows to remove, from rows sorted by shard; with a shard
    and words: single windows of kind 2 that are the first in this shard and are judged again in that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in packed.by_key(batches):
            held, known = [], []
            for p in parts:
                for kind, *blobs in zip(*(c.to_pylist() for c in p[1:]), strict=True):
                    row = [np.frombuffer(blobs[0], "<i8"), np.frombuffer(blobs[1], "<i8"), packed.wide(blobs[2]), packed.wide(blobs[3])]
                    if kind == 1:
                        known.append(row)
                    else:
                        held.append([*row, packed.wide(blobs[4]), np.full(len(row[0]), kind == 2)])
            for one in known:
                yield _result(*one)
            if not held:
                continue
            ids, tags, starts, lengths, body, again = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            begin = np.cumsum(lengths) - lengths
            index = FMIndex(body, np.repeat(begin + lengths - 1, lengths), window)
            count = lengths - window + 1
            stretch = np.repeat(np.arange(len(lengths)), count)
            inner = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
            at = begin[stretch] + inner
            _, one, which = np.unique(index.string[at], return_index=True, return_inverse=True)
            matched, interval = (x[which] for x in index.matching(at[one]))  # each different window is searched once
            found = np.flatnonzero(matched == window)
            s, start = stretch[found], starts[stretch[found]] + inner[found]
            late = np.zeros(len(stretch), bool)
            if len(found):
                late[found] = _later(interval[found], ids[s], tags[s], start)
                found = found[late[found]]
                s, start = stretch[found], starts[stretch[found]] + inner[found]
                a, b = _runs(found, s)
                yield _result(ids[s[a]], tags[s[a]], start[a], start[b] - start[a] + 1)
            left = np.flatnonzero(again[stretch] & ~late)
            if len(left):
                own = sorted_store.bucket_of(words.grams(body.view(np.uint64), window)[at[left]], shard_bits)
                s = stretch[left]
                texts = body[at[left][:, None] + np.arange(window)]
                arrays = [ids[s], tags[s], starts[s] + inner[left], np.full(len(left), window)]
                rows = [pa.array(x.astype(np.int64)) for x in arrays] + [pa.array(own, pa.int32()), pa.array([packed.narrow(x) for x in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["id", "tag", "start", "length", "shard", "words"])

    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, JUDGED)


def _again(left: DataFrame) -> DataFrame:
    """Single windows as rows that can be judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[np.array([v], "<i8").tobytes() for v in batch.column(c).to_pylist()] for c in (0, 1)]
            numbers = [[packed.narrow(np.array([v])) for v in batch.column(c).to_pylist()] for c in (2, 3)]
            arrays = [batch.column(4), pa.array([0] * batch.num_rows, pa.int32()), *(pa.array(x, pa.binary()) for x in (*lists, *numbers)), batch.column(5)]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "kind", "ids", "tags", "starts", "lengths", "words"])

    return left.select("id", "tag", "start", "length", "shard", "words").mapInArrow(run, "shard int, kind int, ids binary, tags binary, starts binary, lengths binary, words binary")


def _result(ids, tags, starts, lengths) -> pa.RecordBatch:
    none = [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, tags, starts, lengths)] + none, ["id", "tag", "start", "length", "shard", "words"])


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT
) -> DataFrame:
    """(id, tag, spans): for each document with repeats, (first word, word after the last) of its stretches.

    tag tells texts of one id apart: xxhash64 of the text.
    """
    if not 0 < anchor <= window:
        raise ValueError(f"an anchor has 1 to {window} words, not {anchor}")
    spark = docs.sparkSession
    tagged = _tagged(docs, id_col, text_col)
    store, bits = shared.folder(spark, "anchors"), sorted_store.bits_for(docs)
    _count_anchors(tagged.select("text"), window, anchor, store, bits)
    sent = _send(tagged, window, anchor, store, bits, bits + SHARD_BITS, frequent)
    judged = shared.written(_judge(sent, window, bits + SHARD_BITS), "judged")
    found, left = judged.where("shard is null"), judged.where("shard is not null")
    if not left.isEmpty():
        found = found.union(_judge(_again(left), window, bits + SHARD_BITS).where("shard is null"))
    pair = F.struct(F.col("start"), (F.col("start") + F.col("length") + (window - 1)).alias("end"))
    return found.groupBy("id", "tag").agg(F.sort_array(F.collect_list(pair)).alias("spans"))


def _applied(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with a further column of spans, and that column's name. Only texts that may have spans are shuffled."""
    key, tag, name = free(docs, "_id", "_tag", "_spans")
    named = shared.written(spans.select(F.col("id").alias(key), F.col("tag").alias(tag), F.col("spans").alias(name)), "repeated-spans")
    own_id, own_tag = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    may = _hit(_bitmap(named, F.xxhash64(key, tag), FILTER_BITS), F.xxhash64(own_id, own_tag), FILTER_BITS)
    whole = docs.where(~may).withColumn(name, F.lit(None).cast(named.schema[name].dataType))
    met = docs.where(may).join(named, (own_id == named[key]) & (own_tag == named[tag]), "left").drop(key, tag)
    return whole.unionByName(met), name


def kept_words(text: str | None, spans) -> tuple[list[bytes], int]:
    """(words that stay, number removed)."""
    own = (text or "").encode().split()
    if not spans:
        return own, 0
    gone = np.zeros(len(own) + 1, np.int64)
    for one in spans:
        gone[one["start"]] += 1
        gone[one["end"]] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    return [own[i] for i in np.flatnonzero(stays)], int(len(own) - stays.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated passages removed; a text that loses words has its others joined by one space."""

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([x if s is None or not len(s) else b" ".join(kept_words(x, s)[0]).decode() for x, s in zip(text, spans, strict=True)], dtype=object)

    joined, name = _applied(docs, repeated_spans(docs, id_col, text_col, window), id_col, text_col)
    return joined.withColumn(text_col, cut(F.col(text_col), F.col(name))).select(docs.columns)


def digests(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row of docs."""
    joined, name = _applied(docs.select(id_col, text_col), spans, id_col, text_col)
    joined = joined.select(id_col, text_col, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, ["id", "text", "spans"])
            for block in words.blocks(named, "text"):
                out = []
                for text, spans in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                    kept, gone = kept_words(text, spans)
                    out.append((len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
                n, gone, digest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    kind = joined.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")
