"""An interpolated modified Kneser-Ney n-gram model of any order from 2 on, counted in Spark and mapped by workers.

Tokens are words (A-Z lower-cased) and one end token after each text; end tokens are also the context of a
text's first words. A first pass counts words; their hashes, sorted in files by leading bits, give each
word an id. A second pass counts n-grams of the highest order: tasks send columns of ids, compressed, to
buckets by the hash of the context. A bucket writes its n-grams as sorted hash arrays with counts, and its
contexts with what their probabilities need; an n-gram without its first word goes on to the next lower
order, whose counts are continuation counts: how many different words stand before it. Bigrams are dealt
out by their own hash, as a common word has very many, and what they say of contexts and of words is
summed by remainders of ids. The driver sees counts of counts only.

All counts cover all training texts; nothing is pruned. Probabilities sum to one over the words seen
and one unknown word.

Defined results: null text is empty: one end token; repeated rows count as often as they occur; a null
id has no remainder, so by default its row is scored and not learned from; very long texts are scored
whole; extra columns are ignored; without training texts every probability is one; empty input gives no
rows. n-grams of three words and more are told apart by hashes (see `gram_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import gram_store, packed, shared, sorted_store, words

ORDER = 3
FLUSH = 2_500_000
END = np.uint64(0x5E5E5E5E5E5E5E5F)
UNIGRAM = (("place", np.uint32),)
RANGES = ("n1", "n2", "n3", "total", "before")
CONTEXT = ("n1", "n2", "n3", "total")


@dataclass(frozen=True)
class Model:
    """`grams` and `contexts` have a folder for each order from 2 on; `discounts` three numbers for each order from
    1 on; `first_ids` the first id of each class of counts and bucket of words."""

    order: int
    unigrams: str
    first_ids: np.ndarray
    grams: tuple[str, ...]
    contexts: tuple[str, ...]
    bits: int
    tokens: int
    types: int
    ranges: int
    discounts: tuple[tuple[float, float, float], ...]
    pairs: int
    rest: float


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each row followed by the end token, and the rows' first tokens."""
    h, first, _, _, _ = words.hash_text(column, lower=True)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _size_class(counts: np.ndarray) -> np.ndarray:
    """0 for the greatest counts: 63 less the number's leading bit."""
    return 63 - np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _count_words(texts: DataFrame, target: str, bits: int) -> tuple[int, int, np.ndarray]:
    """Write the word store; tokens, types, and the first id of each (size class, bucket).

    Words get ids by the class of their count, the greatest first, so that common words have small numbers,
    which pack well; in a class they are in the order of their hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = packed.Counter()

        def out():
            h, n = held.take()
            h = h.astype(np.uint64)  # nothing held has another kind
            for b, at in packed.buckets(h, sorted_store.bucket_of(h, bits)):
                yield _blob(b, [np.diff(h[at] << np.uint64(bits) >> np.uint64(bits), prepend=np.uint64(0)), n[at]])

        for batch in batches:
            for block in words.blocks(batch, "text"):
                if held.add(_tokens(block.column(0))[0]):
                    yield from out()
        yield from out()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in packed.by_key(batches):
            blobs = [gram_store.unsqueeze(x) for p in parts for x in p[1].to_pylist()]
            h, n = packed.merged(np.concatenate([np.cumsum(b[0].view(np.uint64)) for b in blobs]), np.concatenate([b[1] for b in blobs]))
            kind = _size_class(n)
            order = np.argsort(kind, kind="stable")
            place = np.empty(len(n), np.int64)
            sizes = np.bincount(kind, minlength=64)
            place[order] = np.arange(len(n)) - (np.cumsum(sizes) - sizes)[kind[order]]
            sorted_store.save(target, "hash", bucket, h | (np.uint64(bucket) << np.uint64(64 - bits)))
            sorted_store.save(target, "place", bucket, place.astype(np.uint32))
            gram_store.put_numbers(target, f"count-{bucket:06d}", n)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([int(n.sum())]), pa.array([sizes.tolist()], pa.list_(pa.int64()))], ["bucket", "tokens", "sizes"])

    counted = texts.mapInArrow(count, "bucket int, data binary").repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    held = counted.mapInArrow(put, "bucket int, tokens long, sizes array<long>").collect()  # a row for each bucket
    sizes = np.zeros((64, 1 << bits), np.int64)
    for row in held:
        sizes[:, row.bucket] = row.sizes
    return sum(row.tokens for row in held), int(sizes.sum()), (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)


class Words:
    """The word store, mapped: id and count of each word's hash."""

    def __init__(self, uri: str, bits: int, first: np.ndarray):
        self.store, self.first, self.bits = sorted_store.opened(uri, bits, UNIGRAM), first, bits
        have = {x.rsplit("/", 1)[1] for x in shared.listed(uri)}
        self.counts = [gram_store.Numbers(uri, name) if (name := f"count-{b:06d}") in have else None for b in range(1 << bits)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted hashes: id (-1 where unknown) and count (0)."""
        at, place = self.store.find(h, "place")
        bucket = sorted_store.bucket_of(h, self.bits)
        counts = np.zeros(len(h), np.int64)
        known = at >= 0
        for b in np.unique(bucket[known]):
            here = np.flatnonzero(known & (bucket == b))
            counts[here] = self.counts[b][at[here] - self.store.starts[b]]
        ids = np.full(len(h), -1, np.int64)
        ids[known] = self.first[_size_class(counts[known]), bucket[known]] + place[known]
        return ids, counts


def _ids(store: Words, h: np.ndarray) -> np.ndarray:
    distinct, inverse = np.unique(h, return_inverse=True)
    return store.find(distinct)[0][inverse]


def _history(ids: np.ndarray, first: np.ndarray, back: int, end: int) -> np.ndarray:
    """The id that stands `back` places before each token in its row, the end token's before the row."""
    out = np.empty_like(ids)
    out[back:] = ids[: len(ids) - back]
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    out[place < back] = end
    return out


def _sent_pairs(columns: list[np.ndarray], n: np.ndarray, types: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Bigrams and their counts for each bucket of their own hash."""
    keys = columns[0].astype(np.int64) * types + columns[1]
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    for b, at in packed.buckets(keys, sorted_store.bucket_of(words.mix(keys.view(np.uint64)), bits)):
        yield _blob(b, [np.diff(keys[at], prepend=0), n[at]])


def _sent_grams(columns: list[np.ndarray], n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Longer n-grams and their counts for each bucket of their context."""
    bucket = sorted_store.bucket_of(gram_store.of_context(columns), bits)
    for b, at in packed.buckets(columns[0], bucket):
        at = at[np.lexsort([c[at] for c in columns[::-1]])]
        yield _blob(b, [np.diff(columns[0][at], prepend=0), *(c[at] for c in columns[1:]), n[at]])


def _blob(bucket: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([gram_store.squeeze(arrays)], pa.binary())], ["bucket", "data"])


def _sent(order: int, columns: list[np.ndarray], n: np.ndarray, types: int, bits: int) -> Iterator[pa.RecordBatch]:
    return _sent_pairs(columns, n, types, bits) if order == 2 else _sent_grams(columns, n, bits)


def _count_highest(texts: DataFrame, order: int, unigrams: str, bits: int, types: int, first_ids: np.ndarray) -> DataFrame:
    """n-grams of the highest order, by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = Words(unigrams, bits, first_ids), gram_store.Counter(FLUSH)
        end, kind = int(store.find(np.array([END]))[0][0]), np.int32 if types < 1 << 31 else np.int64
        for batch in batches:
            for block in words.blocks(batch, "text"):
                h, first = _tokens(block.column(0))
                ids = _ids(store, h).astype(kind)
                if held.add([_history(ids, first, back, end) for back in range(order - 1, 0, -1)] + [ids]):
                    yield from _sent(order, *held.take(), types, bits)
        if (last := held.take()) is not None:
            yield from _sent(order, *last, types, bits)

    return texts.mapInArrow(count, "bucket int, data binary")


def _tops(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=5)[1:5]


def _by_class(n: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
    """For each group that begins at a head: how many counts are 1, 2, and 3 or more, and their sum."""
    return [np.add.reduceat(x.astype(np.int64), heads) for x in (n == 1, n == 2, n >= 3, n)]


def _lowered(sent: DataFrame, order: int, grams: str, contexts: str, bits: int, types: int, end: int) -> DataFrame:
    """Write the stores of one order above 2, with counts of counts; the n-grams of the next lower order by bucket."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in packed.by_key(batches):
            blobs = [gram_store.unsqueeze(x) for p in parts for x in p[1].to_pylist()]
            columns = [np.concatenate([np.cumsum(b[0]) if c == 0 else b[c] for b in blobs]) for c in range(order)]
            columns, n = gram_store.merged(columns, np.concatenate([b[order] for b in blobs]))
            del blobs
            context = gram_store.of_context(columns)
            gram_store.save(grams, bucket, bits, gram_store.under(context, gram_store.hashes(columns), bits), {"count": n})
            by = np.argsort(context, kind="stable")
            heads = np.flatnonzero(np.diff(context[by], prepend=~context[by[:1]]))
            stats = _by_class(n[by], heads)
            # A context that occurs once is known from its own n-gram, unless that ends with an end token.
            kept = (stats[3] > 1) | (columns[order - 2][by[heads]] == end)
            gram_store.save(contexts, bucket, bits, context[by[heads]][kept], {name: x[kept] for name, x in zip(CONTEXT, stats, strict=True)})
            shared.put(f"{grams}/{bucket:06d}-tops", _tops(n))
            yield from _sent(order - 1, *gram_store.merged(columns[1:], np.ones(len(n), np.int64)), types, bits)

    in_buckets = sent.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    return in_buckets.mapInArrow(put, "bucket int, data binary")


def _count_pairs(sent: DataFrame, bigrams: str, contexts: str, bits: int, types: int, ranges: int) -> DataFrame:
    """Write the bigram store and the context arrays; rows (kind, value, how many) of counts of counts."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in packed.by_key(batches):
            blobs = [gram_store.unsqueeze(x) for p in parts for x in p[1].to_pylist()]
            keys, n = packed.merged(np.concatenate([np.cumsum(b[0]) for b in blobs]), np.concatenate([b[1] for b in blobs]))
            del blobs
            gram_store.save(bigrams, bucket, bits, words.mix(keys.view(np.uint64)), {"count": n})
            yield _row(-1, 0, _tops(n), np.array([len(n)]))
            left, right = keys // types, keys % types
            heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            yield from _by_range(0, left[heads], _by_class(n, heads), ranges)
            word, before = np.unique(right, return_counts=True)
            yield from _by_range(1, word, [before], ranges)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in packed.by_key(batches):
            if key < 0:
                tops = np.sum([packed.wide(x) for p in parts for x in p[2].to_pylist()], axis=0)
                pairs = sum(int(packed.wide(x)[0]) for p in parts for x in p[3].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([tops.tolist()], pa.list_(pa.int64())), pa.array([pairs])], ["kind", "tops", "size"])
                continue
            size = -(-(types - key) // ranges)
            sums = {name: np.zeros(size, np.int64) for name in RANGES}
            for p in parts:
                for kind, ids, values in zip(p[1].to_pylist(), p[2].to_pylist(), p[3].to_pylist(), strict=True):
                    ids = np.cumsum(packed.wide(ids))
                    values = packed.wide(values).reshape(-1, len(ids))
                    for name, v in zip(["n1", "n2", "n3", "total"] if kind == 0 else ["before"], values, strict=True):
                        sums[name][ids] += v
            for name in RANGES:
                gram_store.put_numbers(contexts, f"{name}-{key:06d}", sums[name])
            tops = np.bincount(np.minimum(sums["before"], 5), minlength=5)[1:5]
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([tops.tolist()], pa.list_(pa.int64())), pa.array([0])], ["kind", "tops", "size"])

    in_buckets = sent.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    known = in_buckets.mapInArrow(put, "part int, kind int, ids binary, data binary").repartition(1 << bits, "part").sortWithinPartitions("part")
    return known.mapInArrow(gather, "kind int, tops array<long>, size long")


def _row(part: int, kind: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([packed.narrow(ids)], pa.binary()), pa.array([packed.narrow(values)], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["part", "kind", "ids", "data"])


def _by_range(kind: int, ids: np.ndarray, values: list[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    """Sorted ids dealt out by their remainder: the common words, which have the small ids, come into all ranges."""
    for part, at in packed.buckets(ids, ids % ranges):
        yield _row(part, kind, np.diff(ids[at] // ranges, prepend=0), np.concatenate([v[at] for v in values]))


def _discounts(tops: np.ndarray) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many keys have count 1, 2, 3, 4."""
    n1, n2, n3, n4 = (float(x) for x in tops)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = [n2 / n1 if n1 else 0.5, n3 / n2 if n2 else 0.5, n4 / n3 if n3 else 0.5]
    return tuple(min(max(k - (k + 1) * y * ratio[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """A model of the texts; order is the length of its longest n-grams, 2 at least."""
    if order < 2:
        raise ValueError(f"the order is 2 at least, not {order}")
    spark = docs.sparkSession
    texts, bits = docs.select(F.col(text_col).alias("text")), sorted_store.bits_for(docs)
    unigrams = shared.folder(spark, "lm-words")
    grams, contexts = (tuple(shared.folder(spark, f"lm-{name}-{k}") for k in range(2, order + 1)) for name in ("grams", "contexts"))
    tokens, types, first_ids = _count_words(texts, unigrams, bits)
    ranges = max(1, min(types, 1 << bits))
    tops, pairs = {k: np.zeros(4) for k in range(1, order + 1)}, 0
    if types:
        end = int(Words(unigrams, bits, first_ids).find(np.array([END]))[0][0])
        sent = _count_highest(texts, order, unigrams, bits, types, first_ids)
        for k in range(order, 2, -1):
            sent = _lowered(sent, k, grams[k - 2], contexts[k - 2], bits, types, end)
        for row in _count_pairs(sent, grams[0], contexts[0], bits, types, ranges).groupBy("kind").agg(
            *(F.sum(F.col("tops")[i]).alias(f"t{i}") for i in range(4)), F.sum("size").alias("size")
        ).collect():
            tops[2 - row.kind] = np.array([row.t0, row.t1, row.t2, row.t3], float)
            pairs += row["size"]
        for k in range(3, order + 1):  # four numbers for each bucket
            tops[k] = np.sum([shared.mapped(x, np.int64) for x in shared.listed(grams[k - 2]) if x.endswith("-tops")], axis=0).astype(float)
    discounts = tuple(_discounts(tops[k]) for k in range(1, order + 1))
    # What the lowest order takes from its words: every word stands after something.
    taken = np.array([tops[1][0], tops[1][1], types - tops[1][0] - tops[1][1]]) @ np.array(discounts[0])
    return Model(order, unigrams, first_ids, grams, contexts, bits, tokens, types, ranges, discounts, pairs, float(taken) / max(1, pairs))


class Scorer:
    """The mapped model."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Words(model.unigrams, model.bits, model.first_ids)
        self.grams = [gram_store.Store(uri, model.bits, ("count",)) for uri in model.grams]
        self.contexts = [None, *(gram_store.Store(uri, model.bits, CONTEXT) for uri in model.contexts[1:])]
        parts = model.ranges if model.types else 0
        self.ranges = {n: [gram_store.Numbers(model.contexts[0], f"{n}-{p:06d}") for p in range(parts)] for n in RANGES}

    def _of(self, name: str, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        part = ids % self.model.ranges
        for p in np.unique(part[ids >= 0]):
            here = (part == p) & (ids >= 0)
            out[here] = self.ranges[name][p][ids[here] // self.model.ranges]
        return out

    def score(self, column) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base score, model score (sums of log10)."""
        m = self.model
        h, first = _tokens(column)
        distinct, inverse = np.unique(h, return_inverse=True)
        ids, counts = self.words.find(distinct)
        base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
        if m.types:
            probability = self._interpolated(ids, inverse, first, int(np.searchsorted(distinct, END)))
        else:
            probability = np.ones(len(h))
        edges = first[:-1]
        sums = [np.add.reduceat(x, edges) if len(edges) else x[:0] for x in ((counts > 0)[inverse].astype(np.int64), base[inverse], np.log10(probability))]
        return np.diff(first), *sums

    def _interpolated(self, known: np.ndarray, inverse: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
        """Probability of each token, from the lowest order up; known: ids of the distinct words, -1 unknown."""
        m, ids = self.model, known[inverse]
        probability = self._words(known)[inverse]
        history = [ids]
        seen = np.zeros(len(ids), np.int64)  # counts of the n-grams of the order before that end at each token
        for k in range(2, m.order + 1):
            history.insert(0, known[_history(inverse, first, k - 1, end)])
            whole = np.all([c >= 0 for c in history[:-1]], axis=0)
            if k == 2:
                before = _history(inverse, first, 1, end)
                stats = [x[before] for x in (self._of(name, known) for name in CONTEXT)]
                at = np.flatnonzero(whole & (ids >= 0) & (stats[3] > 0))
                key = words.mix((history[0][at] * m.types + ids[at]).view(np.uint64))
            else:
                asked = np.flatnonzero(whole)
                context = gram_store.of_context([c[asked] for c in history])
                stats = [np.zeros(len(ids), np.int64) for _ in CONTEXT]
                for s, x in zip(stats, self._found(self.contexts[k - 2], context), strict=True):
                    s[asked] = x
                once = np.concatenate([[0], seen[:-1]]) > 0  # the context is the n-gram that ends one token before
                once[first[:-1]] = False
                once &= whole & (stats[3] == 0) & (history[-2] != known[end])
                stats[0][once] = stats[3][once] = 1
                at = np.flatnonzero(whole & (ids >= 0) & (stats[3] > 0))
                own = [c[at] for c in history]
                key = gram_store.under(gram_store.of_context(own), gram_store.hashes(own), m.bits)
            n = np.zeros(len(ids), np.int64)
            n[at] = self._found(self.grams[k - 2], key)[0]
            d = np.array([0.0, *m.discounts[k - 1]])
            total = np.maximum(stats[3], 1)
            mass = sum(d[i + 1] * stats[i] for i in range(3))
            probability = np.where(stats[3] > 0, (n - d[np.minimum(n, 3)]) / total + mass / total * probability, probability)
            seen = n
        return probability

    @staticmethod
    def _found(store: gram_store.Store, h: np.ndarray) -> list[np.ndarray]:
        distinct, inverse = np.unique(h, return_inverse=True)
        return [x[inverse] for x in store.find(distinct)]

    def _words(self, ids: np.ndarray) -> np.ndarray:
        """Probability of a word by how many words it follows, interpolated with all words alike."""
        m = self.model
        before = self._of("before", ids)
        cut = np.array([0.0, *m.discounts[0]])[np.minimum(before, 3)]
        return (before - cut) / m.pairs + m.rest / (m.types + 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score, perplexity of every row."""
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for block in words.blocks(batch, "text"):
                n, known, base, total = scorer.score(block.column(1))
                arrays = [block.column(0), *(pa.array(x) for x in (n, known, base, total, 10 ** (-total / n)))]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 modulo 10."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))
