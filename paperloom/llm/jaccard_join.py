"""Exact join of documents by the Jaccard similarity of their word shingles, with signature trees.

1. Each text becomes its set of shingles. Equal sets are one class.
2. The document frequency of every shingle is counted over all texts (packed lists of hashes travel
   to buckets; the hash is cut to `DF_BITS` bits there, so a count can only come out too high).
3. In order of that frequency a set's first n - ceil(t * n) + 1 shingles must share one with any set
   it links to. Shingles that one set alone has share nothing, so most texts end here. Classes that
   share such a shingle belong to one cluster (connected components).
4. Each cluster has a tree: its classes are the leaves, blocks of up to `block` classes of like size are
   nodes, and below them, in tasks, small trees of `FAN` sets a node. A node holds the OR of its sets' bitmaps,
   the range of their sizes and, if its classes are joined already, the component they are in. Pairs of nodes
   are traversed in rounds: first each block with itself; then representatives, one for each
   component of a block, which form blocks of their own until one is left; last blocks with blocks (dealt out
   by groups, which have no bounds of their own) and, in tasks, their small trees. A pair of nodes goes on only if
   its sizes and the bits it has in common leave room for enough overlap and it isn't inside one component.
   Sets travel only for pairs of blocks that stay. Pairs of leaves are checked on the sets, best bound first, unless links
   found before already join them.
5. Links give components; a component is named by its smallest document.

Common passages have the highest frequencies and so come last in the order of step 3: they bring
together only documents that consist of them mostly. No candidate is dropped for the size of a group.

Defined results: null text is empty; a text without words has no shingles and links with nothing; with
fewer words than a shingle has, the whole sequence is one; repeated rows are equal sets and linked;
null ids never name a component unless all its ids are null; very long texts are used whole; extra
columns are ignored by `link`, kept by `deduplicate`; empty input gives no rows. Sets and shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import packed, shared, sorted_store, words
from paperloom.llm.columns import free
from paperloom.llm.components import components
from paperloom.llm.exact_dedup import FILTER_BITS, _bitmap, _hit

DF_BITS = 48
BLOCK = 64
FAN = 8
NODE_BITS = 2048
HOT_ROWS, HOT_KEYS = 200, 100_000
FLUSH = 1_500_000
DF = (("df", np.uint32),)


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, first, _, _, _ = words.hash_text(column, lower=True)
    grams = words.grams(h, k)
    for start, stop in zip(first[:-1], first[1:], strict=True):
        if stop - start >= k:
            yield np.unique(grams[start : stop - k + 1])
        elif stop > start:
            yield words.mix(words.grams(h[start:stop], int(stop - start)) + np.uint64(stop - start))
        else:
            yield np.empty(0, np.uint64)


def _class_of(one: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = int(words.mix(one).sum(dtype=np.uint64)) + len(one) * 0x9E3779B97F4A7C15
    return int(words.mix(np.array([total & words.MASK], np.uint64))[0].view(np.int64))


def _frequencies(texts: DataFrame, k: int, target: str, bits: int) -> None:
    """Write the store of cut hashes that occur in two or more texts, with how many."""
    cut = np.uint64(64 - DF_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = packed.Counter(FLUSH), set()

        def out():
            keys, n = held.take()
            keys = keys.view(np.uint64)
            for b, at in packed.buckets(keys, sorted_store.bucket_of(keys << cut, bits)):
                gaps = np.diff(keys[at].view(np.int64), prepend=0)
                arrays = [pa.array([b], pa.int32()), pa.array([packed.narrow(gaps)], pa.binary()), pa.array([packed.narrow(n[at])], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "keys", "n"])

        for batch in batches:
            for block in words.blocks(batch, "text"):
                new = []
                for one in shingle_sets(block.column(0), k):
                    name = _class_of(one)
                    if name not in seen:  # equal sets of this task count once
                        seen.add(name)
                        new.append(one >> cut)
                if new and held.add(np.concatenate(new)):
                    yield from out()
        yield from out()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in packed.by_key(batches):
            keys = np.concatenate([np.cumsum(packed.wide(x)) for p in parts for x in p[1].to_pylist()])
            n = np.concatenate([packed.wide(x) for p in parts for x in p[2].to_pylist()])
            keys, n = packed.merged(keys, n)
            often = n > 1
            sorted_store.save(target, "hash", bucket, keys[often].view(np.uint64) << cut)
            sorted_store.save(target, "df", bucket, np.minimum(n[often], 2**32 - 1).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([int(often.sum())])], ["n"])

    sent = texts.mapInArrow(count, "bucket int, keys binary, n binary").repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    sent.mapInArrow(put, "n long").agg(F.sum("n")).collect()


def _prefixes(docs: DataFrame, k: int, percent: int, store_uri: str, bits: int) -> DataFrame:
    """Per row: id, n, class; and for the first row of a class in a task: its shared prefix and its set."""
    cut = np.uint64(64 - DF_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen = sorted_store.opened(store_uri, bits, DF), set()
        for batch in batches:
            for block in words.blocks(batch, "text"):
                sets = list(shingle_sets(block.column(1), k))
                names = [_class_of(x) for x in sets]
                sizes = np.array([len(x) for x in sets], np.int64)
                fresh = []
                for i, name in enumerate(names):
                    if sizes[i] and name not in seen:
                        seen.add(name)
                        fresh.append(i)
                prefix, kept = [None] * len(sets), [None] * len(sets)
                if fresh:
                    whole = np.concatenate([sets[i] for i in fresh])
                    distinct, inverse = np.unique(whole >> cut << cut, return_inverse=True)
                    _, df = store.find(distinct, "df")
                    df = np.maximum(df, 1)[inverse]
                    edges = np.concatenate([[0], np.cumsum(sizes[fresh])])
                    alone = np.add.reduceat((df == 1).astype(np.int64), edges[:-1])
                    for j, i in enumerate(fresh):
                        n = int(sizes[i])
                        length = n + (-percent * n) // 100 + 1  # n - ceil(t * n) + 1
                        if alone[j] >= length:
                            continue
                        own = df[edges[j] : edges[j + 1]]
                        shared_ones = np.flatnonzero(own > 1)
                        order = shared_ones[np.lexsort((sets[i][shared_ones], own[shared_ones]))]
                        chosen = sets[i][order[: length - int(alone[j])]]
                        prefix[i], kept[i] = chosen.view(np.int64), sets[i].tobytes()
                arrays = [block.column(0), pa.array(sizes), pa.array(names, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "class", "prefix", "set"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, class long, prefix array<long>, set binary")


class Tree:
    """Sets in blocks of FAN, and those again, with bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], width: int):
        sizes = np.array([len(x) for x in sets])
        self.order = np.lexsort(([int(x[0]) for x in sets], sizes))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, i in enumerate(self.order):
            slot = (sets[i] & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[row], slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        n = sizes[self.order]
        # Elements that share a bit with another one of their set can add to an overlap unseen.
        slack = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, n, n, slack)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, s = self.levels[-1]
            heads = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(s, heads)))


def dual_traversal(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves (places in the trees' orders) that may link, and their greatest possible overlap."""
    depth = max(len(a.levels), len(b.levels)) - 1
    left, right = np.array([0]), np.array([0])
    while True:
        la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
        (bits_a, low_a, high_a, slack_a), (bits_b, low_b, high_b, slack_b) = a.levels[la], b.levels[lb]
        common = np.bitwise_count(bits_a[left] & bits_b[right]).sum(axis=1).astype(np.int64)
        room = np.minimum(common + np.minimum(slack_a[left], slack_b[right]), np.minimum(high_a[left], high_b[right]))
        least = low_a[left] + low_b[right]
        fits = (100 + percent) * room >= percent * least
        fits &= 100 * np.minimum(high_a[left], high_b[right]) >= percent * np.maximum(low_a[left], low_b[right])
        left, right, room = left[fits], right[fits], room[fits]
        if depth == 0:
            return left, right, room
        down_a, down_b = depth <= len(a.levels) - 1, depth <= len(b.levels) - 1
        depth -= 1
        step_a = np.arange(FAN) if down_a else np.zeros(1, np.int64)
        step_b = np.arange(FAN) if down_b else np.zeros(1, np.int64)
        left = (left[:, None, None] * (FAN if down_a else 1) + step_a[None, :, None]) + np.zeros((1, 1, len(step_b)), np.int64)
        right = (right[:, None, None] * (FAN if down_b else 1) + step_b[None, None, :]) + np.zeros((1, len(step_a), 1), np.int64)
        left, right = left.ravel(), right.ravel()
        na, nb = len(a.levels[min(depth, len(a.levels) - 1)][0]), len(b.levels[min(depth, len(b.levels) - 1)][0])
        inside = (left < na) & (right < nb)
        left, right = left[inside], right[inside]


def links(
    names: list[int], sets: list[np.ndarray], in_first: np.ndarray, in_second: np.ndarray, percent: int, joined: list[int] | None = None
) -> Iterator[tuple[int, int]]:
    """Links between the sets of two blocks (or inside one), enough of them to join whatever is joined.

    joined: the component each set is known to be in; sets of one component need no link.
    """
    first, second = np.flatnonzero(in_first), np.flatnonzero(in_second)
    if not len(first) or not len(second):
        return
    width = 1 << max(8, int(4 * max(len(x) for x in sets)).bit_length())
    width = min(width, 1 << 16)
    a = Tree([sets[i] for i in first], width)
    b = a if np.array_equal(first, second) else Tree([sets[i] for i in second], width)
    left, right, room = dual_traversal(a, b, percent)
    x, y = first[a.order[left]], second[b.order[right]]
    apart = x < y if b is a else x != y
    x, y, room = x[apart], y[apart], room[apart]
    size = np.array([len(s) for s in sets])
    known: dict[int, int] = {}
    parent = [known.setdefault(c, n) for n, c in enumerate(joined)] if joined is not None else list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in np.argsort(-(room / np.maximum(1, size[x] + size[y] - room)), kind="stable"):
        i, j = int(x[at]), int(y[at])
        p, q = root(i), root(j)
        if p == q:
            continue
        small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
        slot = np.minimum(np.searchsorted(large, small), len(large) - 1)
        overlap = int((large[slot] == small).sum())
        if 100 * overlap >= percent * (int(size[i] + size[j]) - overlap):
            parent[p] = q
            yield names[i], names[j]


def _verified(work: DataFrame, percent: int) -> DataFrame:
    """(u, v) links from rows (unit, side, class, component, set): side 0 meets side 1, and 2 is on both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in packed.by_key(batches):
            side, names, joined, data = ([v for p in parts for v in p[c].to_pylist()] for c in range(1, 5))
            sets, side = [np.frombuffer(x, np.uint64) for x in data], np.array(side)
            found = list(links(names, sets, side != 1, side != 0, percent, joined))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    chosen = work.select("unit", "side", "class", "component", "set").repartition("unit").sortWithinPartitions("unit")
    return shared.written(chosen.mapInArrow(run, "u long, v long"), "links")


def _node_bits(sets: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """OR of the sets' bitmaps, and the most elements of one set that share a bit with another of it."""
    flat = np.zeros(NODE_BITS, bool)
    slack = 0
    for one in sets:
        slot = np.unique((one & np.uint64(NODE_BITS - 1)).astype(np.int64))
        slack = max(slack, len(one) - len(slot))
        flat[slot] = True
    return np.packbits(flat, bitorder="little").view("<u8"), slack


def _nodes(members: DataFrame) -> DataFrame:
    """One row for each block: cluster, block, its bitmap, sizes, slack, and its component if it has one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in packed.by_key(batches):
            clusters, joined, data = ([v for p in parts for v in p[c].to_pylist()] for c in range(1, 4))
            for cluster in set(clusters):
                own = [n for n, c in enumerate(clusters) if c == cluster]
                sets = [np.frombuffer(data[n], np.uint64) for n in own]
                bits, slack = _node_bits(sets)
                sizes, one = [len(x) for x in sets], {joined[n] for n in own}
                row = [cluster, block, bits.tobytes(), min(sizes), max(sizes), slack, min(one) if len(one) == 1 else None]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["cluster", "block", "bits", "low", "high", "slack", "component"])

    chosen = members.select("block", "cluster", "component", "set").repartition("block").sortWithinPartitions("block")
    return shared.written(chosen.mapInArrow(run, "cluster long, block long, bits binary, low long, high long, slack long, component long"), "tree-nodes")


def _block_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(first, second): pairs of different blocks of one cluster that may hold a link.

    Blocks are put into groups; a pair of groups is a row that meets what the two groups hold, at most
    about `BLOCK` nodes each, and gives the pairs of blocks that stay.
    """
    counts = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    grouped = met_hot(nodes, counts, "cluster").withColumn("groups", F.ceil(F.col("rows") / BLOCK).cast("int"))
    grouped = grouped.withColumn("group", F.pmod(F.xxhash64("block", F.lit(1)), F.col("groups")).cast("int"))
    node = F.struct("block", "bits", "low", "high", "slack", "component")
    packs = grouped.groupBy("cluster", "groups", "group").agg(F.collect_list(node).alias("nodes"))
    packs = shared.written(packs, "tree-groups")
    left = packs.select("cluster", "group", F.col("nodes").alias("a"), F.explode(F.sequence(F.col("group"), F.col("groups") - 1)).alias("other"))
    right = packs.select("cluster", F.col("group").alias("other"), F.col("nodes").alias("b"))
    met = left.join(right, ["cluster", "other"]).select("a", "b", (F.col("group") == F.col("other")).alias("own"))

    def arrays(column) -> tuple[np.ndarray, ...]:
        bits = np.stack([np.frombuffer(x["bits"], "<u8") for x in column])
        low, high, slack = (np.array([x[c] for x in column]) for c in ("low", "high", "slack"))
        one = np.array([x["component"] is not None for x in column])
        return bits, low, high, slack, one, np.array([x["component"] or 0 for x in column]), np.array([x["block"] for x in column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = arrays(batch.column(0)[row].as_py()), arrays(batch.column(1)[row].as_py())
                own, out = batch.column(2)[row].as_py(), []
                for i in range(len(a[0])):
                    common = np.bitwise_count(a[0][i] & b[0]).sum(axis=1).astype(np.int64)
                    smaller = np.minimum(a[2][i], b[2])
                    room = np.minimum(common + np.minimum(a[3][i], b[3]), smaller)
                    fits = ((100 + percent) * room >= percent * (a[1][i] + b[1])) & (100 * smaller >= percent * np.maximum(a[1][i], b[1]))
                    fits &= ~(a[4][i] & b[4] & (a[5][i] == b[5]))
                    if own:
                        fits[: i + 1] = False
                    out += [(a[6][i], x) for x in b[6][fits]]
                if out:
                    u, v = np.array(out, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["first", "second"])

    return shared.written(met.mapInArrow(run, "first long, second long"), "block-pairs")


def met_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key and, in `rows`, how many rows of left have it.

    A key of very many rows would put them all into one task. Such keys are few: if they are at most
    HOT_KEYS their rows of right are broadcast, the others are joined by shuffle. If they are more, none of
    them is a large part of left, and all are joined by shuffle.
    """
    right = shared.written(right, "keys")
    hot = right.where(F.col("rows") > HOT_ROWS)
    if not 0 < hot.count() <= HOT_KEYS:
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("rows") <= HOT_ROWS), key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def _dealt(members: DataFrame, block: int, salt: int) -> DataFrame:
    """members (cluster, class, n, ...) with a block, and whether the cluster has more than one.

    Classes of a cluster are dealt out, those of like size together, unless one block holds them all.
    """
    counts = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block)
    met = met_hot(members, counts, "cluster", "left")
    by_size = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3)))
    number = F.pmod(F.xxhash64("class", F.lit(salt)), F.ceil(F.col("rows") / block))
    dealt = F.when(F.col("rows").isNull(), F.col("cluster")).otherwise(F.xxhash64("cluster", by_size, number))
    return met.select(*members.columns, dealt.alias("block"), F.col("rows").isNotNull().alias("large"))


def _joined(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with the component that links found so far put each class in."""
    named = components(found).select(F.col("node").alias("class"), F.col("label").alias("component"))
    return members.drop("component").join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _all_links(rows: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that join whatever is joined, from the classes' sets and the clusters they are in."""
    known = rows.where("set is not null")
    sets, sizes = known.select("class", "set").dropDuplicates(["class"]), known.select("class", "n").distinct()
    placed = clusters.select(F.col("node").alias("class"), F.col("label").alias("cluster")).join(sizes, "class")
    members = shared.written(_dealt(placed.withColumn("component", F.col("class")), block, 0).join(sets, "class"), "tree-leaves")
    found = _verified(members.select(F.col("block").alias("unit"), F.lit(2).alias("side"), "class", "component", "set"), percent)
    wide = members.where("large").drop("large")
    now, level, salt = wide.count(), wide, 0
    if not now:
        return found
    # Representatives stand for what is joined in their block, as long as that makes them far fewer.
    while True:
        marked = _joined(level, found)
        one = marked.groupBy("cluster", "block", "component").agg(F.min("class").alias("class"))
        kept = marked.join(one.select("class"), "class", "left_semi").drop("block")
        salt += 1
        dealt = shared.written(_dealt(kept, block, salt), "representatives")
        left = dealt.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("large"), F.lit(False)).alias("large")).first()
        if 2 * left.n > now:
            break
        now, level = left.n, dealt.drop("large")
        found = found.union(_verified(level.select(F.col("block").alias("unit"), F.lit(2).alias("side"), "class", "component", "set"), percent))
        if not left.large:
            break
    leaves = shared.written(_joined(wide, found), "tree-leaves")
    pairs = _block_pairs(_nodes(leaves), percent)
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("block")), F.struct(F.lit(1).alias("side"), F.col("second").alias("block"))))
    units = pairs.select(F.xxhash64("first", "second").alias("unit"), side.alias("s")).select("unit", "s.*")
    return found.union(_verified(units.join(leaves, "block"), percent))


def link(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id of every row of docs."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    store, bits = shared.folder(spark, "shingle-df"), sorted_store.bits_for(chosen)
    _frequencies(chosen.select("text"), k, store, bits)
    rows = shared.written(_prefixes(chosen, k, percent, store, bits), "shingle-prefixes")

    # A class may stand in several tasks' rows: its repeats cost a row each and link it with itself only.
    postings = rows.where("prefix is not null").select("class", F.explode("prefix").alias("shingle"))
    groups = postings.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("rows"))
    groups = groups.where("least <> most").drop("most")
    together = met_hot(postings, groups, "shingle").select(F.col("class").alias("u"), F.col("least").alias("v"))
    joined = components(_all_links(rows, components(together), percent, block)).select(F.col("node").alias("class"), "label")

    named = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("rows"))
    labelled = shared.written(named.join(joined, "class", "left").withColumn("label", F.coalesce("label", "class")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    of_class = met_hot(labelled.select("label", "class", F.col("rows").alias("copies")), least, "label").select("class", "component_id", F.col("copies").alias("rows"))
    full = met_hot(rows.where("n > 0").select("id", "n", "class"), of_class, "class").select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, with all its columns.

    Rows of one id with different texts are told apart; rows that repeat id and text count as one, of
    which one stays; a row without an id stays only if no row with an id is in its component.
    """

    def key() -> Column:
        tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
        return F.struct(F.col(id_col).isNull().alias("without"), F.col(id_col).alias("id"), tag.alias("tag"))

    own, named = free(docs, "_own", "_named")
    keyed = docs.select(key().alias(own), F.col(text_col).alias("body"))
    found = link(keyed, k, percent, own, "body").select(own, F.col("component_id").alias(named))
    rows = found.groupBy(own, named).agg(F.count(F.lit(1)).alias("n"))
    stays = (F.col(own) == F.col(named)).alias("stays")
    told = shared.written(rows.where((F.col(own) != F.col(named)) | (F.col("n") > 1)).select(own, stays), "near-duplicates")
    # Only rows whose id is told of are shuffled with their texts.
    may = _hit(_bitmap(told, F.xxhash64(f"{own}.id"), 4 * FILTER_BITS), F.xxhash64(F.col(id_col)), 4 * FILTER_BITS)
    marked = docs.where(may).withColumn(own, key())
    kept = docs.where(~may).unionByName(marked.join(told.select(own), own, "left_anti").select(docs.columns))
    again = told.where("stays").select(own)
    if again.isEmpty():
        return kept
    return kept.unionByName(marked.join(again, own, "left_semi").dropDuplicates([own]).select(docs.columns))
