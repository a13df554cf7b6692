"""Prefix trie of rebuilt conversations, merged family by family.

A family is the conversations of one base id. Conversations of a family share their base's first turns, so
most merging can be done before anything is shuffled for the whole trie:

1. Turns become narrow rows (a digest of role and text, and the text's size) and meet by base id. The task
   that has a family rebuilds its conversations and builds its small trie; a node's key is the digest of its
   parent's key and its turn's. It sends the combined nodes (members, smallest member, how many end there)
   and, for later, each conversation's path as one row of packed keys.
2. Combined nodes of all families are merged by key. A node is owned by its smallest member. What a
   conversation owns is the end of its path, so a row for each conversation says where that begins.
3. These rows meet the paths, again by base id. What a node's subtree holds is a sum over its members: a member
   adds the bytes of its turns from the node on, less those of nodes that it owns itself (each node is counted
   once by its owner), and one leaf if the end of its path is childless and its own. So no round for each
   depth is needed, however deep the trie is. Families' combined sums are merged by key once more.
4. Ids that end at one node are put together as text in order, in ranges of (node, id), before one digest is
   made of them: a node where very many end is many ranges.

A task holds the nodes of one family, and not more than `SEGMENT` of them: longer conversations are written
in pieces and streamed. The root and a first turn that all have are combined in each task before they are
shuffled. One conversation's own turns are a chain of digests and so are read by one task, as narrow rows.

Defined results: turns are ordered by number, nulls first, equal numbers by the digest of role and text; null
role or text is empty; rows without conv_id belong to no conversation and are left out; repeated rows are
turns of their own; for negative ids the base is nearer to zero; an empty text adds no bytes; extra columns
are ignored; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import hot, shared

FAMILY, HEADS = 5, 9  # conversations of a base; a head has fewer turns than HEADS
SEGMENT = 4096
ROWS = 8192
IDS_BYTES = 1 << 20
KEY = 16
ROOT = bytes(KEY)
NODE = "key: binary, parent: binary, depth: long, bytes: long, least: long, n: long, n_end: long, min_end: long"
PATH = "base: long, conv: long, depth: long, before: long, keys: binary, sizes: array<long>, last: boolean"
_NODE = pa.struct([("key", pa.binary()), ("parent", pa.binary())] + [(n, pa.int64()) for n in ("depth", "bytes", "least", "n", "n_end", "min_end")])
_PATH = pa.struct([
    ("base", pa.int64()), ("conv", pa.int64()), ("depth", pa.int64()), ("before", pa.int64()), ("keys", pa.binary()),
    ("sizes", pa.list_(pa.int64())), ("last", pa.bool_()),
])


def head_turns(conv: int, heads: int = HEADS) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv).encode()) % heads


class _Sender:
    """Rows of two kinds in one stream: nodes and paths."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.paths: list[tuple] = []

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        for rows, kind, at in ((self.nodes, _NODE, 0), (self.paths, _PATH, 1)):
            if len(rows) > least:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), kind, strict=True)]
                pair = [pa.nulls(len(rows), _NODE), pa.nulls(len(rows), _PATH)]
                pair[at] = pa.StructArray.from_arrays(columns, fields=list(kind))
                rows.clear()
                yield pa.RecordBatch.from_arrays(pair, ["node", "path"])


class _Family:
    """The small trie of one family, and the path of the conversation that is being read."""

    def __init__(self, base: int, out: _Sender):
        self.base, self.out = base, out
        self.heads: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}

    def begin(self, conv: int, heads: int) -> None:
        self.conv, self.rank, self.skip = conv, 0, head_turns(conv, heads)
        self.key, self.parent, self.depth, self.size, self.before = ROOT, None, 0, 0, 0
        self.keys: list[bytes] = []
        self.sizes: list[int] = []
        self._visit()
        if conv != self.base:
            for digest, size in self.heads[: self.skip]:
                self._step(digest, size)

    def turn(self, digest: bytes, size: int, heads: int) -> None:
        self.rank += 1
        if self.conv == self.base and self.rank < heads:
            self.heads.append((digest, size))
        if self.conv == self.base or self.rank > self.skip:
            self._step(digest, size)

    def end(self) -> None:
        node = self._node()
        node[5] += 1
        node[6] = self.conv if node[6] is None else min(node[6], self.conv)
        self._send_path(True)

    def send(self) -> None:
        self.out.nodes += [(key, *node) for key, node in self.nodes.items()]
        self.nodes = {}

    def _node(self) -> list:
        if self.key not in self.nodes:
            if len(self.nodes) >= SEGMENT:
                self.send()
            self.nodes[self.key] = [self.parent, self.depth, self.size, self.conv, 0, 0, None]
        return self.nodes[self.key]

    def _visit(self) -> None:
        node = self._node()
        node[3] = min(node[3], self.conv)
        node[4] += 1
        self.keys.append(self.key)
        self.sizes.append(self.size)

    def _step(self, digest: bytes, size: int) -> None:
        if len(self.keys) >= SEGMENT:
            self._send_path(False)
        self.parent, self.key = self.key, hashlib.blake2b(self.key + digest, digest_size=KEY).digest()
        self.depth, self.size = self.depth + 1, size
        self._visit()

    def _send_path(self, last: bool) -> None:
        first = self.depth - len(self.keys) + 1
        self.out.paths.append((self.base, self.conv, first, self.before, b"".join(self.keys), self.sizes, last))
        self.before += sum(self.sizes)
        self.keys, self.sizes = [], []


def _tries(turns: DataFrame, heads: int) -> DataFrame:
    """(node, path): combined nodes and packed paths of each family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, family, conv = _Sender(), None, None
        for batch in batches:
            for base, one, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if family is None or base != family.base or one != conv:
                    if family is not None:
                        family.end()
                    if family is None or base != family.base:
                        if family is not None:
                            family.send()
                        family = _Family(base, out)
                    conv = one
                    family.begin(conv, heads)
                    yield from out.take(ROWS)
                family.turn(digest, size, heads)
        if family is not None:
            family.end()
            family.send()
        yield from out.take()

    met = turns.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest")
    return met.select("base", "conv", "digest", "size").mapInArrow(run, f"node struct<{NODE}>, path struct<{PATH}>")


def _subtree_sums(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """key, saved, leaves: what each family's members add to each of its nodes. Facts and paths meet by base id."""
    kinds = "base long, kind int, conv long, start long, leaf boolean, own long, total long, depth long, before long, keys binary, sizes array<long>"
    sides = [
        facts.withColumn("kind", F.lit(0)), paths.select("base", F.lit(1).alias("kind"), "conv", "depth", "before", "keys", "sizes"),
    ]
    names = [x.split()[0] for x in kinds.split(", ")]
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, sums = None, {}, {}

        def out():
            saved, leaves = zip(*sums.values(), strict=True)
            arrays = [pa.array(list(sums), pa.binary()), pa.array(saved, pa.int64()), pa.array(leaves, pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, ["key", "saved", "leaves"])

        for batch in batches:
            for base, kind, conv, start, leaf, own, total, depth, before, keys, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base != now:
                    now, known = base, {}
                    if len(sums) > ROWS:  # families have nodes in common: they may share what is held
                        yield out()
                if kind == 0:
                    known[conv] = (start, leaf, own, total)
                    continue
                start, leaf, own, total = known[conv]
                size = np.array(sizes, np.int64)
                from_here = total - (before + np.cumsum(size) - size)
                above = np.arange(depth, depth + len(size)) < (start if start is not None else depth + len(size))
                saved = np.where(above, from_here - own, 0).tolist()
                for n, more in enumerate(saved):
                    key = keys[KEY * n : KEY * n + KEY]
                    old = sums.get(key, (0, 0))
                    sums[key] = (old[0] + more, old[1] + leaf)
                if len(sums) > 4 * ROWS:
                    yield out()
        if sums:
            yield out()

    met = rows.repartition("base").sortWithinPartitions("base", "kind", "conv", "depth")
    return met.mapInArrow(run, "key binary, saved long, leaves long")


def _ends(ends: DataFrame) -> DataFrame:
    """key, ids_sha256 from (key, conv): the digest of the ids of each key in order, joined by commas."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, None, [], 0
        for batch in batches:
            for key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != now or size > IDS_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first]), pa.array([",".join(ids)])], ["key", "first", "ids"])
                    ids, size = [], 0
                if not ids:
                    now, first = key, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first]), pa.array([",".join(ids)])], ["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ids_sha256"])
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ids_sha256"])

    runs = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(put, "key binary, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ids_sha256 string")


def trie(
    turns: DataFrame, family: int = FAMILY, heads: int = HEADS, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(id_col).cast("long")
    narrow = turns.where(F.col(id_col).isNotNull()).select(
        (conv - conv % family).alias("base"), conv.alias("conv"), F.col(turn_col).alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256)), 1, KEY).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    built = shared.written(_tries(narrow, heads), "family-tries")
    paths = built.where("path is not null").select("path.*")

    combined = built.where("node is not null").select("node.*").groupBy("key")
    merged = combined.agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min("least").alias("least"),
        F.sum("n").alias("n"), F.sum("n_end").alias("n_end"), F.min("min_end").alias("min_end"),
    )
    merged = shared.written(merged, "merged-nodes")

    owned = merged.select(F.col("least").alias("conv"), F.col("depth").alias("start"), (F.col("n") == F.col("n_end")).alias("leaf"), F.col("bytes").alias("own"), F.lit(0).cast("long").alias("total"))
    walked = paths.select("conv", F.lit(None).cast("long").alias("start"), F.lit(False).alias("leaf"), F.lit(0).cast("long").alias("own"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    facts = owned.union(walked).groupBy("conv").agg(F.min("start").alias("start"), F.bool_or("leaf").alias("leaf"), F.sum("own").alias("own"), F.sum("total").alias("total"))
    facts = facts.withColumn("base", F.col("conv") - F.col("conv") % family)
    sums = _subtree_sums(paths, facts).groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    several = merged.where("n_end > 1").select("key", F.col("n_end").alias("rows"))
    ended = paths.where("last").select(F.expr(f"substring(keys, -{KEY}, {KEY})").alias("key"), "conv")
    digests = _ends(hot.met(ended, several, "key", "left_semi").select("key", "conv"))
    nodes = merged.join(sums, "key").join(children, "key", "left").join(digests, "key", "left")
    nodes = shared.written(nodes.withColumn("children", F.coalesce("children", F.lit(0))), "trie-nodes")

    parents = nodes.where("children > 0").select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"), F.col("children").alias("rows"))
    one = F.sha2(F.coalesce(F.col("min_end").cast("string"), F.lit("")), 256)
    return hot.met(nodes, parents, "parent", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ids_sha256", one).alias("ends_sha256"),
    )
