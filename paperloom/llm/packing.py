"""Best-fit packing of token pieces into sequences: minimum bin slack on the histogram of lengths.

Pieces of one length are exchangeable, so the packing is decided on how many pieces each length has:
at most `capacity` numbers, however large the corpus. For each bin the longest piece left opens it
and a bitset subset-sum over the lengths still available finds the fullest feasible combination;
the combination is then removed as often as the counts allow, which is what choosing it anew for
bin after bin would do. Short pieces may be held back for the slack that is left (see `combinations`). Spark does the rest: each task
of the input is a lane and numbers its pieces of each length as it cuts them; the counts of lanes and lengths
say where a lane's numbers begin, so a piece's rank needs no shuffle of pieces and one common length is no hot
group. The rank says which copy of which combination, and which place in it, the piece takes. The pieces, with
their ids if these are asked for, are written once and read once.

Defined results: null text is empty and is one piece with the end token alone; a document longer than
capacity is cut into pieces of capacity tokens of which the first may be shorter; repeated rows and
null ids are packed like any other row; extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import bpe, shared, words

PLAN_ROWS = 1_000_000
RESERVES = (0, 4, 8, 16, 32, 64, 128, 256)


def fullest(counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """(length, how often): the combination of available lengths with the greatest sum up to space."""
    reach, steps, limit = 1, [], (1 << (space + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= space), reverse=True):
        left, take = min(counts[length], space // length), 1
        while left:  # 1, 2, 4, ... of them, so that every number up to the count can be made
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left, take = left - take, take * 2
        if reach >> space & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return sorted(chosen.items(), reverse=True)


def _filled(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, number of bins) until nothing is left, each bin as full as it can be."""
    counts, out = {k: n for k, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        made = dict(fullest(rest, capacity - longest))
        made[longest] = made.get(longest, 0) + 1
        copies = min(counts[k] // n for k, n in made.items())
        out.append((sorted(made.items(), reverse=True), copies))
        for k, n in made.items():
            counts[k] -= n * copies
            if not counts[k]:
                del counts[k]
    return out


def combinations(counts: dict[int, int], capacity: int, reserves: tuple[int, ...] = RESERVES) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, number of bins) until nothing is left.

    Bins that are filled early use up the short pieces that later ones would need. So pieces up to a
    reserve length are kept back and then put where they leave the least slack; what fits nowhere is
    filled into bins of its own. Of several reserves the one with the fewest bins is taken.
    """
    plans = []
    for reserve in reserves:
        groups: dict[tuple, int] = {}
        for made, copies in _filled({k: n for k, n in counts.items() if k > reserve}, capacity):
            groups[tuple(made)] = groups.get(tuple(made), 0) + copies
        left = {k: n for k, n in counts.items() if k <= reserve and n}
        by_slack: dict[int, list[tuple]] = {}
        for made in groups:
            by_slack.setdefault(capacity - sum(k * n for k, n in made), []).append(made)
        for length in sorted(left, reverse=True):
            while left[length] and (fits := [s for s, held in by_slack.items() if s >= length and held]):
                slack = min(fits)
                made = by_slack[slack].pop()
                copies = groups.pop(made)
                used = min(copies, left[length])
                left[length] -= used
                pieces_ = dict(made)
                pieces_[length] = pieces_.get(length, 0) + 1
                for one, n in ((tuple(sorted(pieces_.items(), reverse=True)), used), (made, copies - used)):
                    if n:
                        if one not in groups:
                            by_slack.setdefault(capacity - sum(k * m for k, m in one), []).append(one)
                        groups[one] = groups.get(one, 0) + n
        plans.append([(list(made), n) for made, n in groups.items()] + _filled(left, capacity))
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces in a bin, first bin, offset of the first piece)."""
    out, used, bins = [], {}, 0
    for made, copies in plan:
        offset = 0
        for length, n in made:
            start = used.get(length, 0)
            used[length] = start + n * copies
            out.append((length, start, used[length], n, bins, offset))
            offset += length * n
        bins += copies
    return out


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, lane, place (and ids) of every piece of every row.

    place numbers the pieces of one length and lane.
    """
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lane = bpe.Encoder(bpe.vocabulary(vocabulary)), TaskContext.get().partitionId()
        cut_so_far = [0] * (capacity + 1)  # pieces of each length
        for batch in batches:
            for block in words.blocks(batch, "text"):
                ids, offsets = encoder.rows(block.column(1))
                ids = ids.astype("<u4")
                row, piece, start, length, crc, place, lists = [], [], [], [], [], [], []
                for n in range(block.num_rows):
                    own = np.append(ids[offsets[n] : offsets[n + 1]], np.uint32(end_id)).astype("<u4")
                    at, stop = 0, len(own) % capacity or min(len(own), capacity)
                    while at < len(own):
                        part = own[at:stop]
                        row.append(n)
                        piece.append(at and piece[-1] + 1)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        place.append(cut_so_far[len(part)])
                        cut_so_far[len(part)] += 1
                        if with_ids:
                            lists.append(part.astype(np.int32))
                        at, stop = stop, stop + capacity
                arrays = [block.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                arrays += [pa.array(np.full(len(row), lane), pa.int32()), pa.array(place, pa.int64())]
                if with_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                names = [id_col, "piece", "start", "length", "ids_crc32", "lane", "place", "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    kind = chosen.schema[id_col].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return chosen.mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, lane int, place long{more}")


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = shared.written(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids), "pieces")
    in_lane = cut.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))  # a few rows for each task
    histogram = {row.length: row.n for row in in_lane.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "place_length long, first long, after long, per_bin long, first_bin long, first_offset long"
    placed = places(combinations(histogram, capacity))
    plan = docs.sparkSession.createDataFrame(placed, schema)

    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_lane.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = shared.written(starts, "lane-starts")
    # A row for each lane and length; beyond PLAN_ROWS neither these nor the plan's are broadcast.
    starts = F.broadcast(starts) if starts.count() <= PLAN_ROWS else starts
    plan = F.broadcast(plan) if len(placed) <= PLAN_ROWS else plan
    ranked = cut.join(starts, ["length", "lane"]).withColumn("rank", F.col("before") + F.col("place"))
    fits = (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    step = F.col("rank") - F.col("first")
    return ranked.join(plan, fits).select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.expr("(rank - first) div per_bin")).alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_bin") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
