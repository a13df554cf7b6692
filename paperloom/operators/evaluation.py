"""Scores of extracted fields and rows against expected ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import fuzzy
from paperloom.functions import values as V
from paperloom.operators.reconcile import agrees
from paperloom.settings import DEFAULT, Settings


def exact(e: Column, a: Column) -> Column:
    """Equal booleans, numbers within 1e-9, or stripped texts; mixed kinds are unequal; two nulls are equal."""
    same = e["kind"] == a["kind"]
    equal = F.when(e["kind"] == "bool", e["b"] == a["b"]).when(e["kind"] == "number", F.abs(e["n"] - a["n"]) <= 1e-9).otherwise(V.strip(e["s"]) == V.strip(a["s"]))
    return F.when(e.isNull() & a.isNull(), True).when(e.isNull() | a.isNull(), False).otherwise(same & equal)


def matched(e: Column, a: Column, kind: Column, settings: Settings = DEFAULT, use_fuzzy: bool = True) -> Column:
    """Equal, or in agreement under the field's kind."""
    return F.when(exact(e, a), True).when(e.isNull() | a.isNull(), False).otherwise(agrees(kind, e, a, settings, use_fuzzy))


def scalar_accuracy(rows: DataFrame, *by: str, use_fuzzy: bool = False) -> DataFrame:
    """Means of exact and normalized matches of rows (expected, actual, kind); nothing expected scores 1."""
    scored = rows.withColumn("_e", exact(F.col("expected"), F.col("actual")).cast("int"))
    scored = scored.withColumn("_m", matched(F.col("expected"), F.col("actual"), F.col("kind"), use_fuzzy=use_fuzzy).cast("int"))
    return scored.groupBy(*by).agg(
        F.round(F.coalesce(F.avg("_e"), F.lit(1.0)), 6).alias("exact_accuracy"),
        F.round(F.coalesce(F.avg("_m"), F.lit(1.0)), 6).alias("normalized_accuracy"), F.count("_e").alias("n_fields"),
    )


def similarity(expected: DataFrame, actual: DataFrame, on: list[str], columns: list[str], room: float = 0.01) -> DataFrame:
    """(on, i, j, score): the share of equal columns of every expected and actual row of one collection.

    A collection is one document's rows, so the product is taken inside a document only.
    """
    e = expected.select(*on, F.col("idx").alias("i"), *(F.col(c).alias(f"e_{c}") for c in columns))
    a = actual.select(*on, F.col("idx").alias("j"), *(F.col(c).alias(f"a_{c}") for c in columns))
    met = e.join(a, on)

    def same(c: str) -> Column:
        x, y = F.col(f"e_{c}"), F.col(f"a_{c}")
        near = F.abs(x - y) <= room if dict(expected.dtypes)[c] in ("double", "float", "int", "bigint") else x == y
        return F.when(x.isNull() & y.isNull(), 1.0).otherwise(F.coalesce(near, F.lit(False)).cast("double"))

    total = sum((same(c) for c in columns), F.lit(0.0))
    return met.select(*on, "i", "j", (total / len(columns)).alias("score"))


def taken_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs taken from pairs that stand best first, each row of either side once.

    In rounds: what is the best pair left for both of its rows is taken, which is what taking pairs one by one would
    come to. left and right may be rows of many collections, if these have numbers of their own.
    """
    alive, taken = np.arange(len(left)), []
    while len(alive):
        heads = []
        for side in (left, right):
            is_head = np.zeros(len(alive), bool)
            is_head[np.unique(side[alive], return_index=True)[1]] = True
            heads.append(is_head)
        now = alive[heads[0] & heads[1]]
        taken.append(now)
        alive = alive[~np.isin(left[alive], left[now]) & ~np.isin(right[alive], right[now])]
    return np.sort(np.concatenate(taken)) if taken else alive


def with_taken(rows: DataFrame, pairs: str, into: str) -> DataFrame:
    """rows with `into`, the pairs (i, j, score) taken from each list of (less, i, j) in its order, in the list's place.

    All lists of an Arrow batch are matched at once; pairs must not be null.
    """
    kind = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([f for f in rows.schema.fields if f.name != pairs] + [T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pairs))
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            less, i, j = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            owner = np.repeat(np.arange(len(n)), n)
            left, right = (np.unique(np.stack([owner, x]), axis=1, return_inverse=True)[1].ravel() for x in (i, j))
            at = taken_pairs(left, right)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(n)))])
            taken = pa.StructArray.from_arrays([pa.array(i[at], pa.int64()), pa.array(j[at], pa.int64()), pa.array(-less[at], pa.float64())], ["i", "j", "score"])
            rest = [(batch.column(k), name) for k, name in enumerate(batch.schema.names) if name != pairs]
            columns = [c for c, _ in rest] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken)]
            yield pa.RecordBatch.from_arrays(columns, [name for _, name in rest] + [into])

    return rows.mapInArrow(run, schema)


def _metrics(n_expected: Column, n_actual: Column, taken: Column) -> list[Column]:
    """Precision, recall, F1 and the mean score of the matched cells. Without rows on either side all are 1."""
    n = F.size(taken)
    precision = F.when(n_actual == 0, 1.0).otherwise(F.try_divide(n, n_actual))
    recall = F.when(n_expected == 0, 1.0).otherwise(F.try_divide(n, n_expected))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    total = F.aggregate(taken, F.lit(0.0), lambda x, y: x + y["score"])
    cell = F.when(n > 0, F.try_divide(total, n)).when((n_expected == 0) & (n_actual == 0), 1.0).otherwise(0.0)
    return [
        n.alias("matched"), F.round(precision, 6).alias("row_precision"), F.round(recall, 6).alias("row_recall"),
        F.round(f1, 6).alias("row_f1"), F.round(cell, 6).alias("cell_accuracy"), F.round(f1 * cell, 6).alias("line_item_score"),
    ]


def align(expected: DataFrame, actual: DataFrame, on: list[str], columns: list[str], room: float = 0.01) -> DataFrame:
    """Row precision, recall, F1 and cell accuracy of each collection after a greedy alignment of rows.

    Each side's rows are one array of their collection, so pairs are made and sorted in place: two shuffles.
    """
    e = expected.groupBy(*on).agg(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), *columns)).alias("_e"))
    a = actual.groupBy(*on).agg(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), *columns)).alias("_a"))
    met = e.join(a, on, "full")
    near = {c for c, t in expected.dtypes if t in ("double", "float", "int", "bigint")}

    def same(x: Column, y: Column, c: str) -> Column:
        equal = F.abs(x[c] - y[c]) <= room if c in near else x[c] == y[c]
        return F.when(x[c].isNull() & y[c].isNull(), 1.0).otherwise(F.coalesce(equal, F.lit(False)).cast("double"))

    def pair(x: Column, y: Column) -> Column:
        score = sum((same(x, y, c) for c in columns), F.lit(0.0)) / len(columns)
        return F.struct((-score).alias("less"), x["idx"].alias("i"), y["idx"].alias("j"))

    every = F.flatten(F.transform("_e", lambda x: F.transform("_a", lambda y: pair(x, y))))
    made = F.coalesce(F.array_sort(F.filter(every, lambda p: p["less"] < 0)), F.array().cast("array<struct<less:double,i:bigint,j:bigint>>"))
    zero = F.lit(0)
    found = met.select(*on, F.coalesce(F.size("_e"), zero).alias("n_expected"), F.coalesce(F.size("_a"), zero).alias("n_actual"), made.alias("_p"))
    return with_taken(found, "_p", "_t").select(*on, "n_expected", "n_actual", *_metrics(F.col("n_expected"), F.col("n_actual"), F.col("_t")))


def _read(rows: DataFrame, value: str, name: str, has_text: Column) -> DataFrame:
    """rows with what a value is when it is compared: kind, number, amount, boolean, and stripped text, day and key where
    has_text; each read once."""
    v = F.col(value)
    out = rows.withColumn(f"{name}_kind", v["kind"]).withColumn(f"{name}_n", V.as_number(v)).withColumn(f"{name}_b", v["b"]).withColumn(f"{name}_s", F.when(has_text, V.strip(V.as_text(v))))
    out = out.withColumn(f"{name}_m", F.when(v["kind"] == "string", V.read_number(v["s"])).otherwise(F.col(f"{name}_n")))
    return out.withColumn(f"{name}_d", V.as_date(F.col(f"{name}_s"))).withColumn(f"{name}_k", V.company_key(F.col(f"{name}_s")))


def _hits(path: Column, settings: Settings, use_fuzzy: bool) -> tuple[Column, Column]:
    """(exact, normalized) of values read as e and a: as `exact` and `matched`, with the kind from the path and the expected value."""
    e, a = (lambda c: F.col(f"e_{c}")), (lambda c: F.col(f"a_{c}"))
    none_e, none_a = e("kind").isNull(), a("kind").isNull()
    equal = F.when(e("kind") == "bool", e("b") == a("b")).when(e("kind") == "number", F.abs(e("n") - a("n")) <= 1e-9).otherwise(e("s") == a("s"))
    same = F.when(none_e & none_a, True).when(none_e | none_a, False).otherwise((e("kind") == a("kind")) & equal)
    room = F.greatest(F.lit(settings.money_abs_tolerance), F.lit(settings.money_pct_tolerance) * F.greatest(F.abs(e("m")), F.abs(a("m"))))
    dated = path.rlike(V.DATE_NAME) | e("d").isNotNull()
    is_money = e("kind") == "number"
    as_text = ~is_money & ~(dated & e("d").isNotNull() & a("d").isNotNull())
    ke, ka = (F.when(as_text & ~same, x("k")) for x in (e, a))
    text = fuzzy.ratio_at_least(ke, ka, settings.string_fuzzy_threshold) if use_fuzzy else ke == ka
    near = F.when(is_money, F.abs(e("m") - a("m")) <= room).when(as_text, text).otherwise(F.abs(F.datediff(e("d"), a("d"))) <= settings.date_tolerance_days)
    return same, F.when(same, True).when(none_e | none_a, False).otherwise(F.coalesce(near, F.lit(False)))


def _compared(v: Column, has_text: Column) -> Column:
    """What a cell is when it is compared: kind, number, amount; and stripped text, day and key if they may be asked for."""
    said = V.let(F.when(has_text, V.strip(V.as_text(v))), lambda s: F.struct(s.alias("s"), V.as_date(s).alias("d"), V.company_key(s).alias("k")))
    kind = F.when(v["kind"] == "string", 1).when(v["kind"] == "number", 2).when(v["kind"] == "bool", 3).otherwise(0)
    amount = F.when(v["kind"] == "string", V.read_number(v["s"])).otherwise(V.as_number(v))
    return F.struct(kind.alias("kind"), V.as_number(v).alias("n"), amount.alias("m"), F.when(has_text, said).alias("text"))


def _cells(lists: pa.ListArray) -> dict[str, np.ndarray | pa.Array]:
    """The fields of all cells of a batch's lists, in order; days as numbers, -1 and NaN for nothing."""
    values = lists.flatten()
    kind, n, m, text = values.flatten()
    s, d, k = text.flatten()
    plain = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return {"kind": kind.to_numpy(zero_copy_only=False), "n": plain(n), "m": plain(m), "s": s, "d": plain(d.cast(pa.int32())), "k": k}


def _coded(e: dict, a: dict, name: str) -> list:
    """The different texts of both sides; e's and a's become their places in it, -1 for null."""
    both = pa.concat_arrays([e[name], a[name]]).dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    e[name], a[name] = codes[: len(e[name])], codes[len(e[name]) :]
    return both.dictionary.to_pylist()


def _cell_hits(e: dict, a: dict, keys: list[str], settings: Settings, use_fuzzy: bool) -> np.ndarray:
    """Which cells match: as `_hits` has it, over pairs of cells. A pair of texts is compared once, however many cells have it."""
    there = (e["kind"] > 0) & (a["kind"] > 0)
    with np.errstate(invalid="ignore"):
        equal = np.where(e["kind"] == 1, (e["s"] == a["s"]) & (e["s"] >= 0), np.abs(e["n"] - a["n"]) <= np.where(e["kind"] == 2, 1e-9, 0))
        same = there & (e["kind"] == a["kind"]) & equal
        room = np.fmax(settings.money_abs_tolerance, settings.money_pct_tolerance * np.maximum(np.abs(e["m"]), np.abs(a["m"])))
        is_money, days = e["kind"] == 2, np.abs(e["d"] - a["d"])
        near = np.where(is_money, np.abs(e["m"] - a["m"]) <= room, days <= settings.date_tolerance_days)
    as_text = there & ~same & ~is_money & np.isnan(days) & (e["k"] >= 0) & (a["k"] >= 0)
    near[as_text] = e["k"][as_text] == a["k"][as_text]
    if use_fuzzy and as_text.any():
        at = np.flatnonzero(as_text & ~near)
        pairs, which = np.unique(e["k"][at] * len(keys) + a["k"][at], return_inverse=True)
        found = fuzzy.ratios_reach([keys[x] for x in pairs // len(keys)], [keys[x] for x in pairs % len(keys)], settings.string_fuzzy_threshold)
        near[at] = found[which]
    return same | (there & near) | ((e["kind"] == 0) & (a["kind"] == 0))


def _places(owner: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """A number for each different (owner, idx)."""
    order = np.lexsort((idx, owner))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (np.diff(owner[order]) != 0) | (np.diff(idx[order]) != 0)])) if len(order) else 0
    return out


def _with_matches(rows: DataFrame, settings: Settings, use_fuzzy: bool, cells_at_once: int = 1 << 21) -> DataFrame:
    """rows (.., n_columns, e, a, e_cells, a_cells) with `pairs` (i, j, score) taken best first, in place of the cells.

    Cells stand by row, then column. All collections of an Arrow batch are compared at once, in stretches of expected rows
    that have a bounded number of cells; of a stretch, only pairs that score are kept.
    """
    kind = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("e_cells", "a_cells")] + [T.StructField("pairs", kind)])

    def within(n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def matched_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        columns = of["n_columns"].to_numpy(zero_copy_only=False).astype(np.int64)
        size = {x: pc.list_value_length(of[x]).to_numpy(zero_copy_only=False).astype(np.int64) for x in "ea"}
        idx = {x: of[x].flatten().to_numpy(zero_copy_only=False) for x in "ea"}
        cells = {x: _cells(of[f"{x}_cells"]) for x in "ea"}
        _coded(cells["e"], cells["a"], "s")
        keys = _coded(cells["e"], cells["a"], "k")
        owner = np.repeat(np.arange(len(columns)), size["e"])
        place = {x: _places(np.repeat(np.arange(len(columns)), size[x]), idx[x]) for x in "ea"}
        repeated = any(len(place[x]) and place[x].max() + 1 < len(place[x]) for x in "ea")
        first = {x: np.cumsum(size[x]) - size[x] for x in "ea"}
        start = {x: np.cumsum(size[x] * columns) - size[x] * columns for x in "ea"}
        mates = np.where(columns[owner] > 0, size["a"][owner], 0)
        stretch = (np.cumsum(mates * columns[owner]) - 1) // cells_at_once
        parts = []
        for rows_at in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(stretch)) + 1):
            left = np.repeat(rows_at, mates[rows_at])
            on, to = owner[left], within(mates[rows_at])
            wide = columns[on]
            part = within(wide)
            x = np.repeat(start["e"][on] + (left - first["e"][on]) * wide, wide) + part
            y = np.repeat(start["a"][on] + to * wide, wide) + part
            if len(x):
                hit = _cell_hits({c: v[x] for c, v in cells["e"].items()}, {c: v[y] for c, v in cells["a"].items()}, keys, settings, use_fuzzy)
                score = np.add.reduceat(hit.astype(np.float64), np.cumsum(wide) - wide) / wide
                kept = np.flatnonzero((score > 0) | repeated)
                parts.append((left[kept], (first["a"][on] + to)[kept], score[kept]))
        left, right, score = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.array([], np.int64), np.array([], np.int64), np.array([]))
        if repeated:  # rows of one collection with the same idx are one row, which scores what they do on average
            _, at, which, n = np.unique(place["e"][left] * (len(place["a"]) + 1) + place["a"][right], return_index=True, return_inverse=True, return_counts=True)
            score = np.bincount(which, score, len(at)) / n
            left, right, score = (x[score > 0] for x in (left[at], right[at], score))
        order = np.lexsort((idx["a"][right], idx["e"][left], -score, owner[left]))
        at = order[taken_pairs(place["e"][left[order]], place["a"][right[order]])]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[left[at]], minlength=len(columns)))])
        taken = pa.StructArray.from_arrays([pa.array(idx["e"][left[at]], pa.int64()), pa.array(idx["a"][right[at]], pa.int64()), pa.array(score[at])], ["i", "j", "score"])
        of["pairs"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken)
        return pa.RecordBatch.from_arrays([of[f.name] for f in schema.fields], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(matched_batch, batches)

    return rows.mapInArrow(run, schema)


def scored_collections(expected: DataFrame, actual: DataFrame, on: str = "run_id", settings: Settings = DEFAULT, use_fuzzy: bool = True) -> DataFrame:
    """(on, collection, metrics, n_columns, pairs, missing, extra): every collection of every run, each with its own columns.

    expected, actual: on, collection, idx, cells map<string, value union>; idx is a row's own in its collection. A
    collection's columns are all that its expected rows have; a list of plain values has one. Cells are compared as fields
    are, so a pair's score is the share of its cells that match. pairs: (i, j, score) taken best first; missing, extra:
    rows without a partner. Rows of both sides travel once, to their collection; pairs are made there and never travel.
    """
    keys = [on, "collection"]
    row = F.struct(F.col("idx").cast("long").alias("idx"), "cells")
    known = " and ".join(f"`{k}` is not null" for k in keys)
    both = expected.select(*keys, row.alias("row"), F.lit(True).alias("wanted")).union(actual.where(known).select(*keys, row.alias("row"), F.lit(False).alias("wanted"))).where("row.idx is not null")
    listed = both.groupBy(*keys).agg(F.collect_list(F.when(F.col("wanted"), F.col("row"))).alias("_e"), F.collect_list(F.when(~F.col("wanted"), F.col("row"))).alias("_a")).where(F.size("_e") > 0)
    names = F.array_distinct(F.flatten(F.filter(F.transform("_e", lambda x: F.map_keys(x["cells"])), lambda k: k.isNotNull())))
    named = listed.withColumn("_names", names)
    # Numbers alone need no text: a column's cells are read as texts and days only if something else is expected in it.
    other = F.transform("_names", lambda c: F.exists("_e", lambda x: F.coalesce(F.try_element_at(x["cells"], c)["kind"] != "number", F.lit(False))))
    read = named.withColumn("_other", other)

    def cells(rows: str) -> Column:
        return F.flatten(F.transform(rows, lambda x: F.zip_with("_names", "_other", lambda c, t: V.let(F.try_element_at(x["cells"], c), lambda v: _compared(v, t)))))

    idx = lambda rows: F.transform(rows, lambda x: x["idx"])
    found = _with_matches(read.select(*keys, F.size("_names").alias("n_columns"), idx("_e").alias("e"), idx("_a").alias("a"), cells("_e").alias("e_cells"), cells("_a").alias("a_cells")), settings, use_fuzzy)
    whole = found.withColumn("e", F.sort_array(F.array_distinct("e"))).withColumn("a", F.sort_array(F.array_distinct("a")))
    return whole.select(
        *keys, F.size("e").alias("n_expected"), F.size("a").alias("n_actual"), *_metrics(F.size("e"), F.size("a"), F.col("pairs")),
        "n_columns", "pairs", F.array_except("e", F.transform("pairs", lambda p: p["i"])).alias("missing"),
        F.array_except("a", F.transform("pairs", lambda p: p["j"])).alias("extra"),
    )


def scored_runs(fields: DataFrame, expected: DataFrame, actual: DataFrame, on: str = "run_id", settings: Settings = DEFAULT, use_fuzzy: bool = True) -> DataFrame:
    """(on, exact, normalized, n_fields, collections, overall): golden scores of whole runs in one call.

    fields: on, path, expected, actual (value unions); how a field is compared follows from its path and expected value.
    The overall score is over all expected fields and cells alike: a missing row's cells count as wrong, rows that weren't
    asked for don't count. collections: a map of each collection's line_item_score.
    """
    worded = F.col("expected.kind") != "number"  # what is compared with a number is never compared as text or day
    one = _read(_read(fields, "expected", "e", worded), "actual", "a", worded).drop("expected", "actual")
    e, m = (x.cast("int") for x in _hits(F.col("path"), settings, use_fuzzy))
    scalars = one.withColumn("_e", e).withColumn("_m", m).groupBy(on).agg(F.avg("_e").alias("exact"), F.avg("_m").alias("normalized"), F.sum("_m").alias("right"), F.count("_e").alias("n_fields"))
    held = scored_collections(expected, actual, on, settings, use_fuzzy)
    right = F.aggregate("pairs", F.lit(0.0), lambda x, p: x + p["score"]) * F.col("n_columns")
    cells = held.groupBy(on).agg(
        F.sum(right).alias("cells_right"), F.sum(F.col("n_expected") * F.col("n_columns")).alias("cells"), F.map_from_entries(F.collect_list(F.struct("collection", "line_item_score"))).alias("collections"),
    )
    met, zero = scalars.join(cells, on, "full"), F.lit(0)
    overall = pooled(F.coalesce("right", zero), F.coalesce("n_fields", zero), F.coalesce("cells_right", F.lit(0.0)), F.coalesce("cells", zero))
    return met.select(
        on, F.round(F.coalesce("exact", F.lit(1.0)), 6).alias("exact"), F.round(F.coalesce("normalized", F.lit(1.0)), 6).alias("normalized"),
        F.coalesce("n_fields", zero).alias("n_fields"), "collections", overall.alias("overall"),
    )


def pooled(scalar_sum: Column, scalar_n: Column, cell_sum: Column, cell_n: Column) -> Column:
    """One score over scalar fields and expected cells; extra rows don't count against it."""
    return F.round(F.coalesce(F.try_divide(scalar_sum + cell_sum, scalar_n + cell_n), F.lit(1.0)), 6)
