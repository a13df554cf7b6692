"""Interval joins, greedy alignment and scoring against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators import documents as D
from paperloom.operators import evaluation as E


def test_intervals_equal_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 5, 63, 64, 65, 700, 40_000])) for i in range(n) for s in [rng.randrange(0, 3000)]]
    left, right = make(120) + [(900, "a", None, 5), (901, "a", 9, 3), (902, "c", 0, 9)], make(120) + [(903, None, 0, 9)]
    l = spark.createDataFrame(left, "i int, k string, ls long, le long")  # noqa: E741
    r = spark.createDataFrame(right, "j int, k string, rs long, re long")
    for least, step in ((64, 8), (1, 2), (100_000, 2)):
        found = D.interval_pairs(l, r, ["k"], ("ls", "le"), ("rs", "re"), least, step).select("i", "j", "inside").collect()
        want = {}
        for i, k, a, b in left:
            for j, q, c, d in right:
                if k == q and None not in (k, a, b) and a <= b and a < d and b > c:
                    in_r, in_l = c <= a and b <= d, a <= c and d <= b
                    want[i, j] = "both" if in_r and in_l else "left" if in_r else "right" if in_l else None
        assert len(found) == len(want) and {(x.i, x.j): x.inside for x in found} == want
    assert D.interval_pairs(l.limit(0), r, ["k"], ("ls", "le"), ("rs", "re")).count() == 0


def test_a_document_of_many_intervals_makes_no_product(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 100).alias("s"), (F.col("id") * 100 + 50).alias("e"))
    other = rows.select("k", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    assert D.interval_pairs(rows, other, ["k"], ("s", "e"), ("s2", "e2")).count() == 20_000


def greedy(pairs):
    left, right, out = set(), set(), []
    for score, i, j in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j, score))
    return sorted(out)


def test_greedy_in_rounds_equals_one_by_one(spark):
    rng = random.Random(1)
    lists = [[(rng.choice([0.25, 0.5, 1.0]), i, j) for i in range(rng.randint(0, 8)) for j in range(rng.randint(0, 8)) if rng.random() < 0.6] for _ in range(60)]
    rows = [(n, sorted((-s, i, j) for s, i, j in one)) for n, one in enumerate(lists)]
    frame = spark.createDataFrame(rows, "n int, p array<struct<less:double,i:bigint,j:bigint>>")
    found = {r.n: sorted((x.i, x.j, x.score) for x in r.t) for r in E.with_taken(frame, "p", "t").collect()}
    assert found == {n: greedy(one) for n, one in enumerate(lists)}
    assert len(E.taken_pairs(np.array([], int), np.array([], int))) == 0


def _cells(rows):
    return [(r, c, i, {k: (("string", v, None, None) if isinstance(v, str) else ("number", None, float(v), None) if v is not None else None) for k, v in cells.items()}) for r, c, i, cells in rows]


def test_collections_with_typos_and_missing_rows(spark):
    kind = f"run_id int, collection string, idx int, cells map<string,{V.VALUE}>"
    expected = [(1, "items", 0, {"desc": "hexagon bolt", "amount": 10}), (1, "items", 1, {"desc": "washer", "amount": 5}), (1, "items", 2, {"desc": "gone", "amount": 1}), (1, "tags", 0, {"tags": "alpha"}), (2, "items", 0, {"desc": None})]
    actual = [(1, "items", 7, {"desc": "washers", "amount": 5.005}), (1, "items", 8, {"desc": "hexagon bolts", "amount": 99}), (1, "items", 9, {"desc": "zzz", "amount": 77, "more": 1}), (1, "tags", 0, {"tags": "ALPHA"}), (3, "items", 0, {"desc": "x"})]
    e, a = spark.createDataFrame(_cells(expected), kind), spark.createDataFrame(_cells(actual), kind)
    found = {(r.run_id, r.collection): r for r in E.scored_collections(e, a).collect()}
    items = found[1, "items"]
    assert [(p.i, p.j, p.score) for p in items.pairs] == [(0, 8, 0.5), (1, 7, 1.0)] or sorted((p.i, p.j, p.score) for p in items.pairs) == [(0, 8, 0.5), (1, 7, 1.0)]
    assert (items.missing, items.extra, items.n_columns, items.cell_accuracy) == ([2], [9], 2, 0.75)
    assert (items.row_precision, items.row_recall, items.line_item_score) == (0.666667, 0.666667, 0.5)
    assert found[1, "tags"].line_item_score == 1.0 and set(found) == {(1, "items"), (1, "tags"), (2, "items")}
    assert (found[2, "items"].matched, found[2, "items"].missing) == (0, [0])
    text, number = (lambda v: ("string", v, None, None)), (lambda v: ("number", None, v, None))
    fields = [(1, "vendor", text("Acme Industries"), text("Acme Industrie")), (1, "total", number(135.0), text("$135.00")), (1, "due_date", text("2026-04-02"), text("2026-04-03")), (1, "code", text("a"), None), (4, "x", None, None)]
    frame = spark.createDataFrame(fields, f"run_id int, path string, expected {V.VALUE}, actual {V.VALUE}")
    runs = {r.run_id: r for r in E.scored_runs(frame, e, a).collect()}
    assert (runs[1].exact, runs[1].normalized, runs[1].n_fields) == (0.0, 0.5, 4)
    assert runs[1].overall == round((2 + 0.75 * 2 * 2 + 1) / (4 + 6 + 1), 6)
    assert (runs[2].overall, runs[4].overall, runs[2].exact) == (0.0, 1.0, 1.0)


def test_boxes_equal_the_quadratic_version():
    from paperloom.operators import pages as P

    rng = np.random.default_rng(7)
    for _ in range(30):
        n, pages = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        owner = np.sort(rng.integers(0, pages, n))
        start = rng.integers(0, 60, (n, 2)).astype(float)
        boxes = np.concatenate([start, start + rng.integers(0, 30, (n, 2)) * rng.choice([0.1, 1, 10])], axis=1)
        scores = np.round(rng.random(n), 1)
        want = []
        for page in range(pages):
            kept = []
            for i in sorted(np.flatnonzero(owner == page), key=lambda i: (-scores[i], i)):
                if scores[i] < 0.3:
                    continue
                area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
                inside = [max(0.0, min(boxes[i, 2], boxes[j, 2]) - max(boxes[i, 0], boxes[j, 0])) * max(0.0, min(boxes[i, 3], boxes[j, 3]) - max(boxes[i, 1], boxes[j, 1])) for j in kept]
                if not any(c > 0.4 * (area(boxes[i]) + area(boxes[j]) - c) for c, j in zip(inside, kept)):
                    kept.append(int(i))
            want += kept
        assert P.best_boxes(owner, boxes, scores, 0.3, 0.4).tolist() == want


def test_fractional_seconds_are_taken_as_in_sql(spark, tmp_path):
    """Stretches of time begin at the nearest second, a half at the even one, as the query's SQL has them."""
    import datetime

    import duckdb

    import __spark_entry__ as entry

    at = lambda second, micros: datetime.datetime(2024, 1, 1, 0, 0, second, micros)
    rows = [(1, 1, at(10, 600_000), 0.02), (2, 1, at(5, 400_000), 0.02), (3, 1, at(16, 500_000), 0.01), (4, 1, at(19, 100_000), 0.01), (5, 1, at(11, 500_000), 0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    columns = ["event_id", "overlapped", "inside", "holds"]
    found = {tuple(r) for r in entry.queries()["interval_containment"](spark, str(tmp_path)).select(columns).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert found == set(con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['interval_containment']})").fetchall()) and found
