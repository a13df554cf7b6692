import math
import random

from pyspark.sql import functions as F

from paperloom.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, rank int")
    found = topk.top_k(frame.repartition(3), F.col("vec_id") % 50 == 0, **more).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 24), (1004, [float("inf")] * 24), (None, rows[0][1]), (1050, [1.0, 2.0]), (1051, [3.0, 4.0])]
    for options in ({}, {"dimension_block": 5, "row_block": 37, "query_block": 3}):
        assert run(spark, rows, **options) == brute(rows, 5, 50)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e12, -3.0]), (1, [1e12, 5.0]), (2, [1e12, 4.0]), (3, [-1e30, 1.0]), (4, [0.0, 0.0])]
    found = run(spark, rows)
    assert [x[2:] for x in found] == [(2, None), (1, None), (4, 0), (3, None)]


def test_texts_sort_as_their_numbers():
    some = [0, 1, -1, 9, 10, -10, -9, 10**30, -(10**30), 10**30 + 1, -(10**30) - 1, 2**63, -(2**63)]
    assert sorted(some, key=topk.sortable) == sorted(some)


def test_groups_of_queries_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    assert run(spark, rows, query_block=1) == brute(rows, 5, 50)


def test_fewer_rows_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
