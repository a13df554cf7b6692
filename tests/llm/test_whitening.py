import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from paperloom.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<double>, x array<long>, again boolean, id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None, "i", 3) for i, v in rows], SCHEMA)


def whole(v):
    return [math.floor(64 * x) + 1_000_000 for x in v]


def check(found, rows, components=16):
    """Every column against exact sums and a decomposition of the exact covariance."""
    rows = [(i, whole(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    v = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    by_row = {}
    for r in found:
        assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-4 * r.explained and r.identity_error <= 1e-4
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    assert len(found) == len(rows) * k and len({r.identity_error for r in found}) == 1
    signs = np.zeros(k)
    for i, x in rows:
        y = [n * a - b for a, b in zip(x, s)]
        row = by_row[i, sum(a * a for a in y)]
        want = np.array([float(Fraction(a, n)) for a in y]) @ vectors[:, :k] / np.sqrt(values[:k])
        for c in range(k):
            got = row[c + 1][0]
            if not signs[c] and abs(want[c]) > 1e-3:
                signs[c] = np.sign(got * want[c])
            assert got == pytest.approx(signs[c] * want[c], rel=1e-6, abs=1e-6) or not signs[c]


def fixture(d=20, n=200):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + 3 * (k % 7)) for k in range(d)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(7, rows[3][1]), (None, rows[5][1])]
    bad = [None, [], [None] * d, [math.nan] * d, [*rows[0][1][:-1], math.inf], [*rows[0][1][:-1], 1e300]]
    return rows, [(5000 + i, v) for i, v in enumerate(bad)]


def test_against_exact_sums(spark):
    rows, bad = fixture()
    check(whitening.whiten(frame(spark, rows + bad)).collect(), rows)


def test_large_numbers_keep_their_digits(spark):
    """Means far above the deviations, and sums far beyond 64 bits."""
    rng = random.Random(8)
    rows = [(i, [1e12 + rng.random() * (k + 1) for k in range(5)]) for i in range(50)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    rows = [(i, [rng.random() * 1e12 for _ in range(3)]) for i in range(20)]
    assert all(r.deviation is None for r in whitening.whiten(frame(spark, rows)).collect())


def test_lengths_are_apart(spark):
    rows, _ = fixture()
    short = [(i, v[:4]) for i, v in rows[:40]]
    found = whitening.whiten(frame(spark, rows + [(i + 100_000, v) for i, v in short])).collect()
    check([r for r in found if r.vec_id is None or r.vec_id < 100_000], rows)
    check([r for r in found if r.vec_id is not None and r.vec_id >= 100_000], [(i + 100_000, v) for i, v in short])


def test_no_variance(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    assert {r.component for r in whitening.whiten(frame(spark, flat)).collect()} == {1}
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [math.nan])])).count() == 0


def test_remainders():
    rng = random.Random(1)
    for bits in (1, 20, 63, 64, 130):
        bound = 1 << bits
        some = whitening.primes(bound)
        for _ in range(50):
            x = rng.randint(-bound, bound)
            assert whitening.reconstructed([x % p for p in some], some) == x


def test_query(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    check(registry.queries()["op13_whitening"](spark, "/root/testdata/sf0.001").collect(), rows)
