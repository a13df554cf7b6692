import collections
import math
import random

import numpy as np
import pytest

from paperloom.llm import gram_store, kneser_ney, packed

from .util import docs, words

END = "\n"


def brute(train, rows, order):
    """A plain interpolated modified Kneser-Ney model: raw counts on top, continuation counts below."""
    split = lambda t: [*words(t, lower=True), END]
    tokens = [split(t) for _, t in train]
    c = collections.Counter(w for t in tokens for w in t)
    n, v = sum(c.values()), len(c)

    def grams(t, k):
        padded = [END] * (order - 1) + t
        return [tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded))]

    counts = {order: collections.Counter(g for t in tokens for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, held in counts.items():
        t = collections.Counter(held.values())
        cuts[k] = [0.0, *kneser_ney._discounts(np.array([t[x] for x in (1, 2, 3, 4)]))]
    context = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, held in counts.items():
        for g, x in held.items():
            context[k][g[:-1]][min(x, 3) - 1] += 1
            context[k][g[:-1]][3] += x

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (v + 1) if v else 1.0
        if g[:-1] not in context[k]:
            return lower
        x, seen = context[k][g[:-1]], counts[k].get(g, 0)
        return (seen - cuts[k][min(seen, 3)]) / x[3] + sum(cuts[k][j + 1] * x[j] for j in range(3)) / x[3] * lower

    out = []
    for i, t in rows:
        s = split(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        out.append((str(i), len(s), sum(w in c for w in s), base, sum(math.log10(p(g)) for g in grams(s, order))))
    some = tuple(["cat", "the"] * order)[: order - 1]
    return sorted(out), sum(p((*some, w)) for w in [*c, "never seen"])


def check(spark, train, rows, order):
    model = kneser_ney.train(docs(spark, train), order=order)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser_ney.score(docs(spark, rows), model).collect())
    want, total = brute(train, rows, order)
    assert abs(total - 1) < 1e-9
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "FLUSH", 500)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("the cat sat on a mat and The dog ran far away é x1 x2 x3".split()) for _ in range(rng.randint(0, 30)))
    train = [(i, text()) for i in range(80)] + [(100, None), (101, ""), (None, "the cat"), (5, "the cat"), (5, "the cat")]
    rows = [*train, (200, "never seen words at all"), (201, "the " * 20_000), (202, None)]
    check(spark, train, rows, order)


@pytest.mark.parametrize("order", [2, 3])
def test_small_and_empty_training(spark, order):
    check(spark, [(1, "a")], [(1, "a"), (2, "b"), (3, None)], order)
    check(spark, [], [(2, "b c"), (3, None)], order)
    assert kneser_ney.score(docs(spark, []), kneser_ney.train(docs(spark, [(1, "a b")]))).count() == 0


def test_learns_more_than_word_counts(spark):
    rows = [(i, "one two three four five six " * 5) for i in range(30)]
    model = kneser_ney.train(docs(spark, rows))
    one = kneser_ney.score(docs(spark, rows[:1]), model).first()
    assert one.score > one.base_score / 3 and one.perplexity < 2


def test_held_out_rule(spark):
    import zlib

    found = spark.range(200).select("id", kneser_ney.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 10 == 0) for r in found)
    assert spark.sql("select cast(null as long) id").select(kneser_ney.held_out("id")).first()[0] is True


def test_packed_numbers():
    for values in ([0], [1, 255, 256, 1 << 40], [], [5] * 1000):
        assert packed.wide(packed.narrow(np.array(values, np.int64))).tolist() == values
    counter = packed.Counter(10)
    for part in ([3, 1, 3], [1], list(range(20))):
        counter.add(np.array(part))
    keys, counts = counter.take()
    want = collections.Counter([3, 1, 3, 1, *range(20)])
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(want)


def test_stores_find_what_they_hold(spark, tmp_path):
    rng = np.random.default_rng(2)
    for size in (0, 1, 7, 5000):
        h = rng.integers(0, 1 << 62, size, dtype=np.uint64)  # all in bucket 0 of two bits
        n = rng.integers(1, 400, size)
        uri = f"file://{tmp_path}/{size}"
        (tmp_path / str(size)).mkdir()
        gram_store.save(uri, 0, 2, h, {"count": n, "twice": 2 * n})
        store = gram_store.Store(uri, 2, ("count", "twice"))
        other = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        count, twice = store.find(np.concatenate([h, other]))
        assert np.array_equal(count[:size], n) and np.array_equal(twice[:size], 2 * n) and not count[size:].any()
    columns = [rng.integers(0, 3, 500) for _ in range(3)]
    some, counts = gram_store.merged(columns, np.ones(500, np.int64))
    assert dict(zip(zip(*(c.tolist() for c in some)), counts.tolist())) == collections.Counter(zip(*(c.tolist() for c in columns)))
    for arrays in ([np.arange(5), np.array([1 << 40])], [np.empty(0, np.int64)]):
        assert [x.tolist() for x in gram_store.unsqueeze(gram_store.squeeze(arrays))] == [x.tolist() for x in arrays]
