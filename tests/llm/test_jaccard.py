import itertools
import random

import duckdb
import numpy as np
import pytest

from paperloom.llm import components, jaccard_join, registry, words

from .util import column, docs
from .util import words as split


def sets(rows, k=5):
    out = []
    for _, t in rows:
        w = split(t, lower=True)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, percent=75):
    s, parent = sets(rows), list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if n and 100 * n >= percent * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return sorted((str(r[0]), len(s[i]), str(least.get(root(i)) if s[i] else r[0])) for i, r in enumerate(rows))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.random())
        out.append(" ".join(w))
    return out


def fixture():
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for f in range(4):
        texts += family(rng, [f"{f}w{rng.randrange(50)}" for _ in range(60)], 40, 6)
    texts += [" ".join(passage + [f"u{i}x{j}" for j in range(rng.randint(3, 200))]) for i in range(40)]
    texts += family(rng, passage, 30, 3) + ["A b C", "a B c", "a", "", "   ", None, texts[0], texts[0].upper(), "long " * 20_000]
    rng.shuffle(texts)
    return [*((i, t) for i, t in enumerate(texts)), (None, texts[0]), (3, texts[3]), (None, None)]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = fixture()
    for block, one_task in ((64, 1 << 20), (7, 0)):
        monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
        found = jaccard_join.link(docs(spark, rows), block=block).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


def test_boundary_of_similarity(spark):
    # 7 shingles of which 6 are common: 6 of 8 is 75 percent, which links; 5 common of 9 doesn't.
    w = [f"w{i}" for i in range(11)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:10], "x"])), (3, " ".join([*w[:9], "y", "z"]))]
    found = {r.doc_id: r.component_id for r in jaccard_join.link(docs(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_every_order_of_short_texts(spark):
    """Texts with fewer words than a shingle link only if they are the same sequence."""
    texts = [" ".join(t) for n in (1, 2, 3, 4) for t in itertools.product("ab", repeat=n)] + ["yes no no yes", "no yes yes no", "a A", "A b"]
    rows = list(enumerate(texts))
    found = jaccard_join.link(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)
    assert jaccard_join.deduplicate(docs(spark, rows)).count() == len({t.lower() for t in texts})


def test_query(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    found = registry.queries()["op9_jaccard_join"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


def test_long_shingles(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(200))), (2, " ".join(f"w{i}" for i in range(1, 200))), (3, "other")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs(spark, rows), k=100).collect()}
    assert found == {1: (101, 1), 2: (100, 1), 3: (1, 3)}


def test_deduplicate(spark):
    rows = [(4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (2, "other text"), (None, "a b c d e f"), (9, None), (8, "")]
    frame = docs(spark, rows)
    out = jaccard_join.deduplicate(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in out.select("doc_id", "text").collect() if r.text) == [(2, "a b c d e f"), (2, "other text")]
    assert out.count() == 4


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        some = [np.unique(np.where(rng.random(40) < 0.1, rng.integers(0, 1 << 63, 40, dtype=np.uint64), base)) for _ in range(30)]
        a, b = jaccard_join.Tree(some[:13], 256), jaccard_join.Tree(some[13:], 256)
        left, right, room = jaccard_join.dual_traversal(a, b, 75)
        got = {(int(a.order[i]), int(b.order[j])): int(r) for i, j, r in zip(left, right, room)}
        for i, x in enumerate(some[:13]):
            for j, y in enumerate(some[13:]):
                n = len(np.intersect1d(x, y))
                if 100 * n >= 75 * len(np.union1d(x, y)):
                    assert got[i, j] >= n


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(39, 200), (7, 7)]
    found = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in [*range(5, 40), 200]} == {5}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert jaccard_join.link(docs(spark, [])).count() == 0
    assert jaccard_join.deduplicate(docs(spark, [])).count() == 0


def test_words_are_split_at_the_six_white_bytes():
    texts = ["a\tb\x0bc d e f\r\ng", "", " x", "y "]
    h, first, starts, ends, data = words.hash_text(column(texts), True)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == [w for t in texts for w in split(t)]
    assert np.diff(first).tolist() == [len(split(t)) for t in texts]


def test_one_cluster_of_many_near_copies(spark, monkeypatch):
    """Far fewer pairs are checked than there are, and what only some members link to is found."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = family(rng, base, 3000, 2) + [" ".join(base[:100] + [f"t{i}x{j}" for j in range(18)]) for i in range(200)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 100)
    found = {r.doc_id: r.component_id for r in jaccard_join.link(docs(spark, rows), block=16).collect()}
    s = sets(rows)
    assert {found[i] for i in range(3000)} == {0}
    for i in range(3000, 3200):
        near = any(100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]) for j in range(3000))
        assert found[i] == (0 if near else min(j for j in range(3000, 3200) if found[j] == found[i]))
    checked = []
    real = jaccard_join.np.searchsorted
    names, own = list(range(500)), [np.sort(x) for x in jaccard_join.shingle_sets(column(texts[:500]), 5)]
    monkeypatch.setattr(jaccard_join.np, "searchsorted", lambda *a, **k: checked.append(1) or real(*a, **k))
    every = np.ones(500, bool)
    assert len(list(jaccard_join.links(names, own, every, every, 75))) == 499 and len(checked) < 1000
