import random

import numpy as np

from paperloom.llm import query_toxicity, toxicity

from .util import column, docs


def corpus(n, seed):
    """Insults count as toxic only together with a group: what no sum of word weights can tell."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"filler{rng.randrange(60)}" for _ in range(rng.randint(5, 25))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            w.insert(rng.randrange(len(w)), rng.choice(["Rotten", "vile,"]))
        if group:
            w.insert(rng.randrange(len(w)), rng.choice(["martians", "Venusians."]))
        out.append((i, " ".join(w), int(insult and group)))
    return out


def fitted(spark, rows):
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows], "doc_id long, toxic int, text string")
    return toxicity.fit(docs(spark, [(i, t) for i, t, _ in rows]), labels)


def test_learns_pairs_of_terms(spark):
    model = fitted(spark, corpus(1500, 1))
    fresh = corpus(500, 2)
    got = toxicity.scores(model, column([t for _, t, _ in fresh])) >= toxicity.THRESHOLD
    want = np.array([y for *_, y in fresh], bool)
    assert (got == want).mean() > 0.97


def test_odd_rows(spark):
    model = fitted(spark, corpus(400, 3))
    rows = [(1, None), (2, ""), (None, "vile martians"), (4, "vile martians"), (4, "vile martians"), (5, "x " * 50_000)]
    frame = docs(spark, rows)
    found = toxicity.score(frame, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.score for r in found}
    assert by[1] == by[2] < toxicity.THRESHOLD <= by[4] == by[None]
    out = toxicity.keep_clean(frame, model)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 5]


def test_labels_missing_alike_or_odd(spark):
    frame = docs(spark, [(1, "a"), (2, "b")])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(frame, toxicity.fit(frame, empty)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (2, None), (1, 5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(frame, toxicity.fit(frame, ones)).collect()} == {1.0}
    assert toxicity.score(docs(spark, []), toxicity.fit(frame, ones)).count() == 0


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = query_toxicity.run(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in both) / len(both) > 0.9


def neutral_pairs(n, seed):
    """Label 1 when two terms stand together or are both missing: neither tells anything alone."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"word{rng.randrange(4000)}" for _ in range(20)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        out.append((i, " ".join(w + ["aaa"] * a + ["bbb"] * b), int(a == b)))
    return out


def test_learns_terms_that_only_count_in_pairs(spark):
    model = fitted(spark, neutral_pairs(3000, 5))
    fresh = neutral_pairs(1000, 6)
    got = toxicity.scores(model, column([t for _, t, _ in fresh])) >= 0.5
    assert (got == np.array([y for *_, y in fresh], bool)).mean() > 0.95


def test_scores_are_the_sum_over_all_pairs(spark):
    model = fitted(spark, corpus(600, 7))
    slots, p = toxicity._arrays(model.uri)
    at = {int(s): i for i, s in enumerate(slots)}
    texts = [t for _, t, _ in corpus(40, 8)] + ["", "martians", "vile vile vile"]
    got = toxicity.scores(model, column(texts))
    for text, score in zip(texts, got, strict=True):
        known = sorted({at[s] for s in toxicity._terms(column([text]))[1].tolist() if s in at})
        z = model.bias + sum(float(p[i, 0]) for i in known)
        z += sum(float(p[i, 1:].astype(float) @ p[j, 1:].astype(float)) for i in known for j in known if i < j)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_repeated_rows_and_more_labels_than_are_used(spark):
    rows = corpus(300, 9)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 3, "doc_id long, toxic int")
    frame = docs(spark, [(i, t) for i, t, _ in rows] * 2)
    assert toxicity._learned_from(frame, labels, "doc_id", "text", "toxic", 1000).num_rows == 300
    assert toxicity._learned_from(frame, labels, "doc_id", "text", "toxic", 50).num_rows == 50
    assert 0 <= toxicity.score(frame, toxicity.fit(frame, labels, max_train=50)).first().score <= 1
