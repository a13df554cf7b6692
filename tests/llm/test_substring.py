import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import fm_index, substring_dedup

from .util import column, docs, words


def brute(rows, n=20):
    last = (1 << 63) - 1
    places = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - n + 1):
            places.setdefault(tuple(w[s : s + n]), []).append((last if i is None else i, t, s))
    least = {k: min(x[0] for x in v) for k, v in places.items()}
    first = {}
    for k, v in places.items():
        for i, t, s in v:
            first[k, i, t] = min(s, first.get((k, i, t), s))
    out = []
    for i, t in rows:
        w, own = words(t), last if i is None else i
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if least[k] < own or first[k, own, t] < s:
                gone[s : s + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 50, 200)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [word() for _ in range(rng.randint(0, 30))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    rows += [(500, " ".join(passages[4] * 3)), (501, "x " * 30_000), (502, None), (503, ""), (None, rows[5][1]), (None, "n " * 25), (7, rows[7][1]), (7, rows[9][1])]
    return rows


@pytest.mark.parametrize("frequent", [64, 2])
def test_equals_brute_force(spark, frequent):
    rows = fixture()
    frame = docs(spark, rows).repartition(3)
    found = substring_dedup.digests(frame, substring_dedup.repeated_spans(frame, frequent=frequent)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute(rows)


def test_frequent_window_after_a_rare_one_goes_to_its_own_shard(spark):
    rng = random.Random(9)
    texts = [[f"v{rng.randrange(10**9)}" for _ in range(21)] for _ in range(6000)]
    anchor = substring_dedup.ANCHOR
    _, _, _, place, _ = substring_dedup._windows(column([" ".join(t) for t in texts]), 20, anchor)
    # The first window's anchor stands where the second window begins, the second's in its last words.
    hard = [t for t, (x, y) in zip(texts, (place.reshape(-1, 2) - 21 * np.arange(len(texts))[:, None]).tolist()) if (x, y) == (1, 21 - anchor)]
    assert len(hard) > 5
    many = [(100 * n + k, " ".join(t[1:])) for n, t in enumerate(hard) for k in range(6)]
    few = [(10**6 + 100 * n + k, " ".join([f"u{n}x{k}x{j}" for j in range(8)] + t)) for n, t in enumerate(hard) for k in range(2)]
    frame = docs(spark, many + few).repartition(16, F.col("doc_id") < 10**6)  # a task for each of both
    assert frame.select(F.spark_partition_id()).distinct().count() == 2
    found = substring_dedup.digests(frame, substring_dedup.repeated_spans(frame, frequent=4)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute(many + few)


def test_removal_keeps_columns_and_untouched_texts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    frame = docs(spark, [(2, f"x {passage}  y"), (1, f"{passage}\nz"), (3, "short  text"), (4, None)])
    out = substring_dedup.remove_repeats(frame)
    assert out.columns == frame.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{passage}\nz", 2: "x y", 3: "short  text", 4: None}


def test_empty_table(spark):
    assert substring_dedup.repeated_spans(docs(spark, [])).count() == 0
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(docs(spark, []), anchor=25)


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 37, 500)
    matrix = fm_index.WaveletMatrix(seq)
    symbols, places = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert matrix.rank(symbols, places)[0].tolist() == [int((seq[:p] == s).sum()) for s, p in zip(symbols, places)]
    for depth in (1, 2, 3, 5, 6):
        sizes = rng.integers(1, 60, 20)
        text = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
        ends = np.cumsum(sizes) - 1
        last = np.repeat(ends, sizes)
        index = fm_index.FMIndex(text, last, depth)
        at = np.flatnonzero(np.arange(len(text)) + depth - 1 <= last)
        matched, interval = index.matching(at)
        string = lambda p: tuple(text[p : p + depth])  # noqa: E731, B023
        count = {}
        for p in at:
            count[string(p)] = count.get(string(p), 0) + 1
        for p, m, i in zip(at, matched, interval):
            assert (m == depth) == (count[string(p)] > 1) == (i >= 0)
            ends = [string(p)[depth - n :] for n in range(1, depth + 1)]  # the last 1, 2, ... symbols, anywhere in the text
            often = [sum(last[q] - q >= len(e) - 1 and tuple(text[q : q + len(e)]) == e for q in range(len(text))) > 1 for e in ends]
            assert m == (often + [False]).index(False)
        groups = {}
        for p, i in zip(at, interval):
            if i >= 0:
                groups.setdefault(i, set()).add(string(p))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == sum(c > 1 for c in count.values())


def test_equal_windows_of_every_block_and_words_alike(spark):
    """One passage in all documents, each in a task's own block, and words that weak hashes take for equal."""
    from .test_words import thue_morse

    a, b = thue_morse(1024)
    passage = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([f"u{i}", *passage, f"v{i}"])) for i in range(60)]
    rows += [(100, " ".join([a, *passage[:19]])), (101, " ".join([b, *passage[:19]])), (102, " ".join([a, *passage[:19]]))]
    frame = docs(spark, rows).repartition(40)
    for frequent in (3, 4096):
        found = substring_dedup.digests(frame, substring_dedup.repeated_spans(frame, frequent=frequent)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute(rows)
