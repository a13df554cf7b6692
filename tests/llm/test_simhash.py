import random

import duckdb
import numpy as np
import pytest
import xxhash

from paperloom.llm import registry, simhash

from .util import column, docs, words


def print_of(text, k=3):
    w = words(text, lower=True)
    some = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=2, k=3):
    prints = [print_of(t, k) for _, t in rows]
    distinct = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(distinct)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[:i] ^ distinct[i]) <= distance):
            parent[root(i)] = root(int(j))
    place = {int(x): i for i, x in enumerate(distinct)}
    least = {}
    for (name, _), p in zip(rows, prints):
        if name is not None:
            least[root(place[p])] = min(name, least.get(root(place[p]), name))
    return sorted((str(r[0]), f"{p:016x}", str(least.get(root(place[p])))) for r, p in zip(rows, prints))


def got(frame):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in frame.collect())


def fixture():
    rng = random.Random(5)
    texts = []
    for f in range(6):
        base = [f"{f}w{rng.randrange(80)}" for _ in range(400)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            texts.append(rng.choice([" ", "\t", "\n "]).join(w))
    texts += ["", None, " \t", "a", "A", "a b", "b a", "a b c", "a b c d", "É é", "é É", texts[0].upper(), "one two three " * 30_000]
    rng.shuffle(texts)
    return [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, "other"), (None, "only without an id")]


def test_hash_is_xxh64_at_every_length():
    data = bytes(random.Random(1).randrange(256) for _ in range(400))
    for n in [*range(80), 95, 96, 97, 200]:
        starts = np.array([0, 3, 7, 100])
        found = simhash.xxh64(np.frombuffer(data, np.uint8), starts, starts + n)
        assert found.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a in starts]


def test_fingerprints():
    texts = [t for _, t in fixture()]
    assert simhash.fingerprints(column(texts), 3).tolist() == [print_of(t) for t in texts]
    assert simhash.fingerprints(column([]), 3).tolist() == []


def test_components_equal_brute_force(spark):
    rows = fixture()
    assert got(simhash.link(docs(spark, rows))) == brute(rows)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_every_close_pair_shares_a_key(distance):
    rng = random.Random(distance)
    for blocks in simhash.rounds(distance)[:2]:
        keys = [m & simhash.words.MASK for m in simhash.masks(blocks, distance)]
        for _ in range(200):
            x, y = rng.getrandbits(64), 0
            for b in rng.sample(range(64), distance):
                y |= 1 << b
            assert any(x & m == (x ^ y) & m for m in keys)


def test_last_round_cannot_be_crowded():
    assert simhash.rounds(2) == [4, 8, 16]
    assert all(64 - (m & simhash.words.MASK).bit_count() <= 8 for m in simhash.masks(16, 2))


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """A dense ball of fingerprints goes to more blocks; chains outside it stay as they are."""
    rng = random.Random(9)
    center = rng.getrandbits(64)
    dense = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(900)}
    far = {rng.getrandbits(64) for _ in range(300)}
    chain = {rng.getrandbits(64) & ~0x3F}
    for _ in range(30):
        chain.add(max(chain) + 1)
    every = np.array(sorted(dense | far | chain), np.uint64)
    monkeypatch.setattr(simhash, "CHECKED", 20)
    monkeypatch.setattr(simhash.hot, "HOT_ROWS", 30)
    monkeypatch.setattr(simhash.hot, "HOT_KEYS", 3)
    frame = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    found = dict(simhash.components(simhash._links(frame, 2)).collect())
    label = {int(x): found.get(int(x), int(x)) for x in every.view(np.int64)}
    parent = np.arange(len(every))
    for i in range(len(every)):
        for j in np.flatnonzero(np.bitwise_count(every[:i] ^ every[i]) <= 2):
            parent[parent == parent[i]] = parent[j]
    groups = {}
    for x, p in zip(every.view(np.int64), parent):
        groups.setdefault(int(p), set()).add(int(x))
    assert all(len({label[x] for x in g}) == 1 for g in groups.values())
    assert len(set(label.values())) == len(groups)


def test_empty_table(spark):
    assert simhash.link(docs(spark, [])).count() == 0


def test_query(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert got(registry.queries()["op11_simhash"](spark, "/root/testdata/sf0.001")) == brute(rows)
