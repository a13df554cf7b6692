import hashlib
import random
import zlib

from paperloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, base long, key string, node string, rows long, `conv` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "n", 2, "c") for r in rows], SCHEMA)


def brute(rows):
    """Nodes from the definitions, one by one."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    original = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in turns.items()}
    paths = {}
    for c, own in original.items():
        base, h = c - int(c / 5) * 5, zlib.crc32(str(c).encode()) % 9
        paths[c] = own if base == 0 else original.get(c - base, [])[:h] + own[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    parents = {n[:-1] for n in members if n}
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below[node] if n)
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below[node]),
            sum(n not in parents for n in below[node]), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows):
    found = prefix_trie.trie(frame(spark, rows))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def fixture():
    rng, rows = random.Random(2), []
    for c in [*range(40), -3, -5, -7, 1004, 77777]:
        opening = rng.choice([[], [("system", "be kind")], [("system", "be kind"), ("user", "héllo")]])
        rest = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "é", None])) for _ in range(rng.randint(0, 12))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(opening + rest)]
    for c in range(100, 160):  # exact copies, of which a family's base lacks for 1004
        rows += [(c, t, "user", f"same {t}") for t in range(5)]
    rows += [(200, None, "user", "first"), (200, None, None, None), (200, 3, "user", "tie"), (200, 3, "user", "tie"), (200, 3, "assistant", "tie")]
    rows += [(None, 1, "user", "nobody's"), (9, 99, "user", "x" * 200_000)]
    rng.shuffle(rows)
    return rows


def test_equals_definition(spark):
    rows = fixture()
    assert got(spark, rows) == brute(rows)


def test_long_conversations_and_many_ends(spark, monkeypatch):
    """Conversations longer than a piece, their copies in other families and one in their own, and one turn that 300 have."""
    monkeypatch.setattr(prefix_trie.hot, "HOT_ROWS", 20)
    long = {10: 9000, 20: 9000, 30: 8995, 12: 8500}
    rows = [(c, t, "user", f"turn {t}") for c, n in long.items() for t in range(n)]
    rows += [(c, 0, "user", "hi") for c in range(100_000, 100_300)]
    found = {(r[0], r[1]): r for r in got(spark, rows)}
    size = [0, *(len(f"turn {t}") for t in range(9000))]
    for d in range(9001):
        n = sum(x >= d for x in long.values()) + 300 * (d == 0)
        saved = sum(size[e] * (sum(x >= e for x in long.values()) - 1) for e in range(max(1, d), 9001)) if d > 8400 else None
        ends = ",".join(str(c) for c in sorted(long) if long[c] == d)
        row = found.pop((10, d))
        assert row[2:6] == (10 if d else None, n, 1 + (d == 0) if d < 9000 else 0, 1 + (d == 0))
        assert row[6] == saved or d <= 8400
        assert row[7] == hashlib.sha256(ends.encode()).hexdigest()
    ends = ",".join(map(str, range(100_000, 100_300)))
    assert found == {(100_000, 1): (100_000, 1, 10, 300, 0, 1, 299 * 2, hashlib.sha256(ends.encode()).hexdigest())}


def test_turnless_conversation_is_at_the_root(spark):
    conv = next(c for c in range(1, 100) if c % 5 and prefix_trie.head_turns(c) > 1)
    rows = [(conv, 0, "user", "dropped")]
    assert got(spark, rows) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())] == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []


def test_head_turns():
    assert [prefix_trie.head_turns(c) for c in range(12)] == [zlib.crc32(str(c).encode()) % 9 for c in range(12)]
