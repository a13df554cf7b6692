from collections import defaultdict

from paperloom.llm import exact_dedup

from .util import docs

LONG = "word " * 60_000
ROWS = [(1, "a b"), (2, "a b"), (3, "a c"), (4, None), (5, ""), (None, "a b"), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "z"), (9, "z"), (9, "y"), (10, "é" * 300), (11, "é" * 299 + "e")]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(
        (str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""])) for i, t in rows
    )


def test_groups_equal_brute_force(spark):
    for bits in (64, 1 << 12):
        found = exact_dedup.duplicate_groups(docs(spark, ROWS), filter_bits=bits).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == expected(ROWS)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_full_hash_only_where_needed(spark):
    found = {r.doc_id: r.full_hash for r in exact_dedup.duplicate_groups(docs(spark, [(1, "a"), (2, "bb"), (3, "bb"), (4, "ccc")])).collect()}
    assert found[1] is None and found[4] is None and found[2] == found[3] is not None


def test_deduplicate_keeps_one_row_with_all_columns(spark):
    frame = docs(spark, ROWS)
    out = exact_dedup.deduplicate(frame)
    assert out.columns == frame.columns
    kept = sorted((r.doc_id, len(r.text or "")) for r in out.collect())
    assert kept == [(2, 3), (3, 3), (5, 0), (7, len(LONG)), (8, len(LONG) + 1), (9, 1), (9, 1), (10, 300), (11, 300)]


def test_empty_table(spark):
    assert exact_dedup.duplicate_groups(docs(spark, [])).count() == 0
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0
