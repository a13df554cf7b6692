"""The registered queries on the smallest tables: against SQL where there is some, else for whole results."""

import glob
import hashlib
import os
from collections import Counter

import duckdb
import pytest

from paperloom.llm import registry

from .test_substring import brute as repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    sql = registry.oracle_sql()[name]
    assert sorted(db.sql(sql).columns) == columns
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert Counter(map(str, map(tuple, frame.select(columns).collect()))) == Counter(map(str, want))


@pytest.mark.parametrize("name", ["op2_lm_score", "op3_toxicity", "op5_bpe", "op6_substring_dedup", "op9_jaccard_join"])
def test_one_row_for_each_document(spark, db, name):
    ids = [r.doc_id for r in registry.queries()[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == [x for (x,) in db.sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_substring_query(spark, db):
    rows = db.sql("SELECT doc_id, text FROM documents").fetchall()
    found = registry.queries()["op6_substring_dedup"](spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == repeats(rows)


def test_bpe_query(spark, db):
    from tokenizers import Tokenizer

    from paperloom.llm.query_bpe import VOCABULARY

    rows = db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    ids = [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch([t for _, t in rows], add_special_tokens=False)]
    want = sorted((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, t), x in zip(rows, ids))
    found = registry.queries()["op5_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == want


def test_packing_query(spark, db):
    """Every piece with its own ids, sequences without gaps, and as few of them as no packing can beat by more than one in a hundred."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from paperloom.llm.query_bpe import VOCABULARY

    whole, ids = Tokenizer.from_file(VOCABULARY), {}
    for i, t in db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids[i] = np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4")
    found = sorted(registry.queries()["op1_packing"](spark, SF).collect(), key=lambda r: (r.doc_id, r.piece))
    got, bins = {}, {}
    for r in found:
        before = got.setdefault(r.doc_id, [])
        assert r.start == sum(before) and r.piece == len(before) and 0 < r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        before.append(r.length)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sum(x) for i, x in got.items()} == {i: len(x) for i, x in ids.items()}
    assert all(n == 1024 for x in got.values() for n in x[1:])
    for places in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    assert len(bins) <= 1.01 * (sum(map(len, ids.values())) / 1024) + 1
