import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import bpe, bpe_lexicon, lexicon, packing

from .util import column, docs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
TEXTS = ["", " ", "it's we'll 'tis ''s 's 'lll", "x\n\n y  \n z ", "a<|endoftext|>b", "aaaaaaaaa", "日本語 é١٢٣ 12ab3  !!x　a", "'re're", "\r\n\r\nq", "½¾ x²", "the same words the same words", "w" * 70_000]


def library_ids(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def own_ids(encoder, texts):
    ids, at = encoder.rows(column(texts))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_splits_and_merges_as_the_library():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab's tlred\n\t 1!'é日<|") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert own_ids(bpe.Encoder(bpe.vocabulary(VOCABULARY)), texts) == library_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_any_text(texts):
    assert own_ids(bpe.Encoder(bpe.vocabulary(VOCABULARY)), texts) == library_ids(texts)


def test_memory_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    encoder = bpe.Encoder(bpe.vocabulary(VOCABULARY))
    for texts in (TEXTS, TEXTS[::-1]):
        assert own_ids(encoder, texts) == library_ids(texts)


def test_automaton_is_minimal_and_exact():
    known = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"a", "é".encode()})
    arrays = lexicon.compiled(known) | {"flat": np.empty(0, np.int32), "offsets": np.zeros(1, np.int64)}
    held = lexicon.Lexicon(arrays)
    asked = [*known, b"ta", b"stopss", b"", b"z"]
    ends = np.cumsum([len(x) for x in asked])
    found = held.lookup(np.frombuffer(b"".join(asked), np.uint8), ends - [len(x) for x in asked], ends)
    assert found.tolist() == [*range(len(known)), -1, -1, -1, -1]
    assert len(arrays["final"]) == 8  # top, tap and stop share their endings
    empty = lexicon.Lexicon(lexicon.compiled([]) | {"flat": np.empty(0, np.int32), "offsets": np.zeros(1, np.int64)})
    assert empty.lookup(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


ROWS = [*enumerate(TEXTS), (None, "null id"), (99, None), (5, "aaaaaaaaa"), (5, "aaaaaaaaa")]


def test_round_trip_with_lexicon(spark):
    frame = docs(spark, ROWS)
    uri = bpe_lexicon.build(frame, VOCABULARY, share=1 / 500)
    encoded = bpe_lexicon.encode(frame, VOCABULARY, lexicon_uri=uri)
    got = sorted((str(r.doc_id), r.ids) for r in encoded.collect())
    assert got == sorted((str(i), ids) for (i, _), ids in zip(ROWS, library_ids([t or "" for _, t in ROWS])))
    assert sorted((str(r.doc_id), r.text) for r in bpe_lexicon.decode(encoded, VOCABULARY).collect()) == sorted((str(i), t or "") for i, t in ROWS)
    digest = {r.doc_id: r for r in bpe_lexicon.digests(frame, VOCABULARY, lexicon_uri=uri).collect()}
    ids = library_ids([TEXTS[6]])[0]
    assert digest[6].n_tokens == len(ids) and digest[6].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digest[6].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_lexicon.digests(docs(spark, []), VOCABULARY, lexicon_uri=bpe_lexicon.build(docs(spark, []), VOCABULARY)).count() == 0


def test_fullest_combination_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        space = rng.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= space}
        made = packing.fullest(counts, space)
        assert sum(length * n for length, n in made) == max(sums)
        assert all(n <= counts[length] for length, n in made)


@pytest.mark.parametrize("capacity", [8, 64])
def test_packing_is_whole_and_gapless(spark, capacity):
    rows = [*ROWS, *((200 + i, "word " * (i % 13)) for i in range(300))]
    found = packing.pack(docs(spark, rows).repartition(3), VOCABULARY, capacity=capacity, with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for (i, _), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        want.setdefault(i, []).append([*ids, 2])
    for i, lists in want.items():
        if len(lists) == 1:
            own = sorted(by_doc[i], key=lambda r: r.piece)
            assert [x for r in own for x in r.ids] == lists[0]
            assert all(r.length == capacity for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
    for members in by_bin.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in found) // capacity)
    assert least <= len(by_bin) <= 1.1 * least + 1


def test_packing_empty(spark):
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0
