import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperloom.llm import bpe, jaccard_join, kneser_ney, words

from .util import column

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    """Two words of two letters each that polynomial hashes modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n)]


def spans(texts):
    data, offsets = words.buffers(column(texts))
    return data, offsets[:-1], offsets[1:]


def test_hashes_tell_words_apart_whatever_their_pattern():
    ascending = ["x" * n for n in range(1, 70)]
    asked = [*PAIRS, *ascending, "a\0", "a", "a\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi"]
    assert len(np.unique(words.hashes(*spans(asked)))) == len(asked)
    whole = words.hashes(*spans(asked))
    data, starts, ends = spans(["padding " + x + "tail" for x in asked])
    assert np.array_equal(words.hashes(data, starts + 8, ends - 4), whole)  # the place doesn't matter


def test_same_compares_bytes():
    a, b = ["", "abc", "abcdefgh", "abcdefghi", "abcdefghij" * 9], ["", "abd", "abcdefgh", "abcdefghj", "abcdefghij" * 9]
    assert words.same(*spans(a), *spans(b)).tolist() == [True, False, True, False, True]
    assert words.same(*spans(["abc", "abcdefghij"]), *spans(["ab", "abcdefghi"])).tolist() == [False, False]


def test_operators_tell_such_words_apart():
    a, b = PAIRS[:2]
    library = Tokenizer.from_file(VOCABULARY)
    ids, at = bpe.Encoder(bpe.vocabulary(VOCABULARY)).rows(column(PAIRS))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [x.ids for x in library.encode_batch(PAIRS, add_special_tokens=False)]
    one, other = jaccard_join.shingle_sets(column([f"{a} b c d e", f"{b} b c d e"]), 5)
    assert not np.intersect1d(one, other).size
    assert len(np.unique(kneser_ney._tokens(column([" ".join(PAIRS)]))[0])) == len(PAIRS) + 1


def test_encoder_survives_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(words, "hashes", lambda data, starts, ends: (data[starts] % 3).astype(np.uint64))
    library, encoder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.vocabulary(VOCABULARY))
    for texts in (["some words that share a hash, some of them twice", "and others"], ["others that share words"], PAIRS[:2]):
        ids, at = encoder.rows(column(texts))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
