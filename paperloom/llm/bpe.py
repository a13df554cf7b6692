"""Byte-level BPE on whole Arrow columns: splitting, merging and decoding, vectorised, for use in tasks.

The results are those of the tokenizers library for a byte-level BPE file with its usual splitting
pattern: contractions, then runs of letters, of numbers or of other signs with at most one space in
front, then white space. The vocabulary file is a parameter and is read where the work is.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from paperloom.llm import words

SPACE, LETTER, NUMBER, OTHER, EDGE = 0, 1, 2, 3, 9
#: The endings that the splitting pattern takes together with an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space as Unicode has it.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MEMO_WORDS, MEMO_BYTES = 1_000_000, 32 << 20
TABLE_BITS = 19


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


def split(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte positions at which a piece starts; pieces cover all bytes and never cross an edge."""
    if not len(data):
        return np.empty(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    if len(at) != len(data):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        for low, high, count, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            wide = np.flatnonzero((code >= low) & (code < high) & (data[at] >= low))
            value = code[wide] & mask
            for j in range(1, count + 1):
                value = (value << 6) | (padded[at[wide] + j] & 0x3F)
            code[wide] = value
    kind = classes()[code]
    first = np.zeros(len(kind) + 1, bool)
    first[np.searchsorted(at, edges)] = True
    first = first[:-1]
    first[0] = True
    before = np.concatenate([[EDGE], kind[:-1]]).astype(np.uint8)
    before[first] = EDGE
    after = np.concatenate([kind[1:], [EDGE]]).astype(np.uint8)
    after[np.flatnonzero(first)[1:] - 1] = EDGE
    blank_before = np.zeros(len(kind), bool)
    blank_before[1:] = code[:-1] == 0x20
    blank_before &= before != EDGE
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != EDGE)), (kind != before) & ~blank_before)
    quotes = np.flatnonzero((code == 0x27) & start & (before != OTHER) & (after == LETTER))
    if len(quotes):
        padded = np.concatenate([code, np.zeros(3, np.int32)])
        limit = np.concatenate([first, np.ones(3, bool)])
        done = np.zeros(len(quotes), bool)
        for ending in CONTRACTIONS:
            fits = ~done
            for j, c in enumerate(ending, 1):
                fits &= (padded[quotes + j] == ord(c)) & ~limit[quotes + j]
            hit = quotes[fits]
            done |= fits
            start[hit + 1] = False
            stop = hit + 1 + len(ending)
            stop = stop[stop < len(kind)]
            start[stop[(kind[stop] == LETTER)]] = True
    return at[start].astype(np.int64)


class Vocabulary:
    """A byte-level BPE file: ids of bytes, merges by pair, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        # Printable Latin-1 characters stand for themselves, the other bytes for 256 and on, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
        vocab = read["model"]["vocab"]
        self.bytes = np.empty(max(vocab.values()) + 1 + len(read["added_tokens"]), object)
        self.bytes[:] = b""
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        for text, n in vocab.items():
            self.bytes[n] = text.encode() if text in special else bytes(to_byte[c] for c in text)
        for text, n in special.items():
            self.bytes[n] = text.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"]]
        keys = np.array([(vocab[a] << 24) | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Ranks by pair in an open hash table: the slot after a taken one, and so on.
        self.table, self.ranks = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
        rank, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(rank):
            _, first = np.unique(slot, return_index=True)
            first = first[self.table[slot[first]] == -1]
            self.table[slot[first]], self.ranks[slot[first]] = keys[rank[first]], rank[first]
            left = np.ones(len(rank), bool)
            left[first] = False
            rank, slot = rank[left], (slot[left] + 1) & (len(self.table) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges for a pair that has none."""
        none = np.int32(len(self.merged))
        slot = self._slot(keys)
        held = self.table[slot]
        out = np.where(held == keys, self.ranks[slot], none)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.table) - 1)
            held = self.table[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            more = ~hit & (held != -1)
            open_, slot = open_[more], slot[more]
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte ranges end to end, and the offsets of each: lowest rank first, all words at once."""
        lengths = (ends - starts).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
        symbols = self.byte_ids[data[at]]
        word = np.repeat(np.arange(len(starts)), lengths)
        done_symbols, done_word = [], []
        none = np.int32(len(self.merged))
        while len(symbols):
            pair = (symbols[:-1].astype(np.int64) << 24) | symbols[1:]
            rank = np.append(np.where(word[:-1] == word[1:], self.rank_of(pair), none), none)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(heads, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, heads), counts)
            over = least == none
            if over.any():
                done_symbols.append(symbols[over])
                done_word.append(word[over])
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
                if not len(symbols):
                    break
            hit = rank == least
            # Of pairs that overlap, as in a run of one letter, every second one merges.
            lead = hit & ~np.concatenate([[False], hit[:-1]])
            places = np.arange(len(hit))
            hit &= (places - np.maximum.accumulate(np.where(lead, places, 0))) % 2 == 0
            where = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[where] = self.merged[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_word:
            return np.empty(0, np.int32), np.zeros(len(starts) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(starts))
        return symbols[order], np.concatenate([[0], np.cumsum(counts)])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """The pieces of a block of rows: distinct ones and which stands where."""

    def __init__(self, column, special: dict[bytes, int]):
        data, offsets = words.buffers(column)
        self.data, edges, marks = data, offsets, []
        for token in special:
            whole = data.tobytes() if len(data) else b""
            at = whole.find(token)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right"):
                    marks.append((at, at + len(token)))
                at = whole.find(token, at + len(token))
        if marks:
            edges = np.unique(np.concatenate([offsets, np.array(marks).ravel()]))
        self.starts = split(data, edges[edges < len(data)])
        for start, end in marks:
            inside = (self.starts > start) & (self.starts < end)
            self.starts = self.starts[~inside]
        self.ends = np.append(self.starts[1:], len(data))
        self.rows = np.searchsorted(self.starts, offsets)
        h = words.hashes(data, self.starts, self.ends)
        self.hashes, self.first, self.inverse, self.counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        own = self.first[self.inverse]
        equal = words.same(data, self.starts, self.ends, data, self.starts[own], self.ends[own])
        if not equal.all():
            self._tell_apart(np.flatnonzero(~equal))

    def _tell_apart(self, which: np.ndarray) -> None:
        """Give pieces whose hash is another piece's, but whose bytes aren't, entries of their own."""
        entry: dict[bytes, int] = {}
        for i in which:
            piece = self.data[self.starts[i] : self.ends[i]].tobytes()
            if piece not in entry:
                entry[piece] = len(self.first)
                self.hashes = np.append(self.hashes, self.hashes[self.inverse[i]])
                self.first, self.counts = np.append(self.first, i), np.append(self.counts, 0)
            self.counts[self.inverse[i]] -= 1
            self.inverse[i] = entry[piece]
            self.counts[entry[piece]] += 1


def expand(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists (flat, offsets) chosen by `which` end to end, and their offsets."""
    lengths = np.diff(offsets)[which]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.repeat(offsets[which] - out[:-1], lengths) + np.arange(out[-1])], out


class Encoder:
    """Ids of pieces, from a lexicon where it has them, else by merging; new ones are remembered.

    The memory is limited to MEMO_WORDS pieces and MEMO_BYTES bytes and starts afresh when it is full; that
    changes no result. A hash only finds an entry: its bytes then have to be those of the piece.
    """

    def __init__(self, vocab: Vocabulary, lexicon=None):
        self.vocab, self.lexicon = vocab, lexicon
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.flat, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.spelled, self.edges = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def _same(self, pieces: Pieces, which: np.ndarray, entry: np.ndarray) -> np.ndarray:
        first = pieces.first[which]
        return words.same(pieces.data, pieces.starts[first], pieces.ends[first], self.spelled, self.edges[entry], self.edges[entry + 1])

    def _merge_new(self, pieces: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = pieces.starts[pieces.first[which]], pieces.ends[pieces.first[which]]
        flat, offsets = self.vocab.merge(pieces.data, start, end)
        for token, n in self.vocab.special.items():
            for i in np.flatnonzero(end - start == len(token)):
                if pieces.data[start[i] : end[i]].tobytes() == token and len(token) > 1:
                    counts = np.diff(offsets)
                    flat = np.concatenate([flat[: offsets[i]], np.array([n], np.int32), flat[offsets[i + 1] :]])
                    counts[i] = 1
                    offsets = np.concatenate([[0], np.cumsum(counts)])
        return flat, offsets

    def ids(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(flat, offsets): the ids of each distinct piece."""
        n = len(pieces.hashes)
        flats, sizes, source = [], np.zeros(n, np.int64), np.full(n, -1, np.int64)
        open_ = np.arange(n)
        if self.lexicon is not None:
            index = self.lexicon.lookup(pieces.data, pieces.starts[pieces.first], pieces.ends[pieces.first])
            found = np.flatnonzero(index >= 0)
            lex_flat, lex_offsets = expand(self.lexicon.flat, self.lexicon.offsets, index[found])
            flats.append((found, lex_flat, lex_offsets))
            open_ = np.flatnonzero(index < 0)
        slot = np.minimum(np.searchsorted(self.known, pieces.hashes[open_]), max(0, len(self.known) - 1))
        seen = np.zeros(len(open_), bool)
        if len(self.known):
            at = np.flatnonzero(self.known[slot] == pieces.hashes[open_])
            seen[at[self._same(pieces, open_[at], self.place[slot[at]])]] = True
        old, new = open_[seen], open_[~seen]
        if len(old):
            flats.append((old, *expand(self.flat, self.offsets, self.place[slot[seen]])))
        if len(new):
            flat, offsets = self._merge_new(pieces, new)
            flats.append((new, flat, offsets))
            first = pieces.first[new]
            length = pieces.ends[first] - pieces.starts[first]
            if len(self.known) + len(new) > MEMO_WORDS or len(self.spelled) + length.sum() > MEMO_BYTES:
                self._forget()
            base = len(self.offsets) - 1
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(length)])
            self.spelled = np.concatenate([self.spelled, pieces.data[np.repeat(pieces.starts[first] - np.cumsum(length) + length, length) + np.arange(length.sum())]])
            self.flat = np.concatenate([self.flat, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            known = np.concatenate([self.known, pieces.hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], np.concatenate([self.place, base + np.arange(len(new))])[order]
        total, start = np.empty(0, np.int32), 0
        for which, flat, offsets in flats:
            sizes[which] = np.diff(offsets)
            source[which] = start + offsets[:-1]
            start += len(flat)
        total = np.concatenate([f for _, f, _ in flats]) if flats else total
        out = np.concatenate([[0], np.cumsum(sizes)])
        return total[np.repeat(source - out[:-1], sizes) + np.arange(out[-1])], out

    def rows(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of an Arrow text column end to end, and the offsets of the rows."""
        pieces = Pieces(column, self.vocab.special)
        flat, offsets = self.ids(pieces)
        ids, at = expand(flat, offsets, pieces.inverse)
        return ids, at[pieces.rows]
