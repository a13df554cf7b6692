"""A compressed full-text index of number sequences: Burrows-Wheeler transform in a wavelet matrix.

Suffixes are ordered by their first `depth` symbols, which is as long as patterns are. All queries of a
batch are searched at once; each step of the backward search is one rank in each level of the matrix.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2**levels, in one bit for each level and position."""

    def __init__(self, sequence: np.ndarray):
        self.levels = max(1, int(sequence.max(initial=0)).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        pad = -len(sequence) % 64 + 64
        now = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(pad, np.uint8)]), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum(dtype=np.int64)))
            set_ = bit.astype(bool)
            now = np.concatenate([now[~set_], now[set_]])
        self.start = np.zeros((1 << self.levels) + 1, np.int32)  # where each symbol's run begins at the end
        heads = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]])) if len(now) else np.empty(0, np.int64)
        self.start[now[heads]] = heads

    def rank(self, symbols: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each position."""
        found = [p.astype(np.int64) for p in positions]
        for n in range(self.levels):
            one = ((symbols >> (self.levels - 1 - n)) & 1).astype(bool)
            bits, ones, zeros = self.bits[n], self.ones[n], self.zeros[n]
            for i, p in enumerate(found):
                word = p >> 6
                mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
                before = ones[word] + np.bitwise_count(bits[word] & mask)
                found[i] = np.where(one, zeros + before, p - before)
        return [p - self.start[symbols] for p in found]


class FMIndex:
    """Index of symbols of several sequences end to end; `last` is the last position of each position's sequence."""

    def __init__(self, symbols: np.ndarray, last: np.ndarray, depth: int):
        distinct, code = np.unique(symbols, return_inverse=True)
        self.code, self.depth = (code + 1).astype(np.int32), depth  # 0: no symbol
        n, sigma = len(symbols), len(distinct) + 1
        place = np.arange(n)

        def followed(left: np.ndarray, width: int, right: np.ndarray) -> np.ndarray:
            """Ranks of the strings of which `left` ranks the first `width` symbols and `right` the next ones."""
            after = np.zeros(n, np.int64)
            inside = place + width <= last
            after[inside] = right[place[inside] + width]
            return np.unique(left * (int(right.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1

        # Strings of 1, 2, 4, ... symbols are ranked from those of half the length, and `depth` is put together.
        power, width, whole, so_far, rest = self.code.astype(np.int64), 1, None, 0, depth
        while rest:
            if rest & 1:
                whole = power if whole is None else followed(whole, so_far, power)
                so_far += width
            rest >>= 1
            if rest:
                power, width = followed(power, width, power), width * 2
        self.string = whole  # equal where the next `depth` symbols are
        order = np.argsort(whole, kind="stable")
        begins = np.concatenate([[0], np.flatnonzero(np.diff(last)) + 1]) if n else np.empty(0, np.int64)
        first = np.repeat(begins, np.diff(np.append(begins, n)))
        self.matrix = WaveletMatrix(np.where(order - 1 >= first[order], self.code[np.maximum(order - 1, 0)], 0))
        self.heads = np.concatenate([[0], np.cumsum(np.bincount(self.code, minlength=sigma))])
        # Suffixes of one symbol stand first among those that begin with it, and no suffix follows them.
        self.ended = np.bincount(self.code[place == last], minlength=sigma)

    def matching(self, positions: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the `depth` symbols from each position on: how many of the last of them
        occur, as a string, `least` times or more, and (where all do) the first rank of their interval, else -1."""
        matched = np.zeros(len(positions), np.int32)
        interval = np.full(len(positions), -1, np.int64)
        live = np.arange(len(positions))
        symbol = self.code[positions + self.depth - 1]
        low, high = self.heads[symbol], self.heads[symbol + 1]
        for step in range(self.depth):
            if step:
                symbol = self.code[positions[live] + self.depth - 1 - step]
                low, high = self.matrix.rank(symbol, low, high)
                begin = self.heads[symbol] + self.ended[symbol]
                low, high = low + begin, high + begin
            often = high - low >= least
            live, low, high = live[often], low[often], high[often]
            matched[live] += 1
        interval[live] = low
        return matched, interval
