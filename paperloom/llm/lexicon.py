"""Frequent words in a minimal acyclic automaton with id outputs, kept as arrays that workers map.

States that accept the same endings are one state. Each transition carries the number of words that
sort before it from its state, so the sum along a word's path is the word's index, and the index
gives its ids. All words of a block walk through the automaton at once, one byte a step.
"""

from __future__ import annotations

import numpy as np

from paperloom.llm import shared

ARRAYS = {"keys": np.int64, "targets": np.int32, "adds": np.int32, "final": np.uint8, "flat": np.int32, "offsets": np.int64}


def compiled(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of sorted, distinct, non-empty words."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def frozen(node) -> int:
        signature = (node[0], tuple(node[1]))
        if signature not in register:
            register[signature] = len(states)
            states.append(signature)
        return register[signature]

    # The path of the last word is still open: lists of [accepts, [(byte, state)]].
    path = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(done)))

    for word in words:
        shared_prefix = 0
        while shared_prefix < min(len(word), len(last)) and word[shared_prefix] == last[shared_prefix]:
            shared_prefix += 1
        close(shared_prefix)
        path.extend([False, []] for _ in word[shared_prefix:])
        path[-1][0] = True
        last = word
    close(0)
    root = frozen(path[0])

    below = [0] * len(states)  # states are numbered after those they lead to
    keys, targets, adds = [], [], []
    for n, (accepts, moves) in enumerate(states):
        total = int(accepts)
        for byte, to in moves:
            keys.append((n << 8) | byte)
            targets.append(to)
            adds.append(total)
            total += below[to]
        below[n] = total
    return {
        "keys": np.array([root, *keys], np.int64), "targets": np.array(targets, np.int32),
        "adds": np.array(adds, np.int32), "final": np.array([a for a, _ in states], np.uint8),
    }


class Lexicon:
    """Word to ids; arrays may be memory-mapped files."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.root, self.keys = int(arrays["keys"][0]), arrays["keys"][1:]
        self.targets, self.adds, self.final = arrays["targets"], arrays["adds"], arrays["final"]
        self.flat, self.offsets = arrays["flat"], arrays["offsets"]

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of each byte range, -1 where the lexicon hasn't it."""
        index = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return index
        live, state, total, step = np.arange(len(starts)), np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64), 0
        lengths = ends - starts
        while len(live):
            ended = lengths[live] == step
            if ended.any():
                accepted = ended & (self.final[state] == 1)
                index[live[accepted]] = total[accepted]
                live, state, total = live[~ended], state[~ended], total[~ended]
                if not len(live):
                    break
            key = (state << 8) | data[starts[live] + step]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[slot] == key
            live, slot = live[fits], slot[fits]
            state, total = self.targets[slot].astype(np.int64), total[fits] + self.adds[slot]
            step += 1
        return index


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    for name, kind in ARRAYS.items():
        shared.put(f"{uri}/{name}", arrays[name].astype(kind))


def load(uri: str) -> Lexicon:
    return Lexicon({name: shared.mapped(f"{uri}/{name}", kind) for name, kind in ARRAYS.items()})
