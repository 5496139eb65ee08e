"""Byte-pair merges of many words together, in numpy."""

from __future__ import annotations

import numpy as np

ROUNDS_LENGTH = 64  # symbols of a word that is merged in rounds with others


class PairTable:
    """A hash of pairs of symbols, ``left << 32 | right``, that make a symbol.  Negative
    symbols are in no pair."""

    def __init__(self, keys: np.ndarray, made: np.ndarray, rank: np.ndarray):
        self.made, self.rank = made, rank
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots, self.keys = np.full(1 << self.bits, -1, dtype=np.int64), np.append(keys, -1)
        place, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # open addressing: the first of a slot stays, the others move on
            free = self.slots[place] < 0
            _, one = np.unique(place[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slots[place[put]] = left[put]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, place = left[stay], (place[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair of each two symbols, -1 for none."""
        keys = a.astype(np.int64) << 32 | b
        place = self._slot(keys)
        found = self.slots[place]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slots[place[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        found[(a < 0) | (b < 0)] = -1
        return found


def merge_rounds(symbol: np.ndarray, word: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(word, symbol) of what is left of the symbols of all words, in their order.  In each
    round every open word joins its pair of the least rank, the leftmost of ties."""
    none = np.int64(1 << 62)
    done: list = []

    def keys(at: np.ndarray) -> np.ndarray:
        """Rank of the symbols at and after, ``none`` at the ends of words."""
        at = np.minimum(at, len(symbol) - 2)
        found = pairs.find(symbol[at], symbol[at + 1])
        return np.where((found >= 0) & (word[at] == word[at + 1]), pairs.rank[found], none)

    key = np.append(keys(np.arange(len(symbol) - 1)), none) if len(symbol) > 1 else np.full(len(symbol), none)
    while len(symbol):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        length = np.diff(np.append(first, len(symbol)))
        least = np.minimum.reduceat(key, first)
        open_ = least < none
        if not open_.all():
            shut = ~np.repeat(open_, length)
            done.append((word[shut], symbol[shut]))
            symbol, word, key, least, length = symbol[~shut], word[~shut], key[~shut], least[open_], length[open_]
            if not len(symbol):
                break
            first = np.cumsum(length) - length
        hit = np.flatnonzero(key == np.repeat(least, length))  # of pairs of one rank the leftmost of each word
        hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
        symbol[hit] = pairs.made[pairs.find(symbol[hit], symbol[hit + 1])]
        keep = np.ones(len(symbol), dtype=bool)
        keep[hit + 1] = False
        symbol, word, key = symbol[keep], word[keep], key[keep]
        hit -= np.arange(len(hit))
        if len(symbol) < 2:
            key[:] = none
            continue
        last = hit + 1 == len(symbol)
        key[hit] = np.where(last, none, keys(hit))
        left = hit[hit > 0] - 1
        key[left] = keys(left)
    word, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))
    order = np.argsort(word, kind="stable")
    return word[order], symbol[order]
