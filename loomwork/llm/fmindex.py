"""FM-index of a word sequence: suffix array, wavelet tree ranks and sampled suffix positions, in numpy.

Symbol 0 separates runs. Suffixes are compared up to their first separator, and separators by position,
so every step through a symbol other than 0 keeps the usual order. A search never crosses a separator, and
all run starts are sampled, so locating never steps through one either.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of a text that ends with 0, by packed prefixes and then prefix doubling of what ties."""
    n = len(text)
    places = max(1, n.bit_length())
    k = max(1, (63 - places) // bits)
    key = np.zeros(n, np.int64)
    symbol, alive = text.astype(np.int64), np.ones(n, bool)
    for j in range(k):
        part = np.zeros(n, np.int64)
        part[: max(0, n - j)] = symbol[j:]
        part *= alive
        alive &= part > 0
        key = (key << bits) | part
    packed = np.sort((key << places) | np.arange(n))
    order = packed & ((1 << places) - 1)
    ended = ~alive[order]
    key = packed >> places
    new = np.r_[True, key[1:] != key[:-1]] | ended
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_rows = np.flatnonzero(~new | np.r_[~new[1:], False])
    while len(open_rows):
        at = order[open_rows]
        first, second = rank[at], rank[np.minimum(at + k, n - 1)]
        if 3 * places <= 63:
            both = np.sort((((first << places) | second) << places) | np.arange(len(at)))
            turn, pair = both & ((1 << places) - 1), both >> places
            new = np.r_[True, pair[1:] != pair[:-1]]
        else:
            turn = np.lexsort((second, first))
            new = np.r_[True, (first[turn][1:] != first[turn][:-1]) | (second[turn][1:] != second[turn][:-1])]
        at = at[turn]
        order[open_rows] = at
        rank[at] = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_rows = open_rows[~new | np.r_[~new[1:], False]]
        k *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of symbols below 2**bits, level by level from the top bit (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        for k in reversed(range(bits)):
            ones = (symbols >> k) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(len(symbols) - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i stands among the sorted symbols once ``symbol`` is followed down."""
        for level, zeros, k in zip(self.levels, self.zeros, reversed(range(self.bits)), strict=True):
            ones = level.rank(i)
            i = np.where((symbol >> k) & 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and where those positions stand at the bottom."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level[i], level.rank(i)
            symbol = (symbol << 1) | bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """Index of a text of symbols below ``size`` that begins and ends with 0."""

    def __init__(self, text: np.ndarray, size: int, every: int = 8) -> None:
        bits = max(1, (size - 1).bit_length())
        order = suffix_array(text, bits)
        before = text[order - 1]
        self.tree = WaveletTree(before, bits)
        counts = np.bincount(text, minlength=size)
        first = np.cumsum(counts) - counts
        symbols = np.arange(size)
        self.shift = first - self.tree.descend(symbols, np.zeros(size, np.int64))
        self.n = len(text)
        sampled = (before == 0) | (order % every == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of each phrase; phrases are the rows of a matrix, flush right, with 0 before."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = both[: len(live)] + self.shift[symbol], both[len(live) :] + self.shift[symbol]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of suffixes that don't begin with 0."""
        where, steps = np.empty(len(rows), np.int64), 0
        index, rows = np.arange(len(rows)), rows.copy()
        while len(index):
            done = self.sampled[rows]
            where[index[done]] = self.positions[self.sampled.rank(rows[done])] + steps
            index, rows = index[~done], rows[~done]
            if len(index):
                symbol, bottom = self.tree.access(rows)
                rows = bottom + self.shift[symbol]
            steps += 1
        return where
