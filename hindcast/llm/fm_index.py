"""FM-index over integer symbols in numpy: suffix array, wavelet matrix of the BWT, backward search, sampled locate.

All queries of a call run in lock step, so a search costs a few array operations per symbol and level.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int | None = None, ranks: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Suffix order by prefix doubling; each round sorts only suffixes that are still tied.

    With `depth`, suffixes are ordered by their first `depth` symbols at least: intervals of patterns up
    to that length, and their backward search, are the same as with the full order. `ranks` receives the rank of every
    suffix by its first k symbols (equal where these are equal) for each k reached.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = int(text.max() + 1).bit_length()
    known = max(1, min(63 // bits, depth // 2 if depth else 63))
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(known, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(known):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(n + 1, bool)  # fresh[i]: row i starts a group of equal prefixes
    fresh[1:n] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    if ranks is not None:
        ranks[known] = rank.copy()
    while depth is None or known < depth:
        tied = np.flatnonzero(~(fresh[:n] & fresh[1:]))
        if not len(tied):
            break
        suffix = order[tied]
        beyond = suffix + known
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = head[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[tied] = suffix[by]
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        fresh[tied] = first
        head[tied] = np.maximum.accumulate(np.where(first, tied, 0))
        rank[order[tied]] = head[tied]
        known *= 2
        if ranks is not None and known < depth:
            ranks[known] = rank.copy()
    return order


class Bits:
    """A bit vector in 64-bit words with a count before each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        size = (len(bits) // 64 + 1) * 64
        padded = np.zeros(size, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix: one bit vector per bit of the symbols, zeros moved before ones at every level."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.shifts = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        now = text.astype(np.int64)
        for shift in self.shifts:
            bit = ((now >> shift) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions mapped to the last level along each symbol's path."""
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = bits.ones(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, mapped position) of each position."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit = bits.get(at)
            ones = bits.ones(at)
            symbol = (symbol << 1) | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    """Index of a text of symbols >= 1. Positions are those of the text given."""

    def __init__(self, text: np.ndarray, *, depth: int | None = None, sample: int = 32):
        """`depth`: order suffixes by that many symbols only, keep their positions in `order`, and mark in
        `groups` which rows share their first depth - 1 symbols."""
        closed = np.concatenate([text.astype(np.int64), [0]])  # 0 closes the text
        ranks: dict[int, np.ndarray] | None = None if depth is None else {}
        self.order = order = suffix_array(closed, depth, ranks)
        self.size = n = len(closed)
        self.sigma = sigma = int(closed.max()) + 1
        self.wavelet = Wavelet(closed[order - 1], sigma)
        counts = np.bincount(closed, minlength=sigma)
        every = np.arange(sigma)
        # Row of the first suffix of a symbol, less where the symbol's path starts on the last level.
        self.shift = np.cumsum(counts) - counts - self.wavelet.down(every, np.zeros(sigma, np.int64))
        self.marked = self.samples = self.groups = None
        if depth is not None:
            # Two overlapping prefixes of a known length k decide equality of depth - 1 symbols.
            length = depth - 1
            k = max(x for x in ranks if x <= length)
            if 2 * k < length:  # every suffix was told apart by fewer symbols
                self.groups = np.arange(n + 1)
            else:
                late = np.minimum(order + length - k, n - 1)
                a, b = ranks[k][order], np.where(order + length - k < n, ranks[k][late], -1)
                fresh = np.ones(n + 1, bool)
                fresh[1:n] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                self.groups = np.flatnonzero(fresh)
        if depth is None:  # a step from row to row is exact only in the full order
            kept = order % sample == 0
            self.marked, self.samples = Bits(kept), order[kept]
            self.order = None

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of patterns, each with one more symbol in front."""
        both = self.wavelet.down(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        moved = self.shift[symbols]
        return moved + both[: len(low)], moved + both[len(low) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of equally long patterns, one per row of a matrix; symbols unknown to the index match nothing."""
        known = (patterns < self.sigma).all(axis=1)
        low = np.zeros(len(patterns), np.int64)
        high = np.where(known, self.size, 0)
        live = np.flatnonzero(known)
        for j in range(patterns.shape[1] - 1, -1, -1):
            low[live], high[live] = self.extend(patterns[live, j], low[live], high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        high[high < low] = low[high < low]
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step backwards to a sampled suffix."""
        found = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            found[todo[hit]] = self.samples[self.marked.ones(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, mapped = self.wavelet.read(at)
                at = self.shift[symbol] + mapped
                steps += 1
        return found
