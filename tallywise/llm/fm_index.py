"""A compressed full-text index over whole numbers: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; ``text`` ends with a smallest symbol that occurs once."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[:-step or None] = rank[step:] + 1
        key = rank * (len(rank) + 1) + behind
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = new
        if new[-1] == len(rank) - 1:
            return order
        step *= 2


class FMIndex:
    """Counts occurrences by backward search; holds one bit per symbol and level, and counts per 64 bits."""

    def __init__(self, text: np.ndarray):
        text = np.asarray(text, np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.size, kinds = len(text), int(text.max()) + 1
        self.levels = max(1, (kinds - 1).bit_length())
        words = (self.size >> 6) + 1
        self.bits = np.zeros((self.levels, words), np.uint64)
        self.before = np.zeros((self.levels, words), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        current = bwt
        for level in range(self.levels):
            ones = (current >> (self.levels - 1 - level)) & 1
            padded = np.zeros(words * 64, np.uint8)
            padded[:self.size] = ones
            self.bits[level] = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(self.bits[level]).astype(np.int32)
            self.before[level, 1:] = np.cumsum(counts)[:-1]
            self.zeros[level] = self.size - int(ones.sum())
            current = np.concatenate((current[ones == 0], current[ones == 1]))
        symbols = np.arange(kinds)
        smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds))[:-1]))
        self.shift = smaller - self._descend(symbols, np.zeros(kinds, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word = at >> 6
            inside = self.bits[level][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE)
            ones = self.before[level][word] + np.bitwise_count(inside)
            one = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        both = self._descend(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        shift = self.shift[symbols]
        return both[:len(symbols)] + shift, both[len(symbols):] + shift


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Marks the starts in ``text`` of windows that the index holds twice or more.

    Streams the stretches ``begin`` to ``end`` (exclusive) backwards, all side by side.  A match is
    extended to the left for as long as it occurs twice; where it ends, the search
    goes on from the last window end that the failure leaves open.
    """
    found = np.zeros(len(text), bool)
    keep = end - begin >= window
    base, last = begin[keep], end[keep] - 1
    at = last.copy()
    low, high = np.zeros(len(base), np.int64), np.full(len(base), index.size, np.int64)
    while len(base):
        new_low, new_high = index.extend(text[at], low, high)
        ok = new_high - new_low >= 2
        # Matched: one symbol further; a full window starts here.
        found[at[ok & (last - at + 1 >= window)]] = True
        over = ok & (at == base)
        low, high = np.where(ok, new_low, 0), np.where(ok, new_high, index.size)
        last = np.where(ok, last, np.minimum(last - 1, at + window - 1))
        at = np.where(ok, at - 1, last)
        over |= ~ok & (last - base + 1 < window)
        if over.any():
            go = ~over
            base, last, at, low, high = base[go], last[go], at[go], low[go], high[go]
    return found
