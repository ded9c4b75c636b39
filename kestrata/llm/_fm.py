"""An FM-index over an integer text: wavelet-tree ranks, backward search, locating by sampled positions."""

from __future__ import annotations

import numpy as np

from ._dc3 import suffix_array

SAMPLE = 16


class WaveletTree:
    """Level-wise wavelet tree of dense symbols; ``rank`` answers arrays of questions."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        self.ones: list[np.ndarray] = []
        order = symbols
        for level in range(self.bits):
            shift = self.bits - 1 - level
            bit = (order >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            order = order[np.argsort(order >> shift, kind="stable")]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[k] occurs in the first i[k] places."""
        lo, hi, i = np.zeros(len(c), np.int64), np.full(len(c), self.n), i.copy()
        for level, ones in enumerate(self.ones):
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            before = ones[lo + i] - ones[lo]
            zeros = (hi - lo) - (ones[hi] - ones[lo])
            i = np.where(bit, before, i - before)
            hi = np.where(bit, hi, lo + zeros)
            lo = np.where(bit, lo + zeros, lo)
        return i


class FMIndex:
    """Built over one shard of training text; symbols are non-negative."""

    def __init__(self, text: np.ndarray) -> None:
        self.alphabet, dense = np.unique(text, return_inverse=True)
        t = np.concatenate([dense + 1, [0]])  # 0 ends the text
        sa = np.concatenate([[len(text)], suffix_array(dense + 1)])
        self.bwt = t[sa - 1]
        sigma = len(self.alphabet) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.tree = WaveletTree(self.bwt, sigma)
        self.marked = sa % SAMPLE == 0
        self.order = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of equally long patterns, one a row."""
        at = np.minimum(np.searchsorted(self.alphabet, patterns), len(self.alphabet) - 1)
        known = (self.alphabet[at] == patterns).all(axis=1)
        lo, hi = np.zeros(len(patterns), np.int64), np.where(known, len(self.bwt), 0)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = at[live, j] + 1
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to the nearest sampled position."""
        row, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo := todo[~self.marked[row[todo]]]):
            c = self.bwt[row[todo]]
            row[todo] = self.first[c] + self.tree.rank(c, row[todo])
            steps[todo] += 1
        return self.samples[self.order[row]] + steps
