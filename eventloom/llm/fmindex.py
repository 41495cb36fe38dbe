"""An FM-index over a sequence of integers: wavelet-matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the sorted prefix; starts with as many symbols as fit in 62 bits."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length()) if n else 1
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: n - j] |= s[j:].astype(np.int64) if j < n else 0
    order = np.argsort(key, kind="stable")
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])] if n else 0
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        if h < n:
            nxt[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + nxt
        # only suffixes that still share their rank have to move
        tied = np.r_[False, sorted_key[1:] == sorted_key[:-1]]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
        h *= 2


class FMIndex:
    """Over s, whose last symbol must be 0 and occur nowhere else."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.levels = max(1, int(s.max()).bit_length())
        counts = np.bincount(s, minlength=1 << self.levels)
        self.first = np.r_[0, np.cumsum(counts)]
        self.ones, self.zeros = [], []
        row = bwt.copy()
        for lv in range(self.levels - 1, -1, -1):
            bit = (row >> lv) & 1
            self.ones.append(np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt = bwt
        marked = sa % SAMPLE == 0
        self.marks = np.r_[np.int32(0), np.cumsum(marked, dtype=np.int32)]
        self.samples = sa[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs in the first i symbols of the transformed text, per row."""
        lo, hi = np.zeros_like(i), i
        for k, lv in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> lv) & 1).astype(bool)
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern; all patterns step back together."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            known = c < len(self.first) - 1
            cc = np.where(known, c, 0)
            lo = self.first[cc] + self.rank(cc, lo)
            hi = np.where(known, self.first[cc] + self.rank(cc, hi), lo)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled suffix and count the steps."""
        out = np.full(len(rows), -1, np.int64)
        at, who, steps = rows.copy(), np.arange(len(rows)), 0
        while len(who):
            hit = self.marks[at + 1] > self.marks[at]
            out[who[hit]] = self.samples[self.marks[at[hit]]] + steps
            at, who = at[~hit], who[~hit]
            c = self.bwt[at]
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out
