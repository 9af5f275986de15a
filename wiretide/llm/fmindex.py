"""FM-index over words: suffix order by prefix doubling, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 counts as a symbol of its own, smaller than any other and ordered by position."""
    n = len(symbols)
    stops = np.flatnonzero(symbols == 0)
    ranks = symbols.astype(np.int64) + len(stops)
    ranks[stops] = np.arange(len(stops))
    step = 1
    while True:
        following = np.full(n, -1, np.int64)
        following[: n - step] = ranks[step:]
        keys = ranks * (n + int(ranks.max()) + 2) + following + 1
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Counts of a symbol before a position, for many pairs at once, one bit of the symbols at a time."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.symbols, self.levels = symbols, []
        row = symbols
        for bit in range(self.bits - 1, -1, -1):
            ones = (row >> bit) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.levels.append(zeros_before)
            row = np.concatenate([row[ones == 0], row[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        low = np.zeros_like(position)
        high = position.copy()
        for level, zeros_before in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            zeros = int(zeros_before[-1])
            low = np.where(one, zeros + low - zeros_before[low], zeros_before[low])
            high = np.where(one, zeros + high - zeros_before[high], zeros_before[high])
        return high - low


class FMIndex:
    """Occurrences of word phrases in runs of words; 0 ends each run."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = 8):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.ranks = WaveletMatrix(before, largest)
        self.before = before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        # Positions are kept for every sample-th word and for the first word of each run, so that no walk leaves its run
        kept = (order % sample == 0) | (before == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, one per line with its words from the left, by backward search."""
        n = len(self.before)
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (low < high))
            word = phrases[live, lengths[live] - 1 - step]
            low[live] = self.first[word] + self.ranks.rank(word, low[live])
            high[live] = self.first[word] + self.ranks.rank(word, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: walk left to the next kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            word = self.before[rows[walking]]
            rows[walking] = self.first[word] + self.ranks.rank(word, rows[walking])
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.positions[self.kept_before[rows]] + steps
