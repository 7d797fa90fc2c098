"""Full-text index of a shard of word sequences: suffix order, BWT, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``, where every 0 differs from and precedes all else.

    Zeros end the pieces of a text, so comparisons end with the piece and the number of doublings
    is the logarithm of the longest repeat.
    """
    stop = text == 0
    rank = np.where(stop, np.cumsum(stop) - 1, text.astype(np.int64) + stop.sum())
    width, n = 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[:max(n - width, 0)] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key)
        sorted_key = key[order]
        steps = np.zeros(n, np.int64)
        steps[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank[order] = steps
        if not n or steps[-1] == n - 1:
            return order
        width *= 2


class Wavelet:
    """Ranks of symbols in a sequence, one bit plane per level, most significant bit first."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros, self.before = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before the position ``end``."""
        begin = np.zeros_like(end)
        for level, zeros, before in zip(reversed(range(self.levels)), self.zeros, self.before):
            one = ((symbol >> level) & 1) == 1
            b, e = before[begin], before[end]
            begin = np.where(one, zeros + begin - b, b)
            end = np.where(one, zeros + end - e, e)
        return end - begin


class FmIndex:
    """Index of ``text``: positive symbols, each piece ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.wavelet = Wavelet(self.bwt)
        self.starts = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.starts[1:])
        # Positions are kept for every 16th symbol, and where a piece begins: walks end there.
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.samples_before = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.wavelet.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, begin of occurrence) for all occurrences of phrases of one length."""
        which = np.arange(len(phrases))
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        for symbol in phrases.T[::-1]:
            symbol = symbol[which].astype(np.int64)
            low, high = self.step(symbol, low), self.step(symbol, high)
            found = low < high
            which, low, high = which[found], low[found], high[found]
        count = high - low
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return np.repeat(which, count), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        walking = np.flatnonzero(~self.sampled[row])
        while len(walking):
            at = row[walking]
            row[walking] = self.step(self.bwt[at].astype(np.int64), at)
            steps[walking] += 1
            walking = walking[~self.sampled[row[walking]]]
        return self.positions[self.samples_before[row]] + steps
