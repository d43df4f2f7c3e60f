"""An FM-index over integer sequences: Burrows-Wheeler transform in a wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; equal symbols 0 count as distinct, in order of their positions."""
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []  # ones before each place
        now = symbols.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` ones."""
        low, high = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            bit = (symbols >> b) & 1
            ones_low, ones_high = self.ones[k][low], self.ones[k][high]
            low = np.where(bit, self.zeros[k] + ones_low, low - ones_low)
            high = np.where(bit, self.zeros[k] + ones_high, high - ones_high)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it is before it."""
        symbols, start, place = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for k in range(self.bits):
            ones_place, ones_start = self.ones[k][place], self.ones[k][start]
            bit = self.ones[k][place + 1] - ones_place
            symbols = symbols << 1 | bit
            start = np.where(bit, self.zeros[k] + ones_start, start - ones_start)
            place = np.where(bit, self.zeros[k] + ones_place, place - ones_place)
        return symbols, place - start


class FMIndex:
    """Counts and locates phrases in a sequence of symbols 0 to ``top``; 0 separates runs, and no phrase has it.

    Positions are kept for every ``sample``-th place of the sequence and for the first place of each run, so a walk back
    from an occurrence never leaves its run and takes fewer than ``sample`` steps.
    """

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        order = suffix_array(text)
        self.n = len(text)
        last = text[order - 1] if self.n else text
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1)))).astype(np.int64)
        self.tree = WaveletMatrix(last, max(1, int(top).bit_length()))
        kept = (order % sample == 0) | (last == 0)
        self.sampled = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.positions = order[kept]
        self.kept = kept

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 suffix of each row of ``phrases``, all of one length, by backward search of all at once."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            low[alive] = self.starts[c] + self.tree.rank(c, low[alive])
            high[alive] = self.starts[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high[low >= high] = low[low >= high]
        return low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the given suffixes."""
        at, steps = suffixes.astype(np.int64), np.zeros(len(suffixes), dtype=np.int64)
        walking = np.flatnonzero(~self.kept[at])
        while len(walking):
            symbol, before = self.tree.access(at[walking])
            at[walking] = self.starts[symbol] + before
            steps[walking] += 1
            walking = walking[~self.kept[at[walking]]]
        return self.positions[self.sampled[at]] + steps
