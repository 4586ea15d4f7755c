"""An FM-index over numbers: suffix order, Burrows-Wheeler transform, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions sorted by their suffixes, by prefix doubling over those not yet told apart.

    0 is a separator: each one is a symbol of its own, smaller the earlier it stands, so that no comparison passes it.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    zero = text == 0
    first = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + zero.sum())
    order = np.argsort(first, kind="stable")
    changed = np.empty(n, bool)
    changed[0] = True
    changed[1:] = first[order][1:] != first[order][:-1]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
    rank[order] = head  # the first place of its group
    h = 1
    while True:
        last = np.append(changed[1:], True)
        open_ = np.flatnonzero(~(changed & last))  # places in groups of two or more
        if not len(open_):
            return order
        at = order[open_]
        follows = at + h
        second = np.where(follows < n, rank[np.minimum(follows, n - 1)], -1)
        group = rank[at]
        by = np.lexsort((second, group))
        order[open_] = at[by]
        g, s = group[by], second[by]
        new = np.empty(len(by), bool)
        new[0] = True
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        changed[open_] = new
        head = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
        rank[order[open_]] = head[open_]
        h *= 2


class Bits:
    """A bit vector with rank: packed 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, bool)), bitorder="little").view("<u8")
        self.words = packed.astype(np.uint64)
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Wavelet:
    """Rank and access over numbers 0 .. 2**levels - 1, one bit vector for each binary digit."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels, self.bits, self.zeros = max(1, int(top).bit_length()), [], []
        for level in reversed(range(self.levels)):
            one = (values >> level) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(int(len(one) - one.sum()))
            values = np.concatenate((values[~one], values[one]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before position i."""
        start = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level) & 1 == 1
            a, b = self.bits[k].ones(start), self.bits[k].ones(i)
            start, i = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.levels):
            b = self.bits[k].ones(i)
            one = self.bits[k].ones(i + 1) > b
            a = self.bits[k].ones(start)
            start, i = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, i - b)
            symbol = symbol * 2 + one
        return symbol, i - start


class FMIndex:
    """Search in a shard: numbers from 1 to top, 0 between stretches. Patterns hold no 0."""

    def __init__(self, text: np.ndarray, top: int, every: int = 16):
        text = np.append(text, 0).astype(np.int64)  # the last separator ends the text
        order = suffix_order(text)
        before = text[order - 1]
        self.n = len(text)
        self.wavelet = Wavelet(before, top)
        self.smaller = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.smaller[1:])
        # positions are kept at every 16th place and where a stretch begins, so that no walk passes a separator
        kept = (order % every == 0) | (before == 0)
        self.kept, self.position = Bits(kept), order[kept]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once: a row for each, right-aligned, 0 before its first symbol. Ranges [low, high) of suffix places."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            live = live[(high[live] > low[live]) & (patterns[live, j] > 0)]
            if not len(live):
                break
            symbol = patterns[live, j]
            low[live] = self.smaller[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffix places: step back in the text until a kept position."""
        out, at, steps = np.empty(len(places), np.int64), places.copy(), 0
        live = np.arange(len(places))
        while len(live):
            known = self.kept.ones(at[live] + 1) > self.kept.ones(at[live])
            done = live[known]
            out[done] = self.position[self.kept.ones(at[done])] + steps
            live = live[~known]
            if len(live):
                symbol, before = self.wavelet.access(at[live])
                at[live] = self.smaller[symbol] + before
                steps += 1
        return out
