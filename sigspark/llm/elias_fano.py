"""Monotone sequences in Elias-Fano form: low bits packed, high parts in unary, searched without unpacking.

``n`` values up to ``u`` take about ``2 + log2(u / n)`` bits each.  All calls take and give whole arrays.
"""

from __future__ import annotations

import numpy as np

_HALVES = tuple((np.uint64(h), np.uint64((1 << h) - 1)) for h in (32, 16, 8, 4, 2, 1))


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the set bits of the given ranks; ``before`` counts those before each word."""
    word = np.searchsorted(before, rank, "right") - 1
    left, bits, at = (rank - before[word]).astype(np.uint64), words[word], np.zeros(len(rank), np.uint64)
    for half, mask in _HALVES:
        low = np.bitwise_count(bits & mask).astype(np.uint64)
        go = left >= low
        left = np.where(go, left - low, left)
        bits = np.where(go, bits >> half, bits)
        at = np.where(go, at + half, at)
    return word * 64 + at.astype(np.int64)


class EliasFano:
    """A sequence of ascending unsigned integers (equal ones allowed)."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._ones: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, np.uint64), np.zeros(1, np.uint64))
        if (values[1:] < values[:-1]).any():
            raise ValueError("an Elias-Fano sequence must ascend")
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 2) // 64) * 64, np.uint8)  # a zero follows the last one
        bits[places] = 1
        return cls(n, width, cls._packed(values, width), np.packbits(bits, bitorder="little").view(np.uint64))

    @staticmethod
    def _packed(values: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(values) * width // 64 + 2, np.uint64)
        if width:
            low = values & np.uint64((1 << width) - 1)
            bit = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[first]] = np.bitwise_or.reduceat(low << shift, first)
            over = np.flatnonzero(shift + np.uint64(width) > 64)
            out[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        return out

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | upper) & np.uint64((1 << self.width) - 1)

    def _counts(self) -> np.ndarray:
        if self._ones is None:
            ones = np.bitwise_count(self.high).astype(np.int64)
            self._ones = np.cumsum(ones) - ones
        return self._ones

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        at = np.asarray(at, np.int64)
        high = (_select(self.high, self._counts(), at) - at).astype(np.uint64)
        return high << np.uint64(self.width) | self._lows(at)

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value of at least each ``x``, or ``n``: the successor search."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), self.n, np.int64)
        if not self.n:
            return out
        top = int(self.access(np.array([self.n - 1]))[0])
        some = np.flatnonzero(x <= np.uint64(top))
        high, low = (x[some] >> np.uint64(self.width)).astype(np.int64), x[some] & np.uint64((1 << self.width) - 1)
        zeros = np.arange(len(self.high)) * 64 - self._counts()
        lo = np.where(high > 0, _select(~self.high, zeros, np.maximum(high - 1, 0)) - (high - 1), 0)
        hi = _select(~self.high, zeros, high) - high
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < low[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        out[some] = lo
        return out

    def decode(self) -> np.ndarray:
        """All values, for as many searches as there are values."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.n)
        return (places - at).astype(np.uint64) << np.uint64(self.width) | self._lows(at)
