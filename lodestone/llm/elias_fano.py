"""Elias-Fano sequences in numpy, readable from a memory map.

A monotone sequence of n values below 2**bits keeps the low bits of each value in
a packed array and the rest in unary: value i sets bit (high + i) of a bit vector
of at most 2n bits or so. Counts of ones before each 64-bit word make both
select operations a binary search and a look into one word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class EliasFano:
    """Arrays: low, the packed low bits; upper, the bit vector; ones, the ones before
    each of its words; shape, (values, low bits of each)."""

    def __init__(self, low: np.ndarray, upper: np.ndarray, ones: np.ndarray, shape: np.ndarray) -> None:
        self.low, self.upper, self.ones, self.shape = low, upper, ones, shape
        self.n, self.width = (int(x) for x in shape)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> EliasFano:
        n = len(values)
        width = min(63, max(0, bits - max(0, n.bit_length() - 1)))
        values = np.ascontiguousarray(values, U64)
        low = np.zeros(n * width // 64 + 2, U64)
        if width:
            part = values & U64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, off = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << off)
            over = np.flatnonzero(off + U64(width) > U64(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - off[over]))
        high = (values >> U64(width)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 1
        upper = np.zeros(-(-size // 64) * 8, np.uint8)
        at = high + np.arange(n)
        np.bitwise_or.at(upper, at >> 3, (1 << (at & 7)).astype(np.uint8))
        upper = upper.view(U64)
        return cls(low, upper, np.append(0, np.cumsum(np.bitwise_count(upper), dtype=np.int64)), np.array([n, width]))

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.upper, self.ones, self.shape]

    @staticmethod
    def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one (from 0) of each 64-bit word, by halving."""
        at = np.zeros(len(word), np.int64)
        k = k.copy()
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count((word >> at.astype(U64)) & U64((1 << half) - 1)).astype(np.int64)
            up = n <= k
            k -= np.where(up, n, 0)
            at += np.where(up, half, 0)
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        i = np.asarray(i, np.int64)
        w = np.searchsorted(self.ones, i, "right") - 1
        high = w * 64 + self._select(self.upper[w], i - self.ones[w]) - i
        return self._join(high, i)

    def _join(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._low(i) | (high.astype(U64) << U64(self.width))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, off = at >> 6, (at & 63).astype(U64)
        over = np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return ((self.low[word] >> off) | over) & U64((1 << self.width) - 1)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: ones before the high-th zero."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        out = np.full(len(high), self.n, np.int64)
        use = np.flatnonzero((high > 0) & (high <= zeros[-1]))
        k = high[use] - 1
        w = np.searchsorted(zeros, k, "right") - 1
        out[use] = w * 64 + self._select(~self.upper[w], k - zeros[w]) - k
        out[high <= 0] = 0
        return np.minimum(out, self.n)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x (n if none)."""
        x = np.ascontiguousarray(x, U64)
        high = (x >> U64(self.width)).astype(np.int64)
        a, b = self._before(high), self._before(high + 1)
        goal = x & U64((1 << self.width) - 1)
        while (a < b).any():
            go = np.flatnonzero(a < b)
            mid = (a[go] + b[go]) >> 1
            less = self._low(mid) < goal[go]
            a[go] = np.where(less, mid + 1, a[go])
            b[go] = np.where(less, b[go], mid)
        return a

    def within(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of x between the indexes lo and hi (excluded), or -1: a successor search
        in that range alone."""
        x, a, b = np.ascontiguousarray(x, U64), lo.astype(np.int64), hi.astype(np.int64)
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(a < b)
        go = some[b[some] - a[some] > 1]
        while len(go):  # the last value that is at most x lies from a to b
            mid = (a[go] + b[go]) >> 1
            up = self.access(mid) <= x[go]
            a[go] = np.where(up, mid, a[go])
            b[go] = np.where(up, b[go], mid)
            go = go[b[go] - a[go] > 1]
        hit = some[self.access(a[some]) == x[some]]
        out[hit] = a[hit]
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        i = self.successor(x)
        inside = np.flatnonzero(i < self.n)
        out = np.full(len(i), -1, np.int64)
        hit = inside[self.access(i[inside]) == np.asarray(x, U64)[inside]]
        out[hit] = i[hit]
        return out
