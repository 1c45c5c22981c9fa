"""Elias-Fano sequences over flat arrays that can be memory-mapped, with vectorised access."""

from __future__ import annotations

import numpy as np

_MASKS = [(s, np.uint64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]
_ONE = np.uint64(1)


def build(x: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a monotone sequence: ``meta`` (length, low bits, last value), ``low``, ``high`` and the number of ones before each word of it."""
    n = len(x)
    top = int(x[-1]) if n else 0
    bits = max(0, (top // max(1, n)).bit_length() - 1) if top > n else 0
    x = x.astype(np.uint64)
    low = np.zeros((n, bits), np.uint8)
    for b in range(bits):
        low[:, b] = (x >> np.uint64(b)) & _ONE
    low = np.packbits(low.reshape(-1), bitorder="little")
    low = np.concatenate([low, np.zeros(-len(low) % 8 + 8, np.uint8)]).view(np.uint64)
    size = n + (top >> bits) + 2
    size += -size % 64
    high = np.zeros(size, np.uint8)
    high[(x >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(high, bitorder="little").view(np.uint64)
    ranks = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))
    return {"meta": np.array([n, bits, top], np.int64), "low": low, "high": high, "ranks": ranks}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.top = map(int, arrays["meta"])
        self.low, self.high, self.ones = arrays["low"], arrays["high"], np.asarray(arrays["ranks"])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def _select(self, i: np.ndarray, ranks: np.ndarray, flip: bool) -> np.ndarray:
        """Place of bit number i (from 0) that is set, or clear if ``flip``."""
        word = np.searchsorted(ranks, i, "right") - 1
        k, w = (i - ranks[word]).astype(np.uint64), self.high[word]
        if flip:
            w = ~w
        at = word * 64
        for s, mask in _MASKS:
            c = np.bitwise_count(w & mask).astype(np.uint64)
            over = k >= c
            k = np.where(over, k - c, k)
            w = np.where(over, w >> np.uint64(s), w)
            at += over * s
        return at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
        return (both & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        return ((self._select(i, self.ones, False) - i) << self.bits) | self._lows(i)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place in [begin, end) that holds the value, or -1: successor search.

        Values with the same high part lie between two clear bits; among those, low parts are compared.
        """
        end = np.where((value < 0) | (value > self.top), 0, end)
        value = np.clip(value, 0, self.top)
        part = value >> self.bits
        first = np.where(part > 0, self._select(np.maximum(part - 1, 0), self.zeros, True) - np.maximum(part - 1, 0), 0)
        last = np.minimum(self._select(part, self.zeros, True) - part, end)
        first = np.maximum(first, begin)
        want = value & ((1 << self.bits) - 1)
        out = np.full(len(value), -1, np.int64)
        live = np.flatnonzero(first < last)
        # the lows between two clear bits ascend: halve until one place is left
        lo, hi = first[live], last[live]
        while len(live):
            mid = (lo + hi) >> 1
            got = self._lows(mid)
            hit = got == want[live]
            out[live[hit]] = mid[hit]
            less = got < want[live]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            go = ~hit & (lo < hi)
            live, lo, hi = live[go], lo[go], hi[go]
        return out
