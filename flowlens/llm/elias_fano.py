"""Rising sequences in Elias-Fano form, read and searched for many values at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

_ONES, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: For each byte and r: the place of its bit number r.
SELECT8 = np.array([[*(p for p in range(8) if b >> p & 1), *[0] * 8][:8] for b in range(256)], np.uint8)
CHUNK = 1 << 18  # values whose low bits are packed at once
STEPS = 4  # from number to number before a search by halves


def place_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of one bit number ``r`` in each 64-bit word."""
    u = np.uint64
    s = words - ((words >> u(1)) & u(0x5555555555555555))
    s = (s & u(0x3333333333333333)) + ((s >> u(2)) & u(0x3333333333333333))
    upto = ((s + (s >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * _ONES  # one bits up to the end of each byte
    r = r.astype(np.uint64)
    whole = ((((((r * _ONES) | _HIGHS) - upto) & _HIGHS) >> u(7)) * _ONES) >> u(56)  # bytes that end before it
    at = whole * u(8)
    before = ((upto << u(8)) >> at) & u(255)
    return at.astype(np.int64) + SELECT8[((words >> at) & u(255)).astype(np.int64), (r - before).astype(np.int64)]


@dataclass
class EliasFano:
    """``n`` strictly rising numbers: ``width`` low bits of each side by side, the rest in unary with a count of ones a word."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        low = []
        for at in range(0, n, CHUNK):  # a multiple of 8 values: whole bytes
            part = values[at : at + CHUNK]
            bits = np.empty((len(part), width), np.uint8)
            for i in range(width):  # a column of bits at a time: all at once would be numbers of 8 bytes for each bit
                bits[:, i] = part >> i & 1
            low.append(np.packbits(bits, bitorder="little"))
        bits = np.zeros(-(-(n + (top >> width) + 2) // 64) * 64 + 64, np.uint8)
        at = values >> width
        at += np.arange(n)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.bitwise_count(high).cumsum(dtype=np.int64)]).astype("<i8" if n >> 31 else "<i4")
        return cls(n, width, np.concatenate([*low, np.zeros(8, np.uint8)]), high, ones)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        loads = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))  # eight bytes from any byte on
        got = loads[at >> 3] >> (at & 7).astype(np.uint64)
        return (got & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def select(self, i: np.ndarray, bit: int) -> np.ndarray:
        """The place of bit number ``i`` that is ``bit``."""
        counts = self.counts[bit]
        word = np.searchsorted(counts, i, side="right") - 1
        words = self.high[word]
        return word * 64 + place_in_word(words if bit else ~words, i - counts[word])

    @cached_property
    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones before each word, as they are searched."""
        ones = self.ones.astype(np.int64)
        return np.arange(len(ones), dtype=np.int64) * 64 - ones, ones

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self.select(i, 1) - i << self.width) | self.low_bits(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is not below ``x`` (``n`` if there is none), and whether it is ``x``."""
        h = x >> self.width
        inside = (h >= 0) & (h < len(self.high) * 64 - self.n)
        h = np.where(inside, h, 0)
        lo, want = np.zeros(len(x), np.int64), x & (1 << self.width) - 1
        later = np.flatnonzero(h)
        lo[later] = self.select(h[later] - 1, 0) - (h[later] - 1)
        open_ = np.flatnonzero(self.bit(h + lo))
        for _ in range(STEPS):  # of the numbers with these high bits, there is one on average
            open_ = open_[self.low_bits(lo[open_]) < want[open_]]
            lo[open_] += 1
            open_ = open_[self.bit(h[open_] + lo[open_])]
        hi = self.select(h[open_], 0) - h[open_]
        while len(open_):
            mid = (lo[open_] + hi) >> 1
            below = self.low_bits(mid) < want[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi = np.where(below, hi, mid)
            still = lo[open_] < hi
            open_, hi = open_[still], hi[still]
        found = inside & self.bit(h + lo)
        found[found] = self.low_bits(lo[found]) == want[found]
        return np.where(inside, lo, np.where(x < 0, 0, self.n)), found

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.high[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
