"""Elias-Fano coding of ascending numbers, with select."""

from __future__ import annotations

import struct

import numpy as np

#: Every SAMPLEth one of the upper bits has its place written down, relative to the 32-bit start of its list.
SAMPLE = 256
_HEAD = struct.Struct("<QQB7x")


class EliasFano:
    """n ascending numbers up to a bound u in about n * (2 + log2(u / n)) bits.

    Each number's lower bits lie side by side; its upper part h is a one at place h + i of the upper
    bits. The i-th number needs the place of the i-th one (select): a sample leads to the block and
    counts of ones in bytes lead to the bit.
    """

    def __init__(self, n: int, bound: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.bound, self.low, self.high, self.samples = n, bound, low, high, samples
        self.width = self._width(n, bound)
        self._high = np.frombuffer(high, np.uint8)

    @staticmethod
    def _width(n: int, bound: int) -> int:
        return max(0, (bound // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, numbers: np.ndarray, bound: int | None = None) -> EliasFano:
        x = np.ascontiguousarray(numbers, np.uint64)
        n = len(x)
        if n and (np.any(x[1:] < x[:-1]) or (bound is not None and int(x[-1]) > bound)):
            raise ValueError("numbers must ascend and keep within the bound")
        bound = int(x[-1]) if bound is None and n else bound or 0
        w = cls._width(n, bound)
        low = (x[:, None] >> np.arange(w, dtype=np.uint64)).astype(np.uint8) & 1 if w else np.zeros((n, 0), np.uint8)
        places = ((x >> np.uint64(w)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros((bound >> w) + n + 1, np.uint8)
        high[places] = 1
        return cls(n, bound, np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.bound, 1)
        return head + struct.pack("<QQ", len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bound, version = _HEAD.unpack_from(data)
        if version != 1:
            raise ValueError(f"unknown version {version}")
        n_low, n_high = struct.unpack_from("<QQ", data, _HEAD.size)
        at = _HEAD.size + 16
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at + n_low + n_high)
        return cls(n, bound, data[at : at + n_low], data[at + n_low : at + n_low + n_high], samples)

    def select(self, i: int) -> int:
        """The place of the i-th one (from 0) of the upper bits."""
        place = int(self.samples[i // SAMPLE])
        ones = i % SAMPLE  # to pass, with the sampled one being passed as the 0th
        if not ones:
            return place
        byte = place >> 3
        first = int(self._high[byte]) & (0xFF << (place & 7)) & 0xFF
        ones -= first.bit_count() - 1
        if ones <= 0:
            return byte * 8 + _nth_one(first, first.bit_count() - 1 + ones)
        step = 32
        while True:
            counts = np.cumsum(np.bitwise_count(self._high[byte + 1 : byte + 1 + step]))
            hit = int(np.searchsorted(counts, ones))
            if hit < len(counts):
                word = int(self._high[byte + 1 + hit])
                return (byte + 1 + hit) * 8 + _nth_one(word, ones - 1 - (int(counts[hit - 1]) if hit else 0))
            ones -= int(counts[-1])
            byte += step

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        lower, at = 0, i * self.width
        if self.width:
            chunk = int.from_bytes(self.low[at >> 3 : (at + self.width + 7) >> 3], "little")
            lower = (chunk >> (at & 7)) & ((1 << self.width) - 1)
        return (self.select(i) - i) << self.width | lower

    def take(self, first: int, past: int) -> np.ndarray:
        """The numbers from the first-th to before the past-th, as int64: select leads to the two ends, and
        only the bits between them are read."""
        if not 0 <= first <= past <= self.n:
            raise IndexError((first, past))
        if first == past:
            return np.zeros(0, np.int64)
        lo, hi = self.select(first), self.select(past - 1)
        places = np.flatnonzero(np.unpackbits(self._high[lo >> 3 : (hi >> 3) + 1], bitorder="little")) + (lo >> 3 << 3)
        places = places[np.searchsorted(places, lo) :][: past - first]
        out = (places - np.arange(first, past)) << self.width
        if self.width:
            at = first * self.width
            part = np.frombuffer(self.low, np.uint8)[at >> 3 : (past * self.width + 7) >> 3]
            bits = np.unpackbits(part, bitorder="little")[at & 7 :][: (past - first) * self.width].reshape(-1, self.width)
            out = out | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out.astype(np.int64)

    def all(self) -> np.ndarray:
        """All numbers, as int64."""
        return self.take(0, self.n)


def _nth_one(byte: int, k: int) -> int:
    for _ in range(k):
        byte &= byte - 1
    return (byte & -byte).bit_length() - 1
