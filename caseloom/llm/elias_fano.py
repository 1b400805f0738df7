"""Elias-Fano code of a rising sequence, with select.

A value splits into low bits, stored as they are, and high bits, stored as one
bit set at place ``high + rank``. With n values below u that takes about
n * (2 + log2(u / n)) bits, near the least possible, against 64 n for a table.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: One sampled place for so many set bits.
SAMPLE = 256
_HEAD = struct.Struct("<QQB")


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


@dataclass
class EliasFano:
    n: int
    upper: int  # the greatest value
    width: int  # low bits of a value
    low: bytes
    high: bytes
    samples: np.ndarray  # place of every SAMPLE-th set bit

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """Code of non-negative, never falling integers."""
        v = np.asarray(values, np.uint64)
        n, upper = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (upper // n).bit_length() - 1) if n else 0
        low = _pack(v & np.uint64((1 << width) - 1), width)
        places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, upper, width, low, np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [self.low, self.high, self.samples.tobytes()]
        return _HEAD.pack(self.n, self.upper, self.width) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, upper, width = _HEAD.unpack_from(data)
        sizes = struct.unpack_from("<3Q", data, _HEAD.size)
        at, parts = _HEAD.size + 24, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, upper, width, parts[0], parts[1], np.frombuffer(parts[2], "<u4"))

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.int64)
        begin = first * self.width
        raw = np.frombuffer(self.low, np.uint8, offset=begin // 8, count=min((begin + count * self.width + 7) // 8, len(self.low)) - begin // 8)
        bits = np.unpackbits(raw, bitorder="little")[begin % 8 : begin % 8 + count * self.width].reshape(count, self.width)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled place forward to the i-th set bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        left += (self.high[byte] & ((1 << place % 8) - 1)).bit_count()
        while left >= (set_bits := self.high[byte].bit_count()):
            left -= set_bits
            byte += 1
        bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return (place - i) << self.width | int(self._lows(i, 1)[0])

    def values(self) -> np.ndarray:
        """All values, by one pass over both parts."""
        if not self.n:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        return (places - np.arange(self.n)) << self.width | self._lows(0, self.n)
