"""Elias-Fano coding of ascending numbers: low bits packed, high bits in unary, with samples to select from."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = struct.Struct("<QQQB")


def bits_packed(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Ascending int64 values. About ``2 + log2(range / n)`` bits each, and 32 bits for every ``SAMPLE`` of them."""
    n = len(values)
    least = int(values[0]) if n else 0
    v = (values - least).astype(np.uint64)
    reach = int(v[-1]) if n else 0
    width = max(0, (reach // n).bit_length() - 1) if n else 0
    places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    flags[places] = 1
    low = bits_packed(v & np.uint64((1 << width) - 1), width)
    high = np.packbits(flags, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return HEAD.pack(n, least & (1 << 64) - 1, len(high), width) + low + high + samples


class EliasFano:
    """Reads what ``encode`` made."""

    def __init__(self, data: bytes | memoryview):
        self.n, least, high, self.width = HEAD.unpack_from(data)
        self.least = least - (1 << 64) if least >> 63 else least
        at = HEAD.size
        low = (self.n * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, high, at + low)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + low + high)
        self.size = at + low + high + 4 * len(self.samples)

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.int64)
        begin, end = first * self.width, (first + count) * self.width
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return bits.reshape(count, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")) + byte * 8
            ones = ones[ones >= place]
            if left < len(ones):
                return self.least + ((int(ones[left]) - i) << self.width) + int(self._low(i, 1)[0])
            left -= len(ones)
            byte += 64
            place = byte * 8

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return self.least + ((ones - np.arange(self.n)) << self.width) + self._low(0, self.n)
