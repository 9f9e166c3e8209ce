"""Elias-Fano coding: non-decreasing whole numbers in about 2 + log2(u / n) bits each, with random access.

Each number is split: its low bits stand side by side, its high part is written in unary, as a one
after as many zeros as the high parts have grown by. The place of each 256th one is kept in 32 bits, so a
number is found by reading a few bytes (select) and none needs 64 bits of its own.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ones between two kept places.
STEP = 256
_HEAD = struct.Struct("<QQB")
_CHUNK = 1 << 16


def _bits(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Bits start to stop of little-endian packed bytes."""
    first = start >> 3
    return np.unpackbits(data[first : (stop + 7) >> 3], bitorder="little")[start - 8 * first : stop - 8 * first]


class EliasFano:
    """A coded sequence. ``encode`` makes its bytes, the constructor reads them where they lie."""

    def __init__(self, data: np.ndarray) -> None:
        self.n, self.universe, self.low_bits = _HEAD.unpack(data[: _HEAD.size].tobytes())
        at = _HEAD.size
        sizes = self.sizes(self.n, self.universe)
        self.low, self.high, samples = (data[at + sum(sizes[:i]) : at + sum(sizes[: i + 1])] for i in range(3))
        self.samples = samples.view("<u4") if samples.size else np.zeros(0, np.uint32)

    @staticmethod
    def _low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def sizes(cls, n: int, universe: int) -> tuple[int, int, int]:
        """Bytes of the low bits, the high bits and the places."""
        low = cls._low_bits(n, universe)
        return (n * low + 7) >> 3, (n + (max(0, universe - 1) >> low) + 8) >> 3 if n else 0, 4 * -(-n // STEP)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> bytes:
        """``values`` (uint64, non-decreasing, all below ``universe``)."""
        n, values = len(values), values.astype(np.uint64)
        low = cls._low_bits(n, universe)
        size_low, size_high, _ = cls.sizes(n, universe)
        lows = np.zeros(size_low, np.uint8)
        for at in range(0, n if low else 0, _CHUNK):  # a chunk has whole bytes
            part = np.packbits(((values[at : at + _CHUNK, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            lows[at * low >> 3 : (at * low >> 3) + len(part)] = part
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        ones = np.zeros(8 * size_high, np.uint8)
        ones[places] = 1
        samples = places[::STEP]
        if n and samples[-1] >= 1 << 32:
            raise OverflowError(f"{n} numbers in one sequence; divide it")
        return _HEAD.pack(n, universe, low) + lows.tobytes() + np.packbits(ones, bitorder="little").tobytes() + samples.astype("<u4").tobytes()

    def _places(self, first: int, stop: int) -> np.ndarray:
        """The places of the ones first to stop."""
        from_, last = first // STEP, -(-stop // STEP)
        start = int(self.samples[from_])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        return start + np.flatnonzero(_bits(self.high, start, end))[first - from_ * STEP : stop - from_ * STEP]

    def decode(self, first: int, stop: int) -> np.ndarray:
        """Numbers first to stop as uint64."""
        if stop <= first:
            return np.zeros(0, np.uint64)
        out = (self._places(first, stop) - np.arange(first, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = _bits(self.low, first * self.low_bits, stop * self.low_bits).reshape(-1, self.low_bits)
            for j in range(self.low_bits):
                out |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return out

    def select(self, i: int) -> int:
        """Number i; like decode, it reads between two kept places only."""
        return int(self.decode(i, i + 1)[0])
