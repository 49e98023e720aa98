"""Bit runs that count."""

from __future__ import annotations

import numpy as np


class Bits:
    """A run of bits that tells how many of them are set before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(-(-len(bits) // 64) * 8 + 8, dtype=np.uint8)
        held = np.packbits(bits, bitorder="little")
        packed[:len(held)] = held
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int64)
        self.set = int(np.count_nonzero(bits))
        self.zeros = len(bits) - self.set

    def ones(self, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
