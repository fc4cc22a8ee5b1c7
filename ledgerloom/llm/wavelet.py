"""A wavelet matrix over small symbols: counts of a symbol up to any place, and places by count, for many at once."""

from __future__ import annotations

import numpy as np

_WORD = 64


class WaveletMatrix:
    """Symbols below ``2 ** bits``, kept as one bit vector per level with a count before each machine word.

    Level by level, from the highest bit down, the symbols with a 0 go before those with a 1 and keep their order. A place
    is followed down the levels by counting zeros or ones before it, which takes ``bits`` steps whatever the length.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits = len(symbols), bits
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(bits)):
            ones = (symbols >> np.uint8(level)) & np.uint8(1) != 0
            packed = np.zeros((self.size // _WORD + 1) * (_WORD // 8), np.uint8)
            packed[: (self.size + 7) // 8] = np.packbits(ones, bitorder="little")
            words = packed.view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.before.append(counts)
            self.zeros.append(self.size - int(counts[-1]) - int(np.bitwise_count(words[-1])))
            if level:
                symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at // _WORD, (at % _WORD).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(below)

    def rank(self, symbol: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands between each start and end."""
        for k in range(self.bits):
            low, high = self._ones(k, start), self._ones(k, end)
            if symbol >> (self.bits - 1 - k) & 1:
                start, end = low + self.zeros[k], high + self.zeros[k]
            else:
                start, end = start - low, end - high
        return end - start

    def count(self, symbols: tuple[int, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often any of ``symbols`` stands between each start and end."""
        return sum((self.rank(s, start, end) for s in symbols), np.zeros(len(start), np.int64))

    def locate(self, symbols: tuple[int, ...], start: np.ndarray, end: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 1) of ``symbols`` between each start and end, by bisection on counts.

        There must be that many.
        """
        low, high = start.copy(), end.copy()
        while (low + 1 < high).any():
            middle = (low + high + 1) // 2
            reached = self.count(symbols, start, middle) >= nth
            high = np.where(reached, middle, high)
            low = np.where(reached, low, middle)
        return high - 1
