"""Words of many texts at once, as arrays over their joined UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes per run of powers; sums of longer texts carry on from run to run.
_POWERS = 1 << 16
#: Bytes whose sums are held at once.
RUN = 1 << 18


def _table(base: np.uint64) -> np.ndarray:
    out = np.full(_POWERS, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _table(_STEP), _table(_BACK)


def _power(table: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """table[1] to the power of each exponent, modulo 2 ** 64."""
    whole = exponents // _POWERS
    out = table[exponents % _POWERS]
    if len(whole) and whole.max():
        runs = np.full(int(whole.max()) + 1, (table[-1:] * table[1:2])[0], np.uint64)
        runs[0] = 1
        out = out * np.multiply.accumulate(runs)[whole]
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads them."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals from U+00C0 to U+00DE in lower case."""
    out = lower_ascii(data)
    if len(out) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] |= 0x20
    return out


@dataclass
class Words:
    """Runs of bytes for which ``inside`` holds; a run ends at the end of its text.

    ``offsets`` has the first byte of each text, and one more entry; ``start`` and ``end`` have a word each.
    """

    data: np.ndarray
    offsets: np.ndarray
    inside: np.ndarray

    @cached_property
    def start(self) -> np.ndarray:
        first = self.inside.copy()
        if len(first):
            begins = np.zeros(len(first) + 1, bool)
            begins[self.offsets] = True
            first[1:] &= ~self.inside[:-1] | begins[1:-1]
        return np.flatnonzero(first)

    @cached_property
    def end(self) -> np.ndarray:
        last = self.inside.copy()
        if len(last):
            ends = np.zeros(len(last) + 1, bool)
            ends[self.offsets] = True
            last[:-1] &= ~self.inside[1:] | ends[1:-1]
        return np.flatnonzero(last) + 1

    @cached_property
    def cuts(self) -> np.ndarray:
        """Index of the first word of each text, and one more entry."""
        return np.searchsorted(self.start, self.offsets)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes between two places; equal bytes have equal hashes wherever they are.

        Places ascend. Sums of powers are made for ``RUN`` bytes at a time, so they take no memory by the text.
        """
        spread = np.zeros(len(start), np.uint64)
        first = 0
        while first < len(start):
            low = int(start[first])
            last = max(first + 1, int(np.searchsorted(end, low + RUN, "right")))
            a, b = start[first:last] - low, end[first:last] - low
            if last == first + 1 and b[0] > RUN:
                spread[first] = self._long(low, int(end[first]))
            else:
                powers = _power(_DOWN, np.arange(int(b[-1]), dtype=np.int64))
                sums = np.zeros(len(powers) + 1, np.uint64)
                np.cumsum((self.data[low : low + len(powers)].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
                spread[first:last] = (sums[b] - sums[a]) * _power(_UP, a)
            first = last
        return mixed(spread + (end - start).astype(np.uint64) * _STEP)

    def _long(self, start: int, end: int) -> np.uint64:
        """The sum over one word that is longer than a run."""
        total = np.zeros(1, np.uint64)
        for at in range(start, end, RUN):
            part = self.data[at : min(at + RUN, end)].astype(np.uint64) + np.uint64(1)
            total += (part * _power(_DOWN, np.arange(at - start, at - start + len(part), dtype=np.int64))).sum()
        return total[0]

    @cached_property
    def hash(self) -> np.ndarray:
        return self.hashes(self.start, self.end)


def hash_of(word: str) -> int:
    """The hash that ``Words`` gives to the bytes of a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    alone = Words(data, np.array([0, len(data)]), np.ones(len(data), bool))
    return int(alone.hash[0])


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    out = np.zeros(len(offsets) - 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        # Stretches without bytes take no part, so that each sum ends where the next begins.
        sums = np.add.reduceat(flags[: offsets[-1]], offsets[:-1][some], dtype=out.dtype)
        out[some] = sums
    return out


def per_word(flags: np.ndarray, words: Words) -> np.ndarray:
    """Sums of ``flags`` inside each word."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    bounds = np.column_stack([words.start, words.end]).ravel()
    if bounds[-1] == len(flags):
        bounds = bounds[:-1]
    # Every second stretch is between words; two words that touch leave one of the value after the cut, not looked at.
    return np.add.reduceat(flags, bounds, dtype=np.int64)[::2]
