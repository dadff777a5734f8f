"""Elias-Fano sequences in NumPy: monotone numbers in little more than their low bits."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Numbers written at a time, so that a sequence takes little memory beside its own.
_BLOCK = 1 << 18


class EliasFano:
    """``n`` numbers (uint64, not falling).  Low bits are packed end to end; high parts are a
    bit vector, a one for each number after as many zeros as its high part says.  A count of
    zeros before each 64 bits leads a search to its place."""

    FIELDS = ("shape", "low", "high", "zeros")

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.shape, self.low, self.high, self.zeros = shape, low, high, zeros
        self.n, self.width = int(shape[0]), int(shape[1])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = _packed(values, width)
        bits = ((top >> width) + n if n else 0) + 3
        high = np.zeros(-(-bits // 64), np.uint64)
        for i in range(0, n, _BLOCK):
            heads = (values[i : i + _BLOCK] >> np.uint64(width)).astype(np.int64)
            heads += np.arange(i, i + len(heads))
            np.bitwise_or.at(high, heads >> 6, _ONE << (heads & 63).astype(np.uint64))
        zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        return cls(np.array([n, width]), low, high, np.append(0, zeros[:-1]))

    def _low_at(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        found = self.low[word] >> shift
        # A shift by 64 is undefined, so the next word goes up in two steps.
        found |= (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return found & _ones(self.width)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) in the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[word]
        bits = ~self.high[word]
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & _ones(width)).astype(np.int64)
            over = rest >= below
            rest -= np.where(over, below, 0)
            bits = np.where(over, bits >> np.uint64(width), bits)
            place += np.where(over, width, 0)
        return place

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number that is not less than each of ``values`` (n if none is)."""
        values = np.asarray(values, np.uint64)
        if not self.n:
            return np.zeros(len(values), np.int64)
        last = len(self.high) * 64 - self.n - 1
        head = np.minimum(values >> np.uint64(self.width), np.uint64(last)).astype(np.int64)
        beyond = head >= last
        head = np.minimum(head, last - 1)
        low = np.where(head > 0, self._zero(np.maximum(head - 1, 0)) + 1 - head, 0)
        high = np.minimum(self._zero(head) - head, self.n)
        low = np.minimum(low, high)
        tail = values & _ones(self.width)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self._low_at(middle) < tail[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        low[beyond] = self.n
        return low

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each of ``values``, -1 where it is not there."""
        at = self.successor(values)
        there = at < self.n
        there[there] = self.at(at[there]) == np.asarray(values, np.uint64)[there]
        return np.where(there, at, -1)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The numbers at ``index``."""
        ones = np.arange(len(self.high)) * 64 - self.zeros
        word = np.searchsorted(ones, index, side="right") - 1
        rest = index - ones[word]
        bits = self.high[word].copy()
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & _ones(width)).astype(np.int64)
            over = rest >= below
            rest -= np.where(over, below, 0)
            bits = np.where(over, bits >> np.uint64(width), bits)
            place += np.where(over, width, 0)
        return ((place - index).astype(np.uint64) << np.uint64(self.width)) | self._low_at(index)


def _ones(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each number, end to end."""
    words = np.zeros(-(-len(values) * width // 64) + 2, np.uint64)
    for i in range(0, len(values) if width else 0, _BLOCK):
        low = values[i : i + _BLOCK] & _ones(width)
        bit = np.arange(i, i + len(low)) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, low << shift)
        np.bitwise_or.at(words, word + 1, (low >> (np.uint64(63) - shift)) >> _ONE)
    return words
