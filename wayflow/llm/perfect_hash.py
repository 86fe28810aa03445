"""Minimal perfect hashing of sets of 64-bit hashes, in numpy.

Keys go to a bit array somewhat larger than their number; those that are alone at their bit keep it, the others go on to a next, smaller array, until none is
left. A key's number is the rank of its bit among all bits set, so n keys get the numbers 0 to n - 1. Other hashes get a number too, or -1: a
caller compares with the key that is stored under the number.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: Bits for each key of a level.
ROOM = 1.6


class PerfectHash:
    """Numbers of distinct hashes. About three bits a key and half of that for the ranks."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        words, self._starts, self._sizes = [], [], []
        rest, bits = hashes, 0
        while len(rest):
            if len(self._sizes) > 100:
                raise ValueError("hashes are not distinct")
            size = 64 * (1 + int(ROOM * len(rest)) // 64)
            at = self._place(rest, len(self._sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            words.append(np.packbits(level, bitorder="little").view("<u8"))
            self._starts.append(bits)
            self._sizes.append(size)
            bits += size
            rest = rest[~alone]
        self._words = np.concatenate(words) if words else np.zeros(0, _U)
        counts = np.bitwise_count(self._words).astype(np.int64)
        self._before = np.cumsum(counts) - counts

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + _U(_STEP * (level + 1) % (1 << 64))) % _U(size)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 or any number for hashes that were not given."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (start, size) in enumerate(zip(self._starts, self._sizes, strict=True)):
            bit = self._place(hashes[left], level, size) + start
            word, shift = self._words[bit >> 6], (bit & 63).astype(_U)
            hit = (word >> shift) & _U(1) == 1
            lower = word & ((_U(1) << shift) - _U(1))
            out[left[hit]] = (self._before[bit >> 6] + np.bitwise_count(lower))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out
