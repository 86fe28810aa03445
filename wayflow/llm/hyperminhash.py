"""HyperMinHash registers of a set of 64-bit hashes.

Each bucket has a hash function of its own (so short texts leave no bucket empty). Of a bucket's
smallest 32-bit value the register keeps the number of leading zeros and the next few bits:
5 + 3 bits here, one byte a bucket.
"""

from __future__ import annotations

import functools

import numpy as np

MANTISSA_BITS = 3
_LEADING = 31  # more leading zeros count as so many


@functools.cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240229))
    return r.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def registers(items: np.ndarray, n: int) -> np.ndarray:
    """``n`` registers of a non-empty set."""
    a, b = _functions(n)
    x = (items ^ (items >> np.uint64(32))).astype(np.uint32)[:, None]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 128):
        v = x[i : i + 128] * a
        v += b
        v ^= v >> np.uint32(15)
        np.minimum(least, v.min(axis=0), out=least)
    bits = np.maximum(least, 1).astype(np.float64).view(np.uint64)
    leading = np.minimum(31 - ((bits >> np.uint64(52)).astype(np.int64) - 1023), _LEADING)
    mantissa = (bits >> np.uint64(52 - MANTISSA_BITS)).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    return ((leading << MANTISSA_BITS) | mantissa).astype(np.uint8)


@functools.cache
def chance(n: int, m: int) -> float:
    """Probability that one register is equal for two disjoint sets of ``n`` and ``m`` items."""
    zeros = np.arange(_LEADING + 1, dtype=np.float64)[:, None]
    steps = np.arange(1 << MANTISSA_BITS, dtype=np.float64)[None, :] / (1 << MANTISSA_BITS)
    low = np.exp2(-zeros - 1) * (1 + steps)
    high = low + np.exp2(-zeros - 1) / (1 << MANTISSA_BITS)
    p, q = ((1 - low) ** k - (1 - np.minimum(high, 1)) ** k for k in (n, m))
    return float((p * q).sum())


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray, count: int) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less what chance makes equal.

    Sizes go into the correction rounded to powers of sqrt(2).
    """
    size = lambda k: np.exp2(np.round(2 * np.log2(np.maximum(k, 1))) / 2).astype(np.int64)
    c = np.array([chance(int(x), int(y)) for x, y in zip(size(n), size(m), strict=True)])
    return np.clip((equal / count - c) / (1 - c), 0, 1)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """64-bit keys of ``bands`` runs of registers, for each row of a matrix; the band's number is part of the key."""
    from .words import mix

    rows = regs.shape[1] // bands
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :].repeat(len(regs), 0)
    grouped = regs[:, : bands * rows].reshape(len(regs), bands, rows)
    for k in range(rows):
        out = mix(out + grouped[:, :, k] + np.uint64(1))
    return out.view(np.int64)
