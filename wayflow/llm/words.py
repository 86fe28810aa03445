"""Words and shingles of many texts at once, as arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
Bytes of one Arrow batch are handled together in blocks of bounded size, so that no Python
loop runs over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)[_LOWER]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in ((0, _BASE), (1, _INVERSE)):
            t = np.full(n, b, _U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a block of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of its first word (one more at the end). ``apart`` says of each byte whether it parts words."""
    word = ~apart[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, word
    before[at] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, word
    after[at] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles as 64-bit hashes.

    A text of fewer than ``size`` words has its whole sequence as one shingle, one without words has none.
    """
    data, at = utf8(column)
    factors = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
    for i, j in blocks(at):
        part, cuts = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = word_spans(part, cuts)
        hashes = word_hashes(part, starts, ends)
        n = max(0, len(hashes) - size + 1)
        rolled = np.zeros(n, _U)
        for k in range(size):
            rolled += hashes[k : k + n] * factors[k]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                yield mix(np.sum(hashes[a:b] * factors[: b - a], keepdims=True) + _U(b - a))
            else:
                yield np.zeros(0, _U)
