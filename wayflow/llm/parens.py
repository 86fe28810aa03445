"""Balanced parentheses of a forest in preorder, with the range minima of their excess in blocks of blocks."""

from __future__ import annotations

import numpy as np

BLOCK = 64


def _first(values: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each start the first place from it to the end of its block whose value is at most the target, else -1."""
    stop = np.minimum((start // BLOCK + 1) * BLOCK, len(values))
    at, found = start.copy(), np.full(len(start), -1, np.int64)
    live = np.flatnonzero(at < stop)
    while len(live):
        hit = values[at[live]] <= target[live]
        found[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < stop[live]]
    return found


class Parens:
    """``bits`` are 1 for an opening parenthesis (a node), 0 for a closing one."""

    def __init__(self, bits: np.ndarray):
        self.opens = np.flatnonzero(bits)
        self.rank = np.cumsum(bits, dtype=np.int64)  # openings up to and with each place
        leaf = np.zeros(len(bits), np.int64)
        leaf[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaves = np.cumsum(leaf)  # pairs "()" that begin up to and at each place
        self._levels = [np.cumsum(2 * bits.astype(np.int64) - 1)]
        while len(self._levels[-1]) > 1:
            below = self._levels[-1]
            self._levels.append(np.minimum.reduceat(below, np.arange(0, len(below), BLOCK)))

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening one: the first behind it where the excess falls below its own."""
        target = self._levels[0][opens] - 1
        out, at = np.full(len(opens), -1, np.int64), opens + 1
        live, trail = np.arange(len(opens)), []
        for values in self._levels:
            found = _first(values, at, target[live])
            trail.append((live[found >= 0], found[found >= 0]))
            live, at = live[found < 0], at[found < 0] // BLOCK + 1
        for level in range(len(self._levels) - 1, -1, -1):
            who, place = trail[level]
            for values in self._levels[:level][::-1]:
                place = _first(values, place * BLOCK, target[who])
            out[who] = place
        return out
