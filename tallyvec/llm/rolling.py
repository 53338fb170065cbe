"""Polynomial fingerprints of all windows of a byte or word sequence, in numpy.

A window's fingerprint depends on its content only, not on where it stands, so equal
windows of different documents get equal numbers. Arithmetic is modulo 2**64 with an odd
base and random letters; the known weakness of that modulus needs windows of over 2,000
units built for the purpose.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Roller:
    """Fingerprints with one base; ``powers`` grow with the longest sequence seen at once."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.letters = draw.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(draw.integers(0, 2**64, dtype=np.uint64)) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self._tables(1024)

    def _tables(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        rest = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
        self.powers, self.inverses = (np.multiply.accumulate(np.concatenate([one, x])) for x in rest)

    def _prefix(self, units: np.ndarray) -> np.ndarray:
        if len(units) + 1 > len(self.powers):
            self._tables(2 * len(units))
        out = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.powers[: len(units)], out=out[1:])
        return out

    def at(self, units: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows at ``starts`` (ascending), which must all fit."""
        parts = []
        lo = 0
        while lo < len(starts):
            first = int(starts[lo])
            hi = int(np.searchsorted(starts, first + SEGMENT))
            own = starts[lo:hi] - first
            piece = units[first : first + int(own[-1]) + width]
            if piece.dtype == np.uint8:
                piece = self.letters[piece]
            p = self._prefix(piece)
            parts.append(_mix((p[own + width] - p[own]) * self.inverses[own]))
            lo = hi
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the byte ranges ``[start, end)``, ascending and disjoint."""
        parts = []
        lo = 0
        while lo < len(starts):
            first = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, first + SEGMENT)))
            own, own_ends = starts[lo:hi] - first, ends[lo:hi] - first
            p = self._prefix(self.letters[buf[first : first + int(own_ends[-1])]])
            parts.append(_mix((p[own_ends] - p[own]) * self.inverses[own]))
            lo = hi
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
