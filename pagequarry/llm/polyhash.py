"""Prefix polynomial hashes: the name of any span of a sequence from two entries of an array.

A sequence s has the sums ``S[i] = s[0] + s[1] B + ... + s[i-1] B^(i-1)`` modulo a prime. The span
from i to j has the name ``(S[j] - S[i]) / B^i``, which depends only on what stands there: equal
spans have equal names wherever they are. Two bases give 62 bits. Everything works on whole
arrays of places at once.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
BASES = (1_234_567_891, 987_654_321)
_P, _SHIFT = np.uint64(PRIME), np.uint64(31)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo the prime, for i below ``n``."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % _P
        done += more
    return out


class Powers:
    """Powers of the bases and of their inverses, made once for the longest sequence so far."""

    def __init__(self, bases: tuple[int, ...] = BASES):
        self.bases = bases
        self.size = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def upto(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 12)
            self.up = [powers(b, self.size) for b in self.bases]
            self.down = [powers(pow(b, -1, PRIME), self.size) for b in self.bases]


class Prefixes:
    """The prefix arrays of a sequence of numbers from 0 to below 2**31 - 2."""

    def __init__(self, symbols: np.ndarray, made: Powers):
        made.upto(len(symbols) + 1)
        self.size = len(symbols)
        self.down = made.down
        plain = symbols.astype(np.uint64) + np.uint64(1)  # no symbol counts as nothing
        self.sums = []
        for up in made.up:
            sums = np.zeros(len(plain) + 1, np.uint64)
            np.cumsum(plain * up[: len(plain)] % _P, out=sums[1:])
            self.sums.append(sums % _P)

    def part(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The name of each span under one base: 31 bits."""
        sums = self.sums[which]
        return (sums[stop] + (_P - sums[start])) % _P * self.down[which][start] % _P

    def names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The names of the spans from ``start[i]`` to before ``stop[i]``."""
        name = self.part(0, start, stop)
        for which in range(1, len(self.sums)):
            name = (name << _SHIFT) | self.part(which, start, stop)
        return name

    def extensions(self, a: np.ndarray, b: np.ndarray, least: int | np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the sequence is the same from ``a[i]`` and from ``b[i]`` on, by binary search.

        The answer is known to be at least ``least``, and at most ``most`` is looked at.
        """
        low, high = np.broadcast_to(least, a.shape).copy(), most.copy()
        while (open_ := np.nonzero(low < high)[0]).size:
            half = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            same = self.names(x, x + half) == self.names(y, y + half)
            low[open_[same]] = half[same]
            high[open_[~same]] = half[~same] - 1
        return low
