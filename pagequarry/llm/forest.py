"""Union of links inside one task: numpy arrays in, a spanning forest out."""

from __future__ import annotations

import numpy as np


class Forest:
    """Groups of ``0..n-1``; a group is named by its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def roots(self) -> np.ndarray:
        """The name of each member's group."""
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the groups of ``a[i]`` and ``b[i]`` for every i."""
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
