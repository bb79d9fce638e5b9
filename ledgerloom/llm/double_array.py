"""A double-array trie over dense symbol numbers.

A state s moves by symbol c to ``base[s] + c`` if ``check`` there is s. The root is state 0.
Bases may be negative, so a state with one child can use any free place.
"""

from __future__ import annotations

import numpy as np

_WINDOW = 64  # places tried at once for a state with several children
_TRIES = 16  # so often, then the children go to the end


class DoubleArray:
    def __init__(self) -> None:
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0
        self._low = self._top = 1  # nothing is free below low, nothing is taken from top on

    def _reserve(self, places: int) -> None:
        if places > len(self.check):
            more = max(places, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _fit(self, symbols: np.ndarray) -> int:
        """A base at which places for all these symbols are free."""
        steps, begin = symbols - symbols[0], self._low
        for _ in range(_TRIES):
            if begin >= self._top:
                break
            free = begin + np.flatnonzero(self.check[begin : begin + _WINDOW] < 0)
            if len(free):
                self._reserve(int(free[-1] + steps[-1]) + 1)
                fits = np.flatnonzero((self.check[free[:, None] + steps] < 0).all(axis=1))
                if len(fits):
                    return int(free[fits[0]] - symbols[0])
            begin += _WINDOW
        return int(self._top - symbols[0])

    def _take(self, parent: int, base: int, symbols: np.ndarray) -> None:
        places = base + symbols
        self._reserve(int(places[-1]) + 1)
        self.base[parent] = base
        self.check[places] = parent
        self._top = max(self._top, int(places[-1]) + 1)

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Gives states without children theirs; distinct pairs in order of parent, then symbol. Returns the children."""
        cuts = np.flatnonzero(np.diff(parents, prepend=-1, append=-1))
        lone = np.diff(cuts) == 1
        for low, high in zip(cuts[:-1][~lone].tolist(), cuts[1:][~lone].tolist()):
            self._take(int(parents[low]), self._fit(symbols[low:high]), symbols[low:high])
            while self._low < self._top and self.check[self._low] >= 0:
                self._low += 1
        single = cuts[:-1][lone]
        if len(single):
            free = self._low + np.flatnonzero(self.check[self._low : self._top] < 0)[: len(single)]
            free = np.concatenate([free, self._top + np.arange(len(single) - len(free))])
            self._reserve(int(free[-1]) + 1)
            self.base[parents[single]] = free - symbols[single]
            self.check[free] = parents[single]
            self._low, self._top = int(free[-1]) + 1, max(self._top, int(free[-1]) + 1)
        return self.base[parents] + symbols

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states that these lead to; -1 where there is no such child."""
        places = self.base[states] + symbols
        known = (places >= 0) & (places < len(self.check))
        places = np.where(known, places, 0)
        return np.where(known & (places > 0) & (self.check[places] == states), places, -1)
