"""A quantile sketch of compactors whose levels can be read.

Level h holds values that stand for 2**h each. A level that is over its capacity is sorted and every other value goes one level up, so
the weights of all values always add up to how many were seen. Capacities fall from the top level downwards by the shrinking
factor. Sketches merge level by level. Which of two neighbours goes up is drawn by a generator that begins from the sketch's count, so
equal inputs give equal sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

#: Capacity that no level falls below, and least size of a sketch.
LEAST, LEAST_SIZE = 2, 8


class Compactors:
    def __init__(self, size: int, shrink: float, levels: Iterable[Iterable[float]] = ()):
        self.size, self.shrink = max(LEAST_SIZE, size), shrink
        self.levels = [np.asarray(x, np.float64) for x in levels] or [np.zeros(0)]

    @property
    def n(self) -> int:
        return sum(len(x) << h for h, x in enumerate(self.levels))

    def capacity(self, h: int) -> int:
        return max(LEAST, math.ceil(self.size * self.shrink ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> Compactors:
        self.levels[0] = np.concatenate([self.levels[0], values])
        return self.compact()

    def merge(self, other: Compactors) -> Compactors:
        for h, x in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[h] = np.concatenate([self.levels[h], x])
        return self.compact()

    def compact(self) -> Compactors:
        """Levels over capacity are halved upwards, from the lowest on, while the sketch as a whole is too large."""
        draw = np.random.default_rng(self.n)
        while sum(map(len, self.levels)) > sum(self.capacity(h) for h in range(len(self.levels))):
            h = next(h for h, x in enumerate(self.levels) if len(x) > self.capacity(h))
            values = np.sort(self.levels[h])
            even = len(values) // 2 * 2
            if h + 1 == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[h] = values[even:]
            self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[int(draw.integers(2)):even:2]])
        return self


def weighted(levels: Iterable[Iterable[float]]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the levels in order, and how many values up to each stand for."""
    parts = [np.asarray(x, np.float64) for x in levels]
    values = np.concatenate([np.zeros(0), *parts])
    weight = np.concatenate([np.zeros(0, np.int64), *(np.full(len(x), 1 << h, np.int64) for h, x in enumerate(parts))])
    order = np.argsort(values, kind="stable")
    return values[order], np.cumsum(weight[order])


def quantiles(levels: Iterable[Iterable[float]], at: Iterable[float]) -> list[float]:
    """The values at the shares of all that the levels stand for."""
    values, up_to = weighted(levels)
    if not len(values):
        return []
    return [float(values[min(len(values) - 1, int(np.searchsorted(up_to, q * up_to[-1] - 1e-9)))]) for q in at]


def rank(levels: Iterable[Iterable[float]], value: float) -> int:
    """How many of the values that the levels stand for are at most this one."""
    values, up_to = weighted(levels)
    at = int(np.searchsorted(values, value, side="right"))
    return int(up_to[at - 1]) if at else 0
