"""Values that analyzers produce."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.kll import quantiles


@dataclass(frozen=True)
class Metric:
    """One number: what it is about, and its name."""

    entity: str
    instance: str
    name: str
    value: float

    def asDict(self) -> dict[str, Any]:
        return {"entity": self.entity, "instance": self.instance, "name": self.name, "value": self.value}


@dataclass(frozen=True)
class Outcome:
    """What an analyzer gave: a value (a number, a distribution or numbers by key), or the reason of failure."""

    value: Any = None
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


@dataclass(frozen=True)
class DistributionValue:
    value: str
    absolute: int
    ratio: float

    @property
    def count(self) -> int:
        return self.absolute


@dataclass(frozen=True)
class Distribution:
    """Counts and shares by value; numberOfBins also counts bins whose details are cut off."""

    values: dict[str, DistributionValue]
    numberOfBins: int

    def __getitem__(self, key: str) -> DistributionValue:
        return self.values[key]

    def apply(self, key: str) -> DistributionValue:
        return self.values[key]

    @property
    def argmax(self) -> str:
        return max(self.values, key=lambda k: self.values[k].absolute)


@dataclass(frozen=True)
class BucketValue:
    lowValue: float
    highValue: float
    count: int

    @property
    def low_value(self) -> float:
        return self.lowValue

    @property
    def high_value(self) -> float:
        return self.highValue


@dataclass(frozen=True)
class BucketDistribution:
    """Equal-width buckets between minimum and maximum, and the levels of a quantile sketch.

    A value of level h of ``data`` stands for 2**h values.
    """

    buckets: list[BucketValue]
    parameters: list[float]
    data: list[list[float]] = field(default_factory=list)

    def apply(self, i: int) -> BucketValue:
        return self.buckets[i]

    def computePercentiles(self) -> list[float]:
        """The values at 1, 2, ..., 100 per cent."""
        return quantiles(self.data, [i / 100 for i in range(1, 101)])

    @property
    def argmax(self) -> int:
        return max(range(len(self.buckets)), key=lambda i: self.buckets[i].count)
