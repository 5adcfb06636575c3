"""Anomaly detection on the history of one metric."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

import numpy as np


class MetricInterval(Enum):
    Daily = "Daily"
    Monthly = "Monthly"


class SeriesSeasonality(Enum):
    Weekly = "Weekly"
    Yearly = "Yearly"


class AnomalyDetectionStrategy:
    """Judges the newest value of a series, given in order of time."""

    def problem(self, history: Sequence[float]) -> str | None:
        """Why the history is too short to judge, if it is and that is a failure."""
        return None

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        raise NotImplementedError


def inside(value: float, low: float | None, high: float | None) -> bool:
    return (low is None or value >= low) and (high is None or value <= high)


@dataclass(frozen=True)
class SimpleThresholdStrategy(AnomalyDetectionStrategy):
    lowerBound: float | None = None
    upperBound: float | None = None

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        return inside(newest, self.lowerBound, self.upperBound)


@dataclass(frozen=True)
class AbsoluteChangeStrategy(AnomalyDetectionStrategy):
    """Bounds on the difference of the given order; order 0 bounds the value itself."""

    maxRateDecrease: float | None = None
    maxRateIncrease: float | None = None
    order: int = 1

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        series = [*history, newest]
        if len(series) <= self.order:
            return True
        change = float(np.diff(series, self.order)[-1]) if self.order else newest
        return inside(change, self.maxRateDecrease, self.maxRateIncrease)


@dataclass(frozen=True)
class RelativeRateOfChangeStrategy(AnomalyDetectionStrategy):
    """Bounds on the newest value over the one ``order`` steps before; order 0 bounds the value itself."""

    maxRateDecrease: float | None = None
    maxRateIncrease: float | None = None
    order: int = 1

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        if len(history) < self.order:
            return True
        if not self.order:
            return inside(newest, self.maxRateDecrease, self.maxRateIncrease)
        before = history[-self.order]
        if before == 0:
            rate = math.nan if newest == 0 else math.copysign(math.inf, newest)
            return math.isnan(rate) or inside(rate, self.maxRateDecrease, self.maxRateIncrease)
        return inside(newest / before, self.maxRateDecrease, self.maxRateIncrease)


class RateOfChangeStrategy(AnomalyDetectionStrategy):
    """Deprecated; use AbsoluteChangeStrategy."""

    def __init__(self, *_: object, **__: object):
        raise DeprecationWarning("RateOfChangeStrategy is deprecated; use AbsoluteChangeStrategy")


@dataclass(frozen=True)
class OnlineNormalStrategy(AnomalyDetectionStrategy):
    """Bounds of running mean and deviation, the current point included; anomalous points can be left out of both."""

    lowerDeviationFactor: float | None = 3.0
    upperDeviationFactor: float | None = 3.0
    ignoreStartPercentage: float = 0.1
    ignoreAnomalies: bool = True

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        series = [*history, newest]
        skip = len(series) * self.ignoreStartPercentage
        n, mean, m2, good = 0, 0.0, 0.0, True
        for i, x in enumerate(series):
            before = n, mean, m2
            n += 1
            gap = x - mean
            mean += gap / n
            m2 += gap * (x - mean)
            sd = math.sqrt(m2 / n)
            low = None if self.lowerDeviationFactor is None else mean - self.lowerDeviationFactor * sd
            high = None if self.upperDeviationFactor is None else mean + self.upperDeviationFactor * sd
            good = i < skip and i < len(series) - 1 or inside(x, low, high)
            if not good and self.ignoreAnomalies:
                n, mean, m2 = before
        return good


@dataclass(frozen=True)
class BatchNormalStrategy(AnomalyDetectionStrategy):
    """Bounds of mean and sample deviation of the history, with the judged point only if asked."""

    lowerDeviationFactor: float | None = 3.0
    upperDeviationFactor: float | None = 3.0
    includeInterval: bool = False

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        base = [*history, newest] if self.includeInterval else list(history)
        if not base:
            return True
        mean = float(np.mean(base))
        sd = float(np.std(base, ddof=1)) if len(base) > 1 else 0.0
        low = None if self.lowerDeviationFactor is None else mean - self.lowerDeviationFactor * sd
        high = None if self.upperDeviationFactor is None else mean + self.upperDeviationFactor * sd
        return inside(newest, low, high)


@dataclass(frozen=True)
class HoltWinters(AnomalyDetectionStrategy):
    """Additive Holt-Winters: the newest value against the forecast from all before, for two cycles at least.

    ``weights``: those of level, trend and season, fitted to each history if left out.
    """

    metricsInterval: MetricInterval = MetricInterval.Daily
    seasonality: SeriesSeasonality = SeriesSeasonality.Weekly
    weights: tuple[float, float, float] | None = None

    @property
    def period(self) -> int:
        periods = {(MetricInterval.Daily, SeriesSeasonality.Weekly): 7, (MetricInterval.Monthly, SeriesSeasonality.Yearly): 12}
        if (self.metricsInterval, self.seasonality) not in periods:
            raise ValueError(f"{self.metricsInterval.value} metrics with {self.seasonality.value} seasonality are not supported")
        return periods[self.metricsInterval, self.seasonality]

    def problem(self, history: Sequence[float]) -> str | None:
        need = 2 * self.period
        return f"Need at least two full cycles of data, {need} values, to estimate the model; found {len(history)}!" if len(history) < need else None

    def run(self, y: np.ndarray, a: float, b: float, g: float) -> tuple[np.ndarray, float]:
        """One-step errors of the fit, and the forecast of the next value."""
        p = self.period
        level, trend = y[:p].mean(), (y[p:2 * p].mean() - y[:p].mean()) / p
        season = list(y[:p] - level)
        errors = np.empty(len(y))
        for t, x in enumerate(y):
            s = season[t % p]
            errors[t] = x - (level + trend + s)
            new = a * (x - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[t % p] = g * (x - new) + (1 - g) * s
            level = new
        return errors, float(level + trend + season[len(y) % p])

    def fit(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Smoothing weights of least squared error: a coarse grid, then steps of halving size."""
        if self.weights is not None:
            return self.run(y, *self.weights)
        cost = lambda w: float((self.run(y, *w)[0] ** 2).sum())
        grid = [0.05, 0.3, 0.6, 0.9]
        best = min(((a, b, g) for a in grid for b in grid for g in grid), key=cost)
        step = 0.15
        while step > 0.01:
            near = [tuple(min(1.0, max(0.0, x + d)) if i == j else x for j, x in enumerate(best)) for i in range(3) for d in (-step, step)]
            new = min(near, key=cost)
            if cost(new) < cost(best) - 1e-12:
                best = new
            else:
                step /= 2
        return self.run(y, *best)

    def is_normal(self, history: Sequence[float], newest: float) -> bool:
        errors, forecast = self.fit(np.asarray(history, float))
        off = abs(newest - forecast)
        return off <= max(1.96 * float(errors.std()), 1e-9)

    def verdicts(self, values: Sequence[float]) -> list[bool | None]:
        """What is_normal says of each value after those before it, under fixed weights, in one pass.

        The start of the recurrence and its errors are of the first values alone, so a longer history only goes on.
        """
        p = self.period
        if len(values) <= 2 * p:
            return [None] * len(values)
        errors, _ = self.run(np.asarray(values, float), *self.weights)
        n = np.arange(1, len(errors) + 1)
        spread = np.sqrt(np.maximum(np.cumsum(errors**2) / n - (np.cumsum(errors) / n) ** 2, 0.0))
        return [None if i < 2 * p else bool(abs(errors[i]) <= max(1.96 * spread[i - 1], 1e-9)) for i in range(len(errors))]
