"""Anomaly strategies over many series at once: every value of every series is judged by those before it, in one job.

Simple bounds, changes and normal bounds are window expressions. Strategies that carry state from value to value (online bounds that
leave anomalies out, Holt-Winters) run once over each series, in grouped Arrow batches; a series is a history of metrics and fits a task.

Null values are no points: they are not judged, and not part of any history. Values of one time keep no certain order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyzers import col
from .anomaly import (
    AbsoluteChangeStrategy,
    AnomalyDetectionStrategy,
    BatchNormalStrategy,
    HoltWinters,
    OnlineNormalStrategy,
    RelativeRateOfChangeStrategy,
    SimpleThresholdStrategy,
)


def between(value: Column, low: Column | float | None, high: Column | float | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high)
    return out


def window_verdict(strategy: AnomalyDetectionStrategy, value: Column, by: Sequence[str], time: str) -> Column | None:
    """Whether a value is normal, as an expression over its series; None for strategies that are no such expression."""
    own = Window.partitionBy(*[col(c) for c in by]).orderBy(col(time))
    before, until = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    if isinstance(strategy, SimpleThresholdStrategy):
        return between(value, strategy.lowerBound, strategy.upperBound)
    if isinstance(strategy, AbsoluteChangeStrategy):
        k = strategy.order
        change = value
        for i in range(1, k + 1):
            change = change + F.lag(value, i).over(own) * F.lit(float((-1) ** i * math.comb(k, i)))
        return F.coalesce(between(change, strategy.maxRateDecrease, strategy.maxRateIncrease), F.lit(True))
    if isinstance(strategy, RelativeRateOfChangeStrategy):
        low, high = strategy.maxRateDecrease, strategy.maxRateIncrease
        if not strategy.order:
            return between(value, low, high)
        earlier = F.lag(value, strategy.order).over(own)
        at_zero = F.when(value == 0, True).otherwise(between(F.signum(value) * F.lit(math.inf), low, high))
        return F.when(earlier.isNull(), True).when(earlier == 0, at_zero).otherwise(between(F.try_divide(value, earlier), low, high))
    if isinstance(strategy, BatchNormalStrategy):
        base = until if strategy.includeInterval else before
        mean, sd = F.avg(value).over(base), F.coalesce(F.stddev_samp(value).over(base), F.lit(0.0))
        return F.coalesce(_normal(value, mean, sd, strategy), F.lit(True))
    if isinstance(strategy, OnlineNormalStrategy) and not strategy.ignoreAnomalies:
        return _normal(value, F.avg(value).over(until), F.stddev_pop(value).over(until), strategy)
    return None


def _normal(value: Column, mean: Column, sd: Column, strategy: BatchNormalStrategy | OnlineNormalStrategy) -> Column:
    low, high = strategy.lowerDeviationFactor, strategy.upperDeviationFactor
    return between(value, None if low is None else mean - sd * low, None if high is None else mean + sd * high)


def recurrence(strategy: AnomalyDetectionStrategy, values: Sequence[float]) -> list[bool | None]:
    """The verdict on each value by those before it; None where they are too few to judge."""
    if isinstance(strategy, HoltWinters) and strategy.weights is not None:
        return strategy.verdicts(values)
    return [None if strategy.problem(values[:i]) is not None else bool(strategy.is_normal(values[:i], v)) for i, v in enumerate(values)]


def judge_series(history: DataFrame, strategy: AnomalyDetectionStrategy, by: Sequence[str], value: str = "value", time: str = "dataset_date",
                 verdict: str = "normal") -> DataFrame:
    """The rows of the history that have a value, with a column that tells whether it is normal after all earlier ones of its series.

    Null verdicts: the history is too short for the strategy.
    """
    if verdict in history.columns:
        raise ValueError(f"The history has a column {verdict} already")
    rows = history.where(col(value).isNotNull())
    said = window_verdict(strategy, col(value).cast("double"), by, time)
    if said is not None:
        return rows.withColumn(verdict, said)

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(time, kind="stable")
        return series.assign(**{verdict: pd.array(recurrence(strategy, [float(x) for x in series[value]]), dtype="boolean")})

    schema = T.StructType([*rows.schema.fields, T.StructField(verdict, T.BooleanType())])
    return rows.groupBy(*[col(c) for c in by]).applyInPandas(one, schema)
