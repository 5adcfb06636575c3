"""Analyzers: immutable descriptions of metrics that compile to Spark expressions.

Scan analyzers give aggregate columns, which the planner fuses into one aggregation.
Grouping analyzers share one frequency table for each set of columns and filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import VALUE_CLASSES, DataTypeInstances, is_nested, is_numeric, value_class
from .metrics import BucketDistribution, BucketValue, Distribution, DistributionValue, Metric

__all__ = ["ApproxCountDistinct", "ApproxQuantile", "ApproxQuantiles", "Completeness", "Compliance", "Correlation",
           "CountDistinct", "DataType", "DataTypeInstances", "Distinctness", "Entropy", "Histogram", "KLLParameters",
           "KLLSketch", "Maximum", "MaxLength", "Mean", "Minimum", "MinLength", "MutualInformation", "PatternMatch", "Size",
           "StandardDeviation", "Sum", "Uniqueness", "UniqueValueRatio"]

#: What the null bin of a histogram is called.
NULL_LABEL = "NullValue"
MAX_DETAIL_BINS = 1000


class EmptyState(Exception):
    """No row had a value to compute the metric from."""


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(columns: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


class Analyzer:
    """Base of all: name, what the metric is about, and preconditions on the schema."""

    entity = "Column"
    filterable = True

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def columns(self) -> tuple[str, ...]:
        own = getattr(self, "column", None)
        return (own,) if own is not None else ()

    @property
    def instance(self) -> str:
        return ",".join(self.columns) or "*"

    @property
    def key(self) -> str:
        """Identity across sessions: kind, parameters and filter."""
        return repr(self)

    def with_where(self, where: str) -> Analyzer:
        return replace(self, where=where)  # type: ignore[type-var]

    def precondition(self, schema: T.StructType) -> str | None:
        """Why the metric cannot be computed on this schema, if so."""
        for c in self.columns:
            if c not in schema.names:
                return f"Input data does not include column {c}!"
        for c in self.columns:
            if (said := self.type_problem(c, schema[c].dataType)) is not None:
                return said
        return None

    def type_problem(self, column: str, kind: T.DataType) -> str | None:
        return None

    def rows(self, value: Any) -> list[Metric]:
        """The value as metric rows."""
        return [Metric(self.entity, self.instance, self.name, float(value))]


class ScanAnalyzer(Analyzer):
    """A metric from aggregate columns over one scan."""

    def aggregates(self, schema: T.StructType) -> list[Column]:
        raise NotImplementedError

    def value(self, got: list[Any]) -> Any:
        if got[0] is None:
            raise EmptyState(f"Empty state for analyzer {self.key}, all input values were NULL.")
        return float(got[0])

    def rows_kept(self) -> Column:
        where = getattr(self, "where", None)
        return F.count(F.lit(1)) if where is None else F.count(F.when(F.expr(where), 1))

    def kept(self, value: Column) -> Column:
        """The value in rows that pass the filter, else null."""
        where = getattr(self, "where", None)
        return value if where is None else F.when(F.expr(where), value)

    def hits(self, predicate: Column) -> Column:
        """Rows where the predicate is true; null is not."""
        return F.count(self.kept(F.when(predicate, 1)))


class NumericScan(ScanAnalyzer):
    def type_problem(self, column: str, kind: T.DataType) -> str | None:
        if not is_numeric(kind):
            return f"Expected type of column {column} to be numeric, but found {kind.simpleString()} instead!"
        return None

    def number(self) -> Column:
        return self.kept(col(self.columns[0]).cast("double"))


class TextScan(ScanAnalyzer):
    def type_problem(self, column: str, kind: T.DataType) -> str | None:
        if not isinstance(kind, T.StringType):
            return f"Expected type of column {column} to be StringType, but found {kind.simpleString()} instead!"
        return None


@dataclass(frozen=True)
class Size(ScanAnalyzer):
    """Number of rows."""

    where: str | None = None
    entity = "Dataset"

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [self.rows_kept()]


@dataclass(frozen=True)
class Completeness(ScanAnalyzer):
    """Share of rows where the column is not null."""

    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [share(F.count(self.kept(col(self.column))), self.rows_kept())]


@dataclass(frozen=True)
class Compliance(ScanAnalyzer):
    """Share of rows where a SQL predicate is true; a null predicate counts as false."""

    instance_name: str
    predicate: str
    where: str | None = None
    required: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.required

    @property
    def instance(self) -> str:
        return self.instance_name

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [share(self.hits(F.expr(self.predicate)), self.rows_kept())]


class PatternMatch(ScanAnalyzer):
    """Share of rows where the column contains a match of the regular expression."""

    def __init__(self, column: str, pattern_regex: str, *pattern_groupNames: str, where: str | None = None):
        if pattern_groupNames:
            raise NotImplementedError("Pattern group names are not supported")
        self.column, self.pattern, self.where = column, pattern_regex, where

    def __repr__(self) -> str:
        return f"PatternMatch(column={self.column!r}, pattern={self.pattern!r}, where={self.where!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, PatternMatch) and repr(self) == repr(other)

    def __hash__(self) -> int:
        return hash(repr(self))

    def with_where(self, where: str) -> PatternMatch:
        return PatternMatch(self.column, self.pattern, where=where)

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [share(self.hits(col(self.column).cast("string").rlike(self.pattern)), self.rows_kept())]


@dataclass(frozen=True)
class Minimum(NumericScan):
    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.min(self.number())]


@dataclass(frozen=True)
class Maximum(NumericScan):
    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.max(self.number())]


@dataclass(frozen=True)
class Mean(NumericScan):
    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.avg(self.number())]


@dataclass(frozen=True)
class Sum(NumericScan):
    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.sum(self.number())]


@dataclass(frozen=True)
class StandardDeviation(NumericScan):
    """Population standard deviation."""

    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.stddev_pop(self.number())]


@dataclass(frozen=True)
class MinLength(TextScan):
    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.min(F.length(self.kept(col(self.column))))]


@dataclass(frozen=True)
class MaxLength(TextScan):
    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.max(F.length(self.kept(col(self.column))))]


@dataclass(frozen=True)
class Correlation(NumericScan):
    """Pearson correlation over rows where both columns are not null."""

    column1: str
    column2: str
    where: str | None = None
    entity = "Multicolumn"

    @property
    def columns(self) -> tuple[str, ...]:
        return self.column1, self.column2

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.corr(*(self.kept(col(c).cast("double")) for c in self.columns))]


@dataclass(frozen=True)
class ApproxCountDistinct(ScanAnalyzer):
    """Distinct values, by a mergeable HyperLogLog++ sketch."""

    column: str
    where: str | None = None

    def type_problem(self, column: str, kind: T.DataType) -> str | None:
        return f"Distinct counts of {kind.simpleString()} are not supported" if isinstance(kind, T.MapType) else None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.approx_count_distinct(self.kept(col(self.column)))]


def quantiles(value: Column, at: list[float], error: float) -> Column:
    """Elements at the quantiles, by a sketch whose size is the error's inverse; without error the planner selects them instead."""
    return F.percentile_approx(value, at, 10_000 if error == 0 else max(1, math.ceil(1 / error)))


@dataclass(frozen=True)
class ApproxQuantile(NumericScan):
    """An element of the column at the quantile, within the relative error."""

    column: str
    quantile: float
    relativeError: float = 0.01
    where: str | None = None

    @property
    def name(self) -> str:
        return f"ApproxQuantile-{self.quantile}"

    def precondition(self, schema: T.StructType) -> str | None:
        if not 0 <= self.quantile <= 1 or not 0 <= self.relativeError <= 1:
            return "Quantile and relative error must lie between 0 and 1!"
        return super().precondition(schema)

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.element_at(quantiles(self.number(), [float(self.quantile)], self.relativeError), 1)]


@dataclass(frozen=True)
class ApproxQuantiles(NumericScan):
    """Elements of the column at several quantiles, a metric each."""

    column: str
    quantiles: Any
    relativeError: float = 0.01
    filterable = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "quantiles", tuple(float(q) for q in self.quantiles))

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [quantiles(self.number(), list(self.quantiles), self.relativeError)]

    def value(self, got: list[Any]) -> Any:
        if got[0] is None:
            raise EmptyState(f"Empty state for analyzer {self.key}, all input values were NULL.")
        return dict(zip(self.quantiles, map(float, got[0]), strict=True))

    def rows(self, value: Any) -> list[Metric]:
        return [Metric(self.entity, self.instance, f"ApproxQuantiles-{q}", v) for q, v in value.items()]


class HistogramRows(Analyzer):
    def rows(self, value: Any) -> list[Metric]:
        out = [Metric(self.entity, self.instance, "Histogram.bins", float(value.numberOfBins))]
        for v in value.values.values():
            out += [Metric(self.entity, self.instance, f"Histogram.abs.{v.value}", float(v.absolute)),
                    Metric(self.entity, self.instance, f"Histogram.ratio.{v.value}", v.ratio)]
        return out


@dataclass(frozen=True)
class DataType(HistogramRows, ScanAnalyzer):
    """How many values are of each class, judged by form for text."""

    column: str
    where: str | None = None

    def aggregates(self, schema: T.StructType) -> list[Column]:
        kind = value_class(col(self.column), schema[self.column].dataType)
        return [F.count(self.kept(F.when(kind == c, 1))) for c in VALUE_CLASSES]

    def value(self, got: list[Any]) -> Any:
        total = sum(got)
        if not total:
            raise EmptyState(f"Empty state for analyzer {self.key}, all input values were NULL.")
        return Distribution({c: DistributionValue(c, n, n / total) for c, n in zip(VALUE_CLASSES, got, strict=True)}, len(got))


class KLLParameters:
    """Parameters of a quantile sketch; the session argument may be left out."""

    def __init__(self, *args: Any):
        size, shrink, buckets = args[-3:]
        self.sketchSize, self.shrinkingFactor, self.numberOfBuckets = int(size), float(shrink), int(buckets)

    def __repr__(self) -> str:
        return f"KLLParameters({self.sketchSize}, {self.shrinkingFactor}, {self.numberOfBuckets})"

    def __eq__(self, other: object) -> bool:
        return repr(self) == repr(other)

    def __hash__(self) -> int:
        return hash(repr(self))


DEFAULT_KLL = KLLParameters(2048, 0.64, 100)


@dataclass(frozen=True)
class KLLSketch(NumericScan):
    """Exact counts in equal-width buckets between minimum and maximum, and the levels of a quantile sketch."""

    column: str
    kllParameters: KLLParameters | None = None
    filterable = False

    def number(self) -> Column:
        """NaN is left out, as no bucket holds it."""
        value = super().number()
        return F.when(~F.isnan(value), value)

    @property
    def parameters(self) -> KLLParameters:
        return self.kllParameters or DEFAULT_KLL

    def aggregates(self, schema: T.StructType) -> list[Column]:
        return [F.min(self.number()), F.max(self.number())]

    def distribution(self, low: float, high: float, levels: list[list[float]], counts: dict[int, int]) -> BucketDistribution:
        p = self.parameters
        step = (high - low) / p.numberOfBuckets
        edges = [low + i * step for i in range(p.numberOfBuckets)] + [high]
        buckets = [BucketValue(edges[i], edges[i + 1], counts.get(i, 0)) for i in range(p.numberOfBuckets)]
        return BucketDistribution(buckets, [p.shrinkingFactor, float(p.sketchSize)], [[float(x) for x in level] for level in levels])

    def rows(self, value: BucketDistribution) -> list[Metric]:
        out = [Metric(self.entity, self.instance, "KLL.buckets", float(len(value.buckets)))]
        for i, b in enumerate(value.buckets):
            out += [Metric(self.entity, self.instance, f"KLL.bucket.{i}.low", b.lowValue),
                    Metric(self.entity, self.instance, f"KLL.bucket.{i}.high", b.highValue),
                    Metric(self.entity, self.instance, f"KLL.bucket.{i}.count", float(b.count))]
        return out


@dataclass(frozen=True)
class FrequencyStats:
    """What grouping analyzers need of a frequency table."""

    groups: int
    rows: int
    singles: int
    c_log_c: float


class GroupingAnalyzer(Analyzer):
    """A metric from the frequency table of its columns."""

    @property
    def entity(self) -> str:  # type: ignore[override]
        return "Column" if len(set(self.columns)) == 1 else "Multicolumn"

    def type_problem(self, column: str, kind: T.DataType) -> str | None:
        return f"Cannot group by {kind.simpleString()}" if isinstance(kind, T.MapType) else None

    def from_stats(self, s: FrequencyStats) -> float:
        raise NotImplementedError

    def checked(self, s: FrequencyStats) -> float:
        if not s.rows:
            raise EmptyState(f"Empty state for analyzer {self.key}, all input values were NULL.")
        return float(self.from_stats(s))


class ColumnList(GroupingAnalyzer):
    @property
    def columns(self) -> tuple[str, ...]:
        return self._columns  # type: ignore[attr-defined]


def _list_fields(self: Any) -> None:
    object.__setattr__(self, "_columns", as_list(self._columns))


@dataclass(frozen=True)
class CountDistinct(ColumnList):
    _columns: Any
    filterable = False
    __post_init__ = _list_fields

    def from_stats(self, s: FrequencyStats) -> float:
        return s.groups


@dataclass(frozen=True)
class Distinctness(ColumnList):
    """Distinct values over rows."""

    _columns: Any
    where: str | None = None
    __post_init__ = _list_fields

    def from_stats(self, s: FrequencyStats) -> float:
        return s.groups / s.rows


@dataclass(frozen=True)
class Uniqueness(ColumnList):
    """Values that occur once, over rows."""

    _columns: Any
    where: str | None = None
    __post_init__ = _list_fields

    def from_stats(self, s: FrequencyStats) -> float:
        return s.singles / s.rows


@dataclass(frozen=True)
class UniqueValueRatio(ColumnList):
    """Values that occur once, over distinct values."""

    _columns: Any
    where: str | None = None
    __post_init__ = _list_fields

    def from_stats(self, s: FrequencyStats) -> float:
        return s.singles / s.groups


@dataclass(frozen=True)
class Entropy(GroupingAnalyzer):
    """Entropy of the values in nats; nulls left out."""

    column: str
    where: str | None = None

    def from_stats(self, s: FrequencyStats) -> float:
        return math.log(s.rows) - s.c_log_c / s.rows if s.groups > 1 else 0.0


@dataclass(frozen=True)
class MutualInformation(ColumnList):
    """Mutual information of two columns in nats."""

    _columns: Any
    where: str | None = None
    __post_init__ = _list_fields

    @property
    def entity(self) -> str:  # type: ignore[override]
        return "Multicolumn"

    def precondition(self, schema: T.StructType) -> str | None:
        return super().precondition(schema) or (None if len(self.columns) == 2 else "Two columns are needed!")


def _used_by(function: Any) -> list[Any]:
    """Values that a Python function takes from around it."""
    closed = [c.cell_contents for c in getattr(function, "__closure__", None) or ()]
    code = getattr(function, "__code__", None)
    return closed + ([function.__globals__[n] for n in code.co_names if n in function.__globals__] if code else [])


@dataclass(frozen=True)
class Histogram(HistogramRows):
    """Counts and shares of each value as text; null is a value of its own.

    ``binningLabel`` names the binning in the histogram's identity. A binning by a Python function needs one, as Spark does not tell such
    functions apart; others are told apart by the expression that they make.
    """

    column: str
    binningUdf: Callable[[Column], Column] | None = None
    maxDetailBins: int | None = None
    where: str | None = None
    binningLabel: str | None = None

    def precondition(self, schema: T.StructType) -> str | None:
        problem = super().precondition(schema)
        if problem is None and self.binningUdf is not None and self.binningLabel is None and self.unnamed():
            return f"The binning of {self.column} by a Python function needs a binningLabel!"
        return problem

    def unnamed(self) -> bool:
        """Whether the binning's expression has something that no other session can read back."""
        return hasattr(self.binningUdf, "func") or any(hasattr(v, "evalType") for v in _used_by(self.binningUdf)) or (
            str(self.binningUdf(col(self.column))) != str(self.binningUdf(col(self.column))))

    def type_problem(self, column: str, kind: T.DataType) -> str | None:
        return f"Cannot bin {kind.simpleString()}" if is_nested(kind) else None

    @property
    def key(self) -> str:
        binned = "" if self.binningUdf is None else f", binning={self.binning!r}"
        return f"Histogram(column={self.column!r}, maxDetailBins={self.maxDetailBins}, where={self.where!r}{binned})"

    @property
    def binning(self) -> str:
        """What tells one binning from another: its label, or the expression that it makes."""
        return str(self.binningUdf(col(self.column))) if self.binningLabel is None else f"label {self.binningLabel}"

    @property
    def details(self) -> int:
        return MAX_DETAIL_BINS if self.maxDetailBins is None else self.maxDetailBins

    def bins(self) -> Column:
        value = col(self.column)
        if self.binningUdf is not None:
            value = self.binningUdf(value)
        return F.coalesce(value.cast("string"), F.lit(NULL_LABEL))
