"""Column profiles in three passes.

Pass one counts rows, values, classes and approximate distinct values of all columns. Pass
two takes statistics of numeric columns, and of text columns whose values all look like
numbers. Pass three takes exact histograms of columns with few distinct values, all
columns in one job.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import VALUE_CLASSES, DataTypeInstances, is_nested, overall_class, type_class, value_class
from ..plans.planner import compute
from ..plans.runner import AnalyzerContext
from ..sources.pandas_io import ensure_spark, need_session
from ..sources.repository import MetricsRepository, ResultKey
from .analyzers import NULL_LABEL, ApproxCountDistinct, Completeness, KLLParameters, KLLSketch, Maximum, Mean, Minimum, Size, StandardDeviation, Sum, col
from .metrics import BucketDistribution, DistributionValue

LOW_CARDINALITY = 120
log = logging.getLogger(__name__)


@dataclass
class StandardColumnProfile:
    column: str
    completeness: float
    approximateNumDistinctValues: int
    dataType: str
    isDataTypeInferred: bool
    typeCounts: dict[str, int]
    histogram: list[DistributionValue] | None = None
    #: Counted exactly only where a suggestion depends on it.
    numDistinctValues: int | None = None

    TITLE = "StandardProfiles"

    def facts(self) -> dict[str, Any]:
        shown = None if self.histogram is None else [[v.value, v.absolute, v.ratio] for v in self.histogram]
        return {"completeness": self.completeness, "approximateNumDistinctValues": self.approximateNumDistinctValues,
                "dataType": self.dataType, "isDataTypeInferred": self.isDataTypeInferred, "typeCounts": self.typeCounts,
                "histogram": shown}

    def __str__(self) -> str:
        return f"{self.TITLE} for column: {self.column}: {json.dumps(self.facts(), indent=4, default=str)}"


@dataclass
class StringColumnProfile(StandardColumnProfile):
    minLength: int | None = None
    maxLength: int | None = None

    TITLE = "StringProfiles"

    def facts(self) -> dict[str, Any]:
        return super().facts() | {"minLength": self.minLength, "maxLength": self.maxLength}


@dataclass
class NumericColumnProfile(StandardColumnProfile):
    kll: BucketDistribution | None = None
    mean: float | None = None
    maximum: float | None = None
    minimum: float | None = None
    sum: float | None = None
    stdDev: float | None = None
    approxPercentiles: list[float] = field(default_factory=list)

    TITLE = "NumericProfiles"

    def facts(self) -> dict[str, Any]:
        return super().facts() | {"kll": str(self.kll), "mean": self.mean, "maximum": self.maximum, "minimum": self.minimum,
                                  "sum": self.sum, "stdDev": self.stdDev, "approxPercentiles": self.approxPercentiles}


@dataclass
class ColumnProfiles:
    profiles: dict[str, StandardColumnProfile]
    numRecords: int

    def __str__(self) -> str:
        return f"NumRecords: {self.numRecords}\n" + "\n".join(map(str, self.profiles.values()))


def profile(df: DataFrame, low_cardinality: int = LOW_CARDINALITY, kll: bool = False, parameters: KLLParameters | None = None,
            predefined: dict[str, str] | None = None) -> tuple[ColumnProfiles, AnalyzerContext]:
    """Profiles of all columns, and the metrics among them."""
    names = [f.name for f in df.schema]
    # -- pass one
    columns: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        c = col(f.name)
        countable = not isinstance(f.dataType, T.MapType)
        columns += [F.count(c).alias(f"c{i}"), (F.approx_count_distinct(c) if countable else F.lit(0)).alias(f"d{i}")]
        kind = value_class(c, f.dataType)
        columns += [F.count(F.when(kind == v, 1)).alias(f"t{i}_{v}") for v in VALUE_CLASSES]
        if isinstance(f.dataType, T.StringType):
            length = F.coalesce(F.length(c), F.lit(0))
            columns += [F.min(length).alias(f"a{i}"), F.max(length).alias(f"b{i}")]
    first = df.agg(*columns).first()
    n = first["n"]
    counts = {name: {v: first[f"t{i}_{v}"] for v in VALUE_CLASSES} for i, name in enumerate(names)}
    kinds, inferred = {}, {}
    for i, f in enumerate(df.schema):
        declared = type_class(f.dataType)
        found = overall_class(counts[f.name]) if declared == "String" and first[f"c{i}"] else declared
        kinds[f.name] = (predefined or {}).get(f.name, found)
        inferred[f.name] = f.name not in (predefined or {}) and declared == "String" and found != "String"
    # -- pass two
    numeric = [c for c in names if kinds[c] in ("Integral", "Fractional") and not is_nested(df.schema[c].dataType)]
    as_numbers = df.select(*[(F.expr(f"try_cast(`{c.replace('`', '``')}` as double)")).alias(c) for c in numeric]) if numeric else None
    outcomes = {}
    if as_numbers is not None:
        wanted = [kind(c) for c in numeric for kind in (Minimum, Maximum, Mean, Sum, StandardDeviation)]
        if kll:
            wanted += [KLLSketch(c, parameters) for c in numeric]
        outcomes = compute(as_numbers, wanted)
    # -- pass three
    few = [c for i, c in enumerate(names) if n and first[f"d{i}"] <= low_cardinality and not is_nested(df.schema[c].dataType)]
    histograms = exact_histograms(df, few, n)

    number = lambda kind, c: outcomes[kind(c)].value if outcomes[kind(c)].ok else None
    out: dict[str, StandardColumnProfile] = {}
    for i, f in enumerate(df.schema):
        c = f.name
        shared = dict(column=c, completeness=first[f"c{i}"] / n if n else 1.0, approximateNumDistinctValues=first[f"d{i}"],
                      dataType=kinds[c], isDataTypeInferred=inferred[c], typeCounts=counts[c], histogram=histograms.get(c))
        if c in numeric:
            sketch = outcomes[KLLSketch(c, parameters)].value if kll and outcomes[KLLSketch(c, parameters)].ok else None
            out[c] = NumericColumnProfile(
                **shared, kll=sketch, mean=number(Mean, c), maximum=number(Maximum, c), minimum=number(Minimum, c), sum=number(Sum, c),
                stdDev=number(StandardDeviation, c), approxPercentiles=sketch.computePercentiles() if sketch else [])
        elif isinstance(f.dataType, T.StringType):
            out[c] = StringColumnProfile(**shared, minLength=first[f"a{i}"], maxLength=first[f"b{i}"])
        else:
            out[c] = StandardColumnProfile(**shared)
    from .metrics import Outcome

    saved = {Size(): Outcome(float(n))} | {Completeness(c): Outcome(out[c].completeness) for c in names}
    saved |= {ApproxCountDistinct(c): Outcome(float(out[c].approximateNumDistinctValues)) for c in names}
    return ColumnProfiles(out, n), AnalyzerContext(saved | {a: o for a, o in outcomes.items() if o.ok})


def exact_histograms(df: DataFrame, columns: list[str], n: int) -> dict[str, list[DistributionValue]]:
    """Counts by value of several columns with few values each, in one job with a map-side step."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(col(c).cast("string"), F.lit(NULL_LABEL)).alias("v"))
                      for i, c in enumerate(columns)])
    rows = df.select(F.explode(pairs).alias("x")).groupBy("x.i", "x.v").count().collect()
    out: dict[str, list[DistributionValue]] = {c: [] for c in columns}
    for i, v, k in sorted(rows, key=lambda r: (-r[2], r[1])):
        out[columns[i]].append(DistributionValue(v, k, k / n))
    return out


class ColumnProfilerRunBuilder:
    def __init__(self, spark_session: SparkSession, data: Any):
        self.spark = need_session(spark_session)
        self.df = ensure_spark(self.spark, data)
        self._threshold, self._kll, self._parameters = LOW_CARDINALITY, False, None
        self._columns: list[str] | None = None
        self._predefined: dict[str, str] = {}
        self._cache = self._print = False
        self._repository: MetricsRepository | None = None
        self._key: ResultKey | None = None

    def restrictToColumns(self, restrict_to_columns: list[str]) -> ColumnProfilerRunBuilder:
        self._columns = list(restrict_to_columns)
        return self

    def withLowCardinalityHistogramThreshold(self, low_cardinality_histogram_threshold: int) -> ColumnProfilerRunBuilder:
        self._threshold = low_cardinality_histogram_threshold
        return self

    def withKLLProfiling(self) -> ColumnProfilerRunBuilder:
        self._kll = True
        return self

    def setKLLParameters(self, kllParameters: KLLParameters) -> ColumnProfilerRunBuilder:
        self._parameters = kllParameters
        return self

    def setPredefinedTypes(self, data_types: dict[str, DataTypeInstances]) -> ColumnProfilerRunBuilder:
        self._predefined = {c: k.value for c, k in data_types.items()}
        return self

    def cacheInputs(self, cache_inputs: bool) -> ColumnProfilerRunBuilder:
        self._cache = cache_inputs
        return self

    def printStatusUpdates(self, print_status_updates: bool) -> ColumnProfilerRunBuilder:
        self._print = print_status_updates
        return self

    def useRepository(self, repository: MetricsRepository) -> ColumnProfilerRunBuilder:
        self._repository = repository
        return self

    def saveOrAppendResult(self, resultKey: ResultKey) -> ColumnProfilerRunBuilder:
        self._key = resultKey
        return self

    def useSparkSession(self, sparkSession: SparkSession) -> ColumnProfilerRunBuilder:
        self.spark = need_session(sparkSession)
        return self

    def run(self) -> ColumnProfiles:
        df = self.df if self._columns is None else self.df.select(*[col(c) for c in self._columns])
        if self._cache:
            df = df.persist()
        try:
            if self._print:
                log.warning("Profiling %d columns", len(df.columns))
            profiles, context = profile(df, self._threshold, self._kll, self._parameters, self._predefined)
        finally:
            if self._cache:
                df.unpersist()
        if self._repository is not None and self._key is not None:
            self._repository.save(self._key, context)
        return profiles


class ColumnProfilerRunner:
    def __init__(self, spark_session: SparkSession):
        self.spark = need_session(spark_session)

    def onData(self, df: Any) -> ColumnProfilerRunBuilder:
        return ColumnProfilerRunBuilder(self.spark, df)
