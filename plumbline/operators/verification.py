"""Verification: checks on data, their results, and results by row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.planner import compute, frequencies
from ..plans.runner import AnalyzerContext
from ..sources.pandas_io import ensure_spark, need_session
from ..sources.repository import MetricsRepository, ResultKey
from .analyzers import Analyzer, ApproxQuantiles, DataType, Histogram, KLLSketch, col
from .anomaly import AnomalyDetectionStrategy
from .check import Check, CheckLevel, CheckResult, CheckStatus, Constraint, ConstraintResult
from .metrics import Outcome

RESULT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    "check", "check_level", "check_status", "constraint", "constraint_status", "constraint_message")])


@dataclass(frozen=True)
class AnomalyCheckConfig:
    """How an anomaly check reports, and which part of the history it sees."""

    level: CheckLevel = CheckLevel.Warning
    description: str = "Anomaly check"
    withTagValues: dict[str, str] | None = None
    afterDate: int | None = None
    beforeDate: int | None = None


class VerificationResult:
    """Results of checks, with the metrics that they were judged on."""

    def __init__(self, results: list[CheckResult], context: AnalyzerContext):
        self.results, self.context = results, context

    @property
    def status(self) -> str:
        order = [CheckStatus.Success, CheckStatus.Warning, CheckStatus.Error]
        return max((r.status for r in self.results), key=order.index, default=CheckStatus.Success).value

    @property
    def checkResults(self) -> list[dict[str, str]]:
        return self._rows()

    @property
    def metrics(self) -> dict[Analyzer, Outcome]:
        return self.context.outcomes

    def _rows(self, forChecks: Iterable[Check] | None = None) -> list[dict[str, str]]:
        wanted = [id(c) for c in forChecks] if forChecks else None
        return [dict(zip(RESULT_SCHEMA.names, (r.check.description, r.check.level.value, r.status.value, c.constraint,
                                               c.status, c.message), strict=True))
                for r in self.results if wanted is None or id(r.check) in wanted for c in r.results]

    @classmethod
    def checkResultsAsJson(cls, spark: SparkSession, result: VerificationResult, forChecks: Iterable[Check] | None = None) -> list[dict[str, str]]:
        return result._rows(forChecks)

    @classmethod
    def checkResultsAsDataFrame(cls, spark: SparkSession, result: VerificationResult, forChecks: Iterable[Check] | None = None,
                                pandas: bool = False) -> Any:
        df = spark.createDataFrame([tuple(r.values()) for r in result._rows(forChecks)], RESULT_SCHEMA)
        return df.toPandas() if pandas else df

    @classmethod
    def successMetricsAsJson(cls, spark: SparkSession, result: VerificationResult, forAnalyzers: Iterable[Analyzer] | None = None) -> list[dict]:
        return AnalyzerContext.successMetricsAsJson(spark, result.context, forAnalyzers)

    @classmethod
    def successMetricsAsDataFrame(cls, spark: SparkSession, result: VerificationResult, forAnalyzers: Iterable[Analyzer] | None = None,
                                  pandas: bool = False) -> Any:
        return AnalyzerContext.successMetricsAsDataFrame(spark, result.context, forAnalyzers, pandas)

    @classmethod
    def rowLevelResultsAsDataFrame(cls, spark: SparkSession, result: VerificationResult, data: Any, pandas: bool = False) -> Any:
        """data with a Boolean column for each check that judges rows: whether the row meets all its constraints."""
        df = row_level(ensure_spark(spark, data), [r.check for r in result.results])
        return df.toPandas() if pandas else df


def row_level(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """df with the checks' columns. Values that repeat are counted with a map-side step, without nulls, and joined back."""
    added, flags = {}, {}

    def repeated(columns: tuple[str, ...], where: str | None) -> Column:
        return F.coalesce(F.col(flags.setdefault((columns, where), f" repeated {len(flags)}")), F.lit(False))

    for check in checks:
        columns = [c for c in (x.row_column(df.schema, repeated) for x in check.constraints) if c is not None]
        if columns:
            if check.description in df.columns:
                raise ValueError(f"The data has a column {check.description} already; the check of that name needs another")
            own = [added[check.description]] if check.description in added else []  # checks of one name are one column
            added[check.description] = reduce(lambda a, b: a & b, own + columns)
    rows = df
    for (columns, where), flag in flags.items():
        names = [f"{flag} {i}" for i in range(len(columns))]
        counts = frequencies(df, columns, where).where("n > 1").select(*[F.col(f"g{i}").alias(n) for i, n in enumerate(names)], F.lit(True).alias(flag))
        rows = rows.join(counts, reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names, strict=True)]), "left")
    return rows.select(*[col(c) for c in df.columns], *[c.alias(name) for name, c in added.items()]) if added else df


class VerificationRunBuilder:
    def __init__(self, spark_session: SparkSession, data: Any):
        self.spark = need_session(spark_session)
        self.df = ensure_spark(self.spark, data)
        self.checks: list[Check] = []
        self.analyzers: list[Analyzer] = []
        self.anomalies: list[tuple[AnomalyDetectionStrategy, Analyzer, AnomalyCheckConfig]] = []
        self.repository: MetricsRepository | None = None
        self.key: ResultKey | None = None

    def addCheck(self, check: Check) -> VerificationRunBuilder:
        self.checks.append(check)
        return self

    def addChecks(self, checks: Iterable[Check]) -> VerificationRunBuilder:
        self.checks += checks
        return self

    def addRequiredAnalyzer(self, analyzer: Analyzer) -> VerificationRunBuilder:
        self.analyzers.append(analyzer)
        return self

    def addAnomalyCheck(self, strategy: AnomalyDetectionStrategy, analyzer: Analyzer,
                        anomalyCheckConfig: AnomalyCheckConfig | None = None) -> VerificationRunBuilder:
        if isinstance(analyzer, (ApproxQuantiles, DataType, Histogram, KLLSketch)):
            raise TypeError(f"{analyzer.name} has several values; an anomaly check judges one")
        self.anomalies.append((strategy, analyzer, anomalyCheckConfig or AnomalyCheckConfig(
            description=f"Anomaly check for {analyzer.name}")))
        return self

    def useRepository(self, repository: MetricsRepository) -> VerificationRunBuilder:
        self.repository = repository
        return self

    def saveOrAppendResult(self, resultKey: ResultKey) -> VerificationRunBuilder:
        self.key = resultKey
        return self

    def run(self) -> VerificationResult:
        if (self.key is not None or self.anomalies) and self.repository is None:
            raise ValueError("useRepository is needed to save results or to check for anomalies")
        needed = [a for c in self.checks for a in c.requiredAnalyzers()] + self.analyzers + [a for _, a, _ in self.anomalies]
        context = AnalyzerContext(compute(self.df, needed))
        results = [c.evaluate(context) for c in self.checks]
        results += [self._anomaly(context, *x) for x in self.anomalies]
        if self.key is not None and self.repository is not None:
            self.repository.save(self.key, context)
        return VerificationResult(results, context)

    def _anomaly(self, context: AnalyzerContext, strategy: AnomalyDetectionStrategy, analyzer: Analyzer,
                 config: AnomalyCheckConfig) -> CheckResult:
        """Judge the newest value against the history, which the value is not yet part of."""
        query = self.repository.load().forAnalyzers([analyzer])
        if config.withTagValues:
            query = query.withTagValues(config.withTagValues)
        if config.afterDate is not None:
            query = query.after(config.afterDate)
        if config.beforeDate is not None:
            query = query.before(config.beforeDate)
        stored = [m for m in query.metrics() if self.key is None or m.dataset_date <= self.key.dataSetDate]
        if self.key is not None:
            stored = [m for m in stored if (m.dataset_date, dict(m.tags)) != (self.key.dataSetDate, self.key.tags)]
        history = [m.value for m in stored]
        check = Check(self.spark, config.level, config.description)
        constraint = Constraint("AnomalyConstraint", analyzer, lambda v: strategy.is_normal(history, float(v)))
        if (problem := strategy.problem(history)) is not None:
            return CheckResult(check, [ConstraintResult(constraint.name, "Failure", problem)])
        return CheckResult(check, [constraint.evaluate(context.outcomes[analyzer])])


class VerificationSuite:
    def __init__(self, spark_session: SparkSession):
        self.spark = need_session(spark_session)

    def onData(self, df: Any) -> VerificationRunBuilder:
        return VerificationRunBuilder(self.spark, df)
