"""Running analyzers on data."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.analyzers import Analyzer
from ..operators.metrics import Metric, Outcome
from ..sources.pandas_io import ensure_spark, need_session
from ..sources.repository import MetricsRepository, ResultKey
from .planner import compute
from .states import States, StateStore

METRIC_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity", "instance", "name")]
                             + [T.StructField("value", T.DoubleType())])


class AnalyzerContext:
    """Outcomes by analyzer."""

    def __init__(self, outcomes: dict[Analyzer, Outcome] | None = None):
        self.outcomes = outcomes or {}

    def metrics(self, forAnalyzers: Iterable[Analyzer] | None = None) -> list[Metric]:
        wanted = None if not forAnalyzers else set(forAnalyzers)
        return [m for a, o in self.outcomes.items() if o.ok and (wanted is None or a in wanted) for m in a.rows(o.value)]

    @classmethod
    def successMetricsAsDataFrame(cls, spark: SparkSession, analyzerContext: AnalyzerContext,
                                  forAnalyzers: Iterable[Analyzer] | None = None, pandas: bool = False) -> Any:
        rows = [(m.entity, m.instance, m.name, m.value) for m in analyzerContext.metrics(forAnalyzers)]
        df = spark.createDataFrame(rows, METRIC_SCHEMA)
        return df.toPandas() if pandas else df

    @classmethod
    def successMetricsAsJson(cls, spark: SparkSession, analyzerContext: AnalyzerContext,
                             forAnalyzers: Iterable[Analyzer] | None = None) -> list[dict[str, Any]]:
        return [m.asDict() for m in analyzerContext.metrics(forAnalyzers)]


class AnalysisRunBuilder:
    """Collects analyzers for one table and runs them together."""

    def __init__(self, spark_session: SparkSession, df: Any):
        self.spark = need_session(spark_session)
        self.df: DataFrame = ensure_spark(self.spark, df)
        self.analyzers: list[Analyzer] = []
        self.repository: MetricsRepository | None = None
        self.key: ResultKey | None = None
        self.reuse: ResultKey | None = None
        self.states: tuple[StateStore, str, list[str]] | None = None

    def addAnalyzer(self, analyzer: Analyzer) -> AnalysisRunBuilder:
        self.analyzers.append(analyzer)
        return self

    def addAnalyzers(self, analyzers: Iterable[Analyzer]) -> AnalysisRunBuilder:
        self.analyzers += analyzers
        return self

    def useRepository(self, repository: MetricsRepository) -> AnalysisRunBuilder:
        self.repository = repository
        return self

    def saveOrAppendResult(self, resultKey: ResultKey) -> AnalysisRunBuilder:
        if self.repository is None:
            raise ValueError("useRepository must come before saveOrAppendResult")
        self.key = resultKey
        return self

    def reuseExistingResultsForKey(self, resultKey: ResultKey) -> AnalysisRunBuilder:
        """Take values that the repository has under this key, distributions and sketches too, instead of computing them again."""
        if self.repository is None:
            raise ValueError("useRepository must come before reuseExistingResultsForKey")
        self.reuse = resultKey
        return self

    def withStates(self, store: StateStore, part: str, onto: Iterable[str] | None = None) -> AnalysisRunBuilder:
        """Read only this table, a part of the data, keep its states under the part's name, and give metrics of it and other parts together.

        ``onto``: names of the parts whose states are added, all saved ones if left out. Their data is not read.
        """
        self.states = store, part, [p for p in (store.parts() if onto is None else onto) if p != part]
        return self

    def known(self) -> dict[Analyzer, Outcome]:
        if self.reuse is None:
            return {}
        values = self.repository.values(self.reuse)
        return {a: Outcome(values[a.key]) for a in self.analyzers if a.key in values}

    def run(self) -> AnalyzerContext:
        known = self.known()
        wanted = [a for a in self.analyzers if a not in known]
        fresh = compute(self.df, wanted) if self.states is None else self.from_states(wanted)
        context = AnalyzerContext({a: known.get(a) or fresh[a] for a in dict.fromkeys(self.analyzers)})
        if self.repository is not None and self.key is not None:
            self.repository.save(self.key, context)
        return context

    def from_states(self, wanted: list[Analyzer]) -> dict[Analyzer, Outcome]:
        store, part, onto = self.states
        own = States.of(self.df, wanted)
        store.save(part, own)
        merged = store.merged([*onto, part], wanted)
        merged.problems |= own.problems
        return merged.outcomes(wanted)


class AnalysisRunner:
    def __init__(self, spark_session: SparkSession):
        self.spark = need_session(spark_session)

    def onData(self, df: Any) -> AnalysisRunBuilder:
        return AnalysisRunBuilder(self.spark, df)

    @staticmethod
    def onStates(states: States, analyzers: Iterable[Analyzer]) -> AnalyzerContext:
        """Metrics from states alone."""
        return AnalyzerContext(states.outcomes(analyzers))
