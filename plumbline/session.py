"""Façade over the runners for one session and table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .operators.check import Check, CheckLevel
from .operators.profiles import ColumnProfilerRunBuilder, ColumnProfilerRunner
from .operators.suggestions import ConstraintSuggestionRunBuilder, ConstraintSuggestionRunner
from .operators.verification import VerificationRunBuilder, VerificationSuite
from .plans.runner import AnalysisRunBuilder, AnalysisRunner


class QualitySession:
    def __init__(self, spark_session: SparkSession):
        self.spark = spark_session

    def createColumnProfileRunner(self, df: Any) -> ColumnProfilerRunBuilder:
        return ColumnProfilerRunner(self.spark).onData(df)

    def createAnalysisRunner(self, df: Any) -> AnalysisRunBuilder:
        return AnalysisRunner(self.spark).onData(df)

    def createVerificationSuite(self, df: Any) -> VerificationRunBuilder:
        return VerificationSuite(self.spark).onData(df)

    def createSuggestionRunner(self, df: Any) -> ConstraintSuggestionRunBuilder:
        return ConstraintSuggestionRunner(self.spark).onData(df)

    def createCheck(self, level: CheckLevel, description: str, constraints: list | None = None) -> Check:
        return Check(self.spark, level, description, constraints)
