"""Data-quality measurement and enforcement on Spark DataFrames."""

from .functions.kinds import ConstrainableDataTypes, DataTypeInstances
from .operators.analyzers import *  # noqa: F403
from .operators.anomaly import (
    AbsoluteChangeStrategy,
    BatchNormalStrategy,
    HoltWinters,
    MetricInterval,
    OnlineNormalStrategy,
    RateOfChangeStrategy,
    RelativeRateOfChangeStrategy,
    SeriesSeasonality,
    SimpleThresholdStrategy,
)
from .operators.check import Check, CheckLevel, CheckStatus
from .operators.profiles import ColumnProfilerRunner
from .operators.suggestions import (
    DEFAULT,
    CategoricalRangeRule,
    CompleteIfCompleteRule,
    ConstraintSuggestionRunner,
    FractionalCategoricalRangeRule,
    NonNegativeNumbersRule,
    RetainCompletenessRule,
    RetainTypeRule,
    UniqueIfApproximatelyUniqueRule,
)
from .operators.verification import AnomalyCheckConfig, VerificationResult, VerificationSuite
from .plans.runner import AnalysisRunner, AnalyzerContext
from .session import QualitySession
from .sources.repository import FileSystemMetricsRepository, InMemoryMetricsRepository, ResultKey
