"""Constraint suggestions: rules over column profiles."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.kinds import ConstrainableDataTypes
from ..plans.planner import compute
from ..sources.pandas_io import ensure_spark, need_session
from .analyzers import NULL_LABEL, CountDistinct
from .check import Check, CheckLevel
from .profiles import ColumnProfiles, NumericColumnProfile, StandardColumnProfile, profile
from .verification import VerificationSuite


@dataclass(frozen=True)
class Suggestion:
    constraint_name: str
    column_name: str
    current_value: str
    description: str
    suggesting_rule: str
    rule_description: str
    code_for_constraint: str
    #: Adds the constraint that the code shows.
    add: Callable[[Check], Check] = field(repr=False, compare=False)

    def asDict(self) -> dict[str, str]:
        return {k: v for k, v in self.__dict__.items() if k != "add"}


class ConstraintRule:
    """A rule looks at one column's profile and may suggest a constraint."""

    description = ""

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        raise NotImplementedError

    def needs_distinct(self, p: StandardColumnProfile, n: int) -> bool:
        """Whether the suggestion depends on the exact number of distinct values."""
        return False

    def said(self, name: str, p: StandardColumnProfile, value: str, text: str, code: str, add: Callable[[Check], Check]) -> Suggestion:
        return Suggestion(name, p.column, value, text, type(self).__name__, self.description, code, add)


def categories(p: StandardColumnProfile) -> list:
    """Values of a text column with their counts, most frequent first; empty if unknown or another type."""
    if p.dataType != "String" or not p.histogram:
        return []
    return sorted((v for v in p.histogram if v.value != NULL_LABEL), key=lambda v: (-v.absolute, v.value))


def is_categorical(p: StandardColumnProfile) -> bool:
    """Few values that repeat: at most one value in ten occurs once."""
    found = categories(p)
    return bool(found) and sum(v.absolute == 1 for v in found) / len(found) <= 0.1


def listed(values: Iterable[str]) -> str:
    return "[" + ", ".join(json.dumps(v, ensure_ascii=False) for v in values) + "]"


class CategoricalRangeRule(ConstraintRule):
    description = "A text column that repeats few values should hold only these"

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        if not is_categorical(p):
            return None
        values = [v.value for v in categories(p)]
        shown = ", ".join(f"'{v}'" for v in values)
        return self.said("ComplianceConstraint", p, "Compliance: 1", f"'{p.column}' has value range {shown}",
                         f".isContainedIn({json.dumps(p.column)}, {listed(values)})",
                         lambda c: c.isContainedIn(p.column, values))


class FractionalCategoricalRangeRule(ConstraintRule):
    description = "Most rows of a text column that repeats few values should hold one of the frequent ones"

    def __init__(self, targetDataCoverageFraction: float = 0.9):
        self.target = targetDataCoverageFraction

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        found = categories(p)
        total = sum(v.absolute for v in found)
        if not is_categorical(p) or not total:
            return None
        top, covered = [], 0
        for v in found:
            if covered >= self.target * total:
                break
            top.append(v)
            covered += v.absolute
        bound = math.floor(100 * lower_bound(covered / total, total)) / 100
        shown = ", ".join(f"'{v.value}'" for v in top)
        return self.said("ComplianceConstraint", p, f"Compliance: {covered / total}",
                         f"'{p.column}' has value range {shown} for at least {bound * 100:g}% of values",
                         f".isContainedIn({json.dumps(p.column)}, {listed(v.value for v in top)}, lambda x: x >= {bound}, "
                         f'"It should be above {bound}!")',
                         lambda c: c.isContainedIn(p.column, [v.value for v in top], lambda x: x >= bound, f"It should be above {bound}!"))


class CompleteIfCompleteRule(ConstraintRule):
    description = "A column without nulls should stay so"

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        if p.completeness != 1:
            return None
        return self.said("CompletenessConstraint", p, "Completeness: 1.0", f"'{p.column}' is not null",
                         f".isComplete({json.dumps(p.column)})", lambda c: c.isComplete(p.column))


def lower_bound(share: float, n: int) -> float:
    """Lower end of the 95 % Wald interval of a share."""
    return share - 1.96 * math.sqrt(share * (1 - share) / n)


class RetainCompletenessRule(ConstraintRule):
    description = "A column with some nulls should not get many more: its share of values should stay above the lower end of a 95 % interval"

    def __init__(self, minCompleteness: float = 0.2, maxCompleteness: float = 1.0):
        self.low, self.high = minCompleteness, maxCompleteness

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        if not self.low < p.completeness < self.high:
            return None
        bound = math.floor(100 * lower_bound(p.completeness, n)) / 100
        return self.said("CompletenessConstraint", p, f"Completeness: {p.completeness}",
                         f"'{p.column}' has less than {round(100 * (1 - bound))}% missing values",
                         f'.hasCompleteness({json.dumps(p.column)}, lambda x: x >= {bound}, "It should be above {bound}!")',
                         lambda c: c.hasCompleteness(p.column, lambda x: x >= bound, f"It should be above {bound}!"))


class RetainTypeRule(ConstraintRule):
    description = "Text that is all of one other type should stay of that type"

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        if not p.isDataTypeInferred or p.dataType not in ("Boolean", "Integral", "Fractional"):
            return None
        return self.said("AnalysisBasedConstraint", p, f"DataType: {p.dataType}", f"'{p.column}' has type {p.dataType}",
                         f".hasDataType({json.dumps(p.column)}, ConstrainableDataTypes.{p.dataType})",
                         lambda c: c.hasDataType(p.column, ConstrainableDataTypes[p.dataType]))


class NonNegativeNumbersRule(ConstraintRule):
    description = "A column whose least number is 0 or more should hold no negative ones"

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        if not isinstance(p, NumericColumnProfile) or p.minimum is None or p.minimum < 0:
            return None
        return self.said("ComplianceConstraint", p, f"Minimum: {p.minimum}", f"'{p.column}' has no negative values",
                         f".isNonNegative({json.dumps(p.column)})", lambda c: c.isNonNegative(p.column))


class UniqueIfApproximatelyUniqueRule(ConstraintRule):
    description = "A column with about as many different values as rows should hold each value once"

    #: The share of distinct values may miss 1 by this; the sketch misses its number by 0.046, one standard deviation.
    TOLERANCE, SKETCH_ERROR = 0.08, 0.25

    def needs_distinct(self, p: StandardColumnProfile, n: int) -> bool:
        """The sketch rules out only columns far from unique; it may miss the rest by more than the tolerance."""
        return n > 0 and p.completeness == 1 and p.approximateNumDistinctValues >= (1 - self.TOLERANCE) * (1 - self.SKETCH_ERROR) * n

    def suggest(self, p: StandardColumnProfile, n: int) -> Suggestion | None:
        distinct = p.approximateNumDistinctValues if p.numDistinctValues is None else p.numDistinctValues
        if not n or p.completeness != 1 or abs(1 - distinct / n) > self.TOLERANCE:
            return None
        return self.said("UniquenessConstraint", p, f"ApproxDistinctness: {distinct / n}",
                         f"'{p.column}' is unique", f".isUnique({json.dumps(p.column)})", lambda c: c.isUnique(p.column))


class DEFAULT:
    """All rules."""

    def rules(self) -> list[ConstraintRule]:
        return [CompleteIfCompleteRule(), RetainCompletenessRule(), RetainTypeRule(), CategoricalRangeRule(),
                FractionalCategoricalRangeRule(), NonNegativeNumbersRule(), UniqueIfApproximatelyUniqueRule()]


def suggest(profiles: ColumnProfiles, rules: Iterable[ConstraintRule]) -> list[Suggestion]:
    """Suggestions by column; the partial range is left out where the whole range is suggested."""
    out = []
    rules = list(rules)
    for p in profiles.profiles.values():
        made = [s for r in rules if (s := r.suggest(p, profiles.numRecords)) is not None]
        whole = any(s.suggesting_rule == "CategoricalRangeRule" for s in made)
        out += [s for s in made if not whole or s.suggesting_rule != "FractionalCategoricalRangeRule"]
    return out


class ConstraintSuggestionRunBuilder:
    def __init__(self, spark_session: SparkSession, data: Any):
        self.spark = need_session(spark_session)
        self.df = ensure_spark(self.spark, data)
        self.rules: list[ConstraintRule] = []
        self.columnProfiles: ColumnProfiles | None = None
        self.testRatio, self.seed = 0.0, 0

    def addConstraintRule(self, constraintRule: Any) -> ConstraintSuggestionRunBuilder:
        self.rules += constraintRule.rules() if isinstance(constraintRule, DEFAULT) else [constraintRule]
        return self

    def useTrainTestSplitWithTestsetRatio(self, testsetRatio: float, seed: int = 0) -> ConstraintSuggestionRunBuilder:
        """Suggest on one part of the rows, and evaluate the suggestions on the rest."""
        self.testRatio, self.seed = testsetRatio, seed
        return self

    def run(self) -> dict[str, Any]:
        train, test = self.df, None
        if self.testRatio:
            train, test = self.df.randomSplit([1 - self.testRatio, self.testRatio], self.seed)
        self.columnProfiles, _ = profile(train)
        self.count_distinct(train, self.columnProfiles)
        made = suggest(self.columnProfiles, self.rules)
        found = [s.asDict() for s in made]
        if test is not None and found:
            for s, status in zip(found, self.evaluated(test, made), strict=True):
                s["constraint_result_on_test_set"] = status
        return {"constraint_suggestions": found}

    def count_distinct(self, df: DataFrame, found: ColumnProfiles) -> None:
        """Adds exact numbers of distinct values to the profiles of columns whose suggestions depend on them, in one job."""
        unsure = {p.column: CountDistinct(p.column) for p in found.profiles.values() if any(r.needs_distinct(p, found.numRecords) for r in self.rules)}
        outcomes = compute(df, unsure.values()) if unsure else {}
        for c, a in unsure.items():
            if outcomes[a].ok:
                found.profiles[c].numDistinctValues = int(outcomes[a].value)

    def evaluated(self, test: Any, made: list[Suggestion]) -> list[str]:
        """Statuses of the suggested constraints on the held-out rows."""
        check = Check(self.spark, CheckLevel.Warning, "suggested")
        for s in made:
            s.add(check)
        result = VerificationSuite(self.spark).onData(test).addCheck(check).run()
        return [r["constraint_status"] for r in result.checkResults]


class ConstraintSuggestionRunner:
    def __init__(self, spark_session: SparkSession):
        self.spark = need_session(spark_session)

    def onData(self, df: Any) -> ConstraintSuggestionRunBuilder:
        return ConstraintSuggestionRunBuilder(self.spark, df)
