"""Checks: a level, a description, and constraints on metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import ConstrainableDataTypes
from ..functions.patterns import CREDITCARD, EMAIL, SSN, URL, is_one
from .analyzers import (
    Analyzer,
    ApproxCountDistinct,
    ApproxQuantile,
    Completeness,
    Compliance,
    Correlation,
    DataType,
    Distinctness,
    Entropy,
    Histogram,
    KLLParameters,
    KLLSketch,
    Maximum,
    MaxLength,
    Mean,
    Minimum,
    MinLength,
    MutualInformation,
    PatternMatch,
    Size,
    StandardDeviation,
    Sum,
    Uniqueness,
    UniqueValueRatio,
    as_list,
    col,
)
from .metrics import Distribution, Outcome


class CheckLevel(Enum):
    Error = "Error"
    Warning = "Warning"


class CheckStatus(Enum):
    Success = "Success"
    Warning = "Warning"
    Error = "Error"


@dataclass(frozen=True)
class ConstraintResult:
    constraint: str
    status: str
    message: str


@dataclass(frozen=True, eq=False)
class Constraint:
    """An assertion on one analyzer's value; ``row`` judges single rows where that makes sense."""

    label: str
    analyzer: Analyzer
    assertion: Callable[[Any], bool]
    hint: str | None = None
    pick: Callable[[Any], Any] = field(default=lambda v: v)
    row: Callable[[T.StructType], Column] | None = None

    @property
    def name(self) -> str:
        return f"{self.label}({self.analyzer.key})"

    def filtered(self, where: str) -> Constraint:
        if not self.analyzer.filterable:
            raise TypeError(f"{self.label} cannot be filtered")
        return replace(self, analyzer=self.analyzer.with_where(where))

    def evaluate(self, outcome: Outcome | None) -> ConstraintResult:
        if outcome is None or not outcome.ok:
            return ConstraintResult(self.name, "Failure", outcome.error if outcome else "Missing analysis, can't run the constraint!")
        try:
            value = self.pick(outcome.value)
            if self.assertion(value):
                return ConstraintResult(self.name, "Success", "")
        except Exception as e:
            return ConstraintResult(self.name, "Failure", f"Can't execute the assertion: {e}!")
        shown = value if isinstance(value, (int, float)) else type(value).__name__
        return ConstraintResult(self.name, "Failure", f"Value: {shown} does not meet the constraint requirement!"
                                + (f" {self.hint}" if self.hint else ""))

    def row_column(self, schema: T.StructType, repeated: Callable[[tuple[str, ...], str | None], Column]) -> Column | None:
        """Whether each row meets the constraint; rows outside its filter do.

        repeated: for columns and a filter, whether another row that passes the filter has the same values.
        """
        if self.row is None or self.analyzer.precondition(schema) is not None:
            return None
        where = getattr(self.analyzer, "where", None)
        found = ~repeated(self.row.columns, where) if isinstance(self.row, Alone) else self.row(schema)
        good = F.coalesce(found, F.lit(False))
        return good if where is None else F.when(F.expr(where), good).otherwise(True)


@dataclass(frozen=True)
class Alone:
    """Judges a row by whether no other row has its values in the columns; a row without any value is alone."""

    columns: tuple[str, ...]


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def per_value(assertion: Callable[[Any], bool], value: Column) -> Column:
    """An assertion judged on each value; null values and NaN pass.

    An assertion that makes a condition of a column runs in Spark; any other is called on values, in batches.
    """
    number = value.cast("double")
    try:
        made = assertion(number)
    except Exception:  # it needs a value, as chained comparisons do
        made = None
    if isinstance(made, Column):
        return F.when(number.isNull() | F.isnan(number), True).otherwise(made.cast("boolean"))

    @F.pandas_udf("boolean")
    def judged(x: pd.Series) -> pd.Series:
        return x.map(lambda v: True if v is None or v != v else bool(assertion(v)))

    return F.when(value.isNull(), True).otherwise(judged(number))


class Check:
    """Constraints that hold together. Methods add to the check and return it."""

    def __init__(self, spark_session: SparkSession, level: CheckLevel, description: str,
                 constraints: Iterable[Constraint] | None = None):
        self.spark, self.level, self.description = spark_session, level, description
        self.constraints: list[Constraint] = list(constraints or [])

    # -- building ---------------------------------------------------------

    def addConstraint(self, constraint: Any) -> Check:
        """Add a constraint, or those of another check; what this check has already is not added again."""
        for c in constraint.constraints if isinstance(constraint, Check) else [constraint]:
            if not any(c is own for own in self.constraints):
                self.constraints.append(c)
        return self

    def addConstraints(self, constraints: Iterable[Any]) -> Check:
        for c in list(constraints):
            self.addConstraint(c)
        return self

    def addFilterableConstraint(self, creation: Callable[[str | None], Constraint]) -> Check:
        return self.addConstraint(creation(None))

    addFilterableContstraint = addFilterableConstraint

    def where(self, filter: str) -> Check:
        """Restrict the constraint added last to rows that pass the filter."""
        if not self.constraints:
            raise TypeError("There is no constraint to filter")
        self.constraints[-1] = self.constraints[-1].filtered(filter)
        return self

    def _add(self, label: str, analyzer: Analyzer, assertion: Callable | None, hint: str | None,
             pick: Callable = lambda v: v, row: Callable | None = None) -> Check:
        self.constraints.append(Constraint(f"{label}Constraint", analyzer, assertion or is_one, hint, pick, row))
        return self

    def _comply(self, name: str, predicate: str, assertion: Callable | None, hint: str | None,
                columns: Iterable[str] = ()) -> Check:
        return self._add("Compliance", Compliance(name, predicate, required=tuple(columns)), assertion, hint,
                         row=lambda _: F.expr(predicate))

    # -- size and completeness --------------------------------------------

    def hasSize(self, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Size", Size(), assertion, hint)

    def isComplete(self, column: str, hint: str | None = None) -> Check:
        return self.hasCompleteness(column, is_one, hint)

    def hasCompleteness(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Completeness", Completeness(column), assertion, hint, row=lambda _: col(column).isNotNull())

    def areComplete(self, columns: list[str], hint: str | None = None) -> Check:
        return self.haveCompleteness(columns, is_one, hint)

    def haveCompleteness(self, columns: list[str], assertion: Callable, hint: str | None = None) -> Check:
        return self._comply("Combined Completeness", " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns), assertion, hint, columns)

    def areAnyComplete(self, columns: list[str], hint: str | None = None) -> Check:
        return self.haveAnyCompleteness(columns, is_one, hint)

    def haveAnyCompleteness(self, columns: list[str], assertion: Callable, hint: str | None = None) -> Check:
        return self._comply("Any Completeness", " OR ".join(f"{quoted(c)} IS NOT NULL" for c in columns), assertion, hint, columns)

    # -- uniqueness -------------------------------------------------------

    def isUnique(self, column: str, hint: str | None = None) -> Check:
        return self.hasUniqueness([column], is_one, hint)

    def isPrimaryKey(self, column: str, *columns: str, hint: str | None = None) -> Check:
        return self.hasUniqueness([column, *columns], is_one, hint)

    def hasUniqueness(self, columns: Any, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Uniqueness", Uniqueness(columns), assertion, hint, row=Alone(tuple(dict.fromkeys(as_list(columns)))))

    def hasDistinctness(self, columns: Any, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Distinctness", Distinctness(columns), assertion, hint)

    def hasUniqueValueRatio(self, columns: Any, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("UniqueValueRatio", UniqueValueRatio(columns), assertion, hint, row=Alone(tuple(dict.fromkeys(as_list(columns)))))

    # -- distributions ----------------------------------------------------

    def hasNumberOfDistinctValues(self, column: str, assertion: Callable, binningUdf: Any = None, maxBins: int | None = None,
                                  hint: str | None = None, binningLabel: str | None = None) -> Check:
        return self._add("HistogramBin", Histogram(column, binningUdf, maxBins, binningLabel=binningLabel), assertion, hint, pick=lambda v: v.numberOfBins)

    def hasHistogramValues(self, column: str, assertion: Callable, binningUdf: Any = None, maxBins: int | None = None,
                           hint: str | None = None, binningLabel: str | None = None) -> Check:
        return self._add("Histogram", Histogram(column, binningUdf, maxBins, binningLabel=binningLabel), assertion, hint)

    def kllSketchSatisfies(self, column: str, assertion: Callable, kllParameters: KLLParameters | None = None,
                           hint: str | None = None) -> Check:
        return self._add("KLL", KLLSketch(column, kllParameters), assertion, hint)

    def hasEntropy(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Entropy", Entropy(column), assertion, hint)

    def hasMutualInformation(self, columnA: str, columnB: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("MutualInformation", MutualInformation([columnA, columnB]), assertion, hint)

    def hasApproxQuantile(self, column: str, quantile: Any, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("ApproxQuantile", ApproxQuantile(column, float(quantile)), assertion, hint)

    def hasApproxCountDistinct(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("ApproxCountDistinct", ApproxCountDistinct(column), assertion, hint)

    def hasCorrelation(self, columnA: str, columnB: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Correlation", Correlation(columnA, columnB), assertion, hint)

    # -- numbers and lengths ----------------------------------------------

    def hasMinLength(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("MinLength", MinLength(column), assertion, hint, row=lambda _: per_value(assertion, F.length(col(column))))

    def hasMaxLength(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("MaxLength", MaxLength(column), assertion, hint, row=lambda _: per_value(assertion, F.length(col(column))))

    def hasMin(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Minimum", Minimum(column), assertion, hint, row=lambda _: per_value(assertion, col(column)))

    def hasMax(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Maximum", Maximum(column), assertion, hint, row=lambda _: per_value(assertion, col(column)))

    def hasMean(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Mean", Mean(column), assertion, hint)

    def hasSum(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("Sum", Sum(column), assertion, hint)

    def hasStandardDeviation(self, column: str, assertion: Callable, hint: str | None = None) -> Check:
        return self._add("StandardDeviation", StandardDeviation(column), assertion, hint)

    # -- predicates -------------------------------------------------------

    def satisfies(self, columnCondition: str, constraintName: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._comply(constraintName, columnCondition, assertion, hint)

    def hasPattern(self, column: str, pattern: str, assertion: Callable | None = None, name: str | None = None,
                   hint: str | None = None) -> Check:
        return self._add(name or "PatternMatch", PatternMatch(column, pattern), assertion, hint,
                         row=lambda _: col(column).cast("string").rlike(pattern))

    def containsCreditCardNumber(self, column: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self.hasPattern(column, CREDITCARD, assertion, f"containsCreditCardNumber({column})", hint)

    def containsEmail(self, column: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self.hasPattern(column, EMAIL, assertion, f"containsEmail({column})", hint)

    def containsURL(self, column: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self.hasPattern(column, URL, assertion, f"containsURL({column})", hint)

    def containsSocialSecurityNumber(self, column: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self.hasPattern(column, SSN, assertion, f"containsSocialSecurityNumber({column})", hint)

    def hasDataType(self, column: str, datatype: ConstrainableDataTypes, assertion: Callable | None = None,
                    hint: str | None = None) -> Check:
        def ratio(d: Distribution) -> float:
            counts = {k: v.absolute for k, v in d.values.items()}
            if datatype is ConstrainableDataTypes.Null:
                return counts["Unknown"] / sum(counts.values())
            known = sum(n for k, n in counts.items() if k != "Unknown")
            names = ("Integral", "Fractional") if datatype is ConstrainableDataTypes.Numeric else (datatype.value,)
            return sum(counts[k] for k in names) / known if known else 0.0

        return self._add("DataType", DataType(column), assertion, hint, pick=ratio)

    def isNonNegative(self, column: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._comply(f"{column} is non-negative", f"COALESCE(CAST({quoted(column)} AS DOUBLE), 0.0) >= 0", assertion, hint, [column])

    def isPositive(self, column: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._comply(f"{column} is positive", f"COALESCE(CAST({quoted(column)} AS DOUBLE), 1.0) > 0", assertion, hint, [column])

    def _compare(self, a: str, sign: str, said: str, b: str, assertion: Callable | None, hint: str | None) -> Check:
        return self._comply(f"{a} is {said} {b}", f"{quoted(a)} {sign} {quoted(b)}", assertion, hint, [a, b])

    def isLessThan(self, columnA: str, columnB: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._compare(columnA, "<", "less than", columnB, assertion, hint)

    def isLessThanOrEqualTo(self, columnA: str, columnB: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._compare(columnA, "<=", "less than or equal to", columnB, assertion, hint)

    def isGreaterThan(self, columnA: str, columnB: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._compare(columnA, ">", "greater than", columnB, assertion, hint)

    def isGreaterThanOrEqualTo(self, columnA: str, columnB: str, assertion: Callable | None = None, hint: str | None = None) -> Check:
        return self._compare(columnA, ">=", "greater than or equal to", columnB, assertion, hint)

    def isContainedIn(self, column: str, allowed_values: list[str], assertion: Callable | None = None, hint: str | None = None) -> Check:
        if not all(isinstance(v, str) for v in allowed_values):
            raise TypeError("Allowed values must be strings")
        values = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in allowed_values)
        inside = f"CAST({quoted(column)} AS STRING) IN ({values})" if allowed_values else "FALSE"
        return self._comply(f"{column} contained in {','.join(allowed_values)}", f"{quoted(column)} IS NULL OR {inside}",
                            assertion, hint, [column])

    # -- evaluation -------------------------------------------------------

    def requiredAnalyzers(self) -> list[Analyzer]:
        return list(dict.fromkeys(c.analyzer for c in self.constraints))

    def evaluate(self, context: Any) -> CheckResult:
        return CheckResult(self, [c.evaluate(context.outcomes.get(c.analyzer)) for c in self.constraints])


@dataclass(frozen=True)
class CheckResult:
    check: Check
    results: list[ConstraintResult]

    @property
    def status(self) -> CheckStatus:
        good = all(r.status == "Success" for r in self.results)
        return CheckStatus.Success if good else CheckStatus(self.check.level.value)
