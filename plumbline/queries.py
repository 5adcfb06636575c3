"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import (
    AbsoluteChangeStrategy,
    AnalysisRunner,
    AnalyzerContext,
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    BatchNormalStrategy,
    CategoricalRangeRule,
    Check,
    CheckLevel,
    ColumnProfilerRunner,
    CompleteIfCompleteRule,
    Completeness,
    Compliance,
    ConstrainableDataTypes,
    ConstraintSuggestionRunner,
    Correlation,
    CountDistinct,
    DataType,
    Distinctness,
    Entropy,
    FractionalCategoricalRangeRule,
    Histogram,
    HoltWinters,
    FileSystemMetricsRepository,
    InMemoryMetricsRepository,
    DataTypeInstances,
    KLLParameters,
    KLLSketch,
    Maximum,
    MaxLength,
    Mean,
    MetricInterval,
    Minimum,
    MinLength,
    MutualInformation,
    NonNegativeNumbersRule,
    OnlineNormalStrategy,
    PatternMatch,
    QualitySession,
    RelativeRateOfChangeStrategy,
    ResultKey,
    RetainCompletenessRule,
    RetainTypeRule,
    SeriesSeasonality,
    SimpleThresholdStrategy,
    Size,
    StandardDeviation,
    Sum,
    UniqueIfApproximatelyUniqueRule,
    Uniqueness,
    UniqueValueRatio,
    VerificationResult,
    VerificationSuite,
)
from .operators.series import judge_series
from .plans.states import States, StateStore
from .sources.repository import metrics_table
from .streaming import states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a column that has nulls and text columns that hold numbers and truths."""
    return table(spark, sf_dir, "lineitem").withColumns({
        "gap": F.nullif("l_linenumber", F.lit(1)), "text_number": F.col("l_quantity").cast("int").cast("string"),
        "text_truth": (F.col("l_discount") > 0.05).cast("string"), "day": F.date_format("l_shipdate", "yyyy-MM-dd")})


ITEMS = ("(SELECT *, NULLIF(l_linenumber, 1) AS gap, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS text_number, "
         "CAST(l_discount > 0.05 AS VARCHAR) AS text_truth, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem)")


# -- analyzers ----------------------------------------------------------------

def metrics(name: str, analyzers: list, *rows: tuple[str, str, str, str], where: str = "") -> None:
    """A query for analyzers over items; rows: (entity, instance, name, SQL of the value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = AnalysisRunner(spark).onData(items(spark, sf_dir)).addAnalyzers(analyzers).run()
        return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", DIGITS))

    QUERIES[name] = run
    if rows:
        parts = [f"SELECT '{e}' AS entity, '{i}' AS instance, '{n}' AS name, round(CAST({v} AS DOUBLE), {DIGITS}) AS value FROM {ITEMS} t{where}"
                 for e, i, n, v in rows]
        SQL[name] = " UNION ALL ".join(parts)


def column(c: str, name: str, value: str) -> tuple[str, str, str, str]:
    return "Column", c, name, value


LATE = "l_linenumber > 3"
metrics("analyzer_size", [Size()], ("Dataset", "*", "Size", "count(*)"))
metrics("analyzer_size_where", [Size(LATE)], ("Dataset", "*", "Size", f"count(*) FILTER (WHERE {LATE})"))
metrics("analyzer_completeness", [Completeness("gap"), Completeness("l_tax")],
        column("gap", "Completeness", "count(gap) * 1.0 / count(*)"), column("l_tax", "Completeness", "count(l_tax) * 1.0 / count(*)"))
metrics("analyzer_completeness_where", [Completeness("gap", "l_returnflag = 'R'")],
        column("gap", "Completeness", "count(gap) * 1.0 / count(*)"), where=" WHERE l_returnflag = 'R'")
metrics("analyzer_compliance", [Compliance("small gap", "gap <= 3")],
        column("small gap", "Compliance", "sum(CASE WHEN gap <= 3 THEN 1 ELSE 0 END) * 1.0 / count(*)"))
metrics("analyzer_pattern_match", [PatternMatch("day", r"-0[1-6]-")],
        column("day", "PatternMatch", "sum(CASE WHEN regexp_matches(day, '-0[1-6]-') THEN 1 ELSE 0 END) * 1.0 / count(*)"))
metrics("analyzer_minimum", [Minimum("l_extendedprice"), Minimum("gap")],
        column("l_extendedprice", "Minimum", "min(l_extendedprice)"), column("gap", "Minimum", "min(gap)"))
metrics("analyzer_maximum", [Maximum("l_extendedprice"), Maximum("gap")],
        column("l_extendedprice", "Maximum", "max(l_extendedprice)"), column("gap", "Maximum", "max(gap)"))
metrics("analyzer_mean", [Mean("l_quantity"), Mean("gap")], column("l_quantity", "Mean", "avg(l_quantity)"), column("gap", "Mean", "avg(gap)"))
metrics("analyzer_sum", [Sum("l_quantity"), Sum("gap", LATE)],
        column("l_quantity", "Sum", "sum(l_quantity)"), column("gap", "Sum", f"sum(gap) FILTER (WHERE {LATE})"))
metrics("analyzer_standard_deviation", [StandardDeviation("l_quantity"), StandardDeviation("gap")],
        column("l_quantity", "StandardDeviation", "stddev_pop(l_quantity)"), column("gap", "StandardDeviation", "stddev_pop(gap)"))
metrics("analyzer_min_length", [MinLength("text_number")], column("text_number", "MinLength", "min(length(text_number))"))
metrics("analyzer_max_length", [MaxLength("text_truth")], column("text_truth", "MaxLength", "max(length(text_truth))"))
metrics("analyzer_correlation", [Correlation("l_quantity", "l_extendedprice")],
        ("Multicolumn", "l_quantity,l_extendedprice", "Correlation", "corr(l_quantity, l_extendedprice)"))
metrics("analyzer_approx_quantile", [ApproxQuantile("l_extendedprice", 0.5, 0.0)],
        column("l_extendedprice", "ApproxQuantile-0.5", "quantile_disc(l_extendedprice, 0.5)"))
metrics("analyzer_approx_quantiles", [ApproxQuantiles("l_quantity", [0.25, 0.5, 0.75], 0.0)],
        *[column("l_quantity", f"ApproxQuantiles-{q}", f"quantile_disc(l_quantity, {q})") for q in (0.25, 0.5, 0.75)])


def data_type_rows(c: str, sql: dict[str, str]) -> list[tuple[str, str, str, str]]:
    out = [column(c, "Histogram.bins", "max(5)")]
    for k in ("Boolean", "Fractional", "Integral", "Unknown", "String"):
        n = f"count(*) FILTER (WHERE {sql.get(k, 'false')})"
        out += [column(c, f"Histogram.abs.{k}", n), column(c, f"Histogram.ratio.{k}", f"({n}) * 1.0 / count(*)")]
    return out


for _c, _sql in (("text_number", {"Integral": "text_number IS NOT NULL"}), ("text_truth", {"Boolean": "text_truth IS NOT NULL"}),
                 ("gap", {"Integral": "gap IS NOT NULL", "Unknown": "gap IS NULL"})):
    metrics(f"analyzer_data_type_{_c}", [DataType(_c)], *data_type_rows(_c, _sql))

_W = "(SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 4.0 AS w, max(l_quantity) AS b FROM lineitem)"
_KLL = [column("l_quantity", "KLL.buckets", "4")]
for _i in range(4):
    _KLL += [column("l_quantity", f"KLL.bucket.{_i}.low", f"(SELECT a + {_i} * w FROM {_W})"),
             column("l_quantity", f"KLL.bucket.{_i}.high", f"(SELECT a + {_i + 1} * w FROM {_W})"),
             column("l_quantity", f"KLL.bucket.{_i}.count", f"(SELECT count(*) FROM lineitem, {_W} x WHERE least(floor((l_quantity - a) / w), 3) = {_i})")]
metrics("analyzer_kll_sketch", [KLLSketch("l_quantity", KLLParameters(2048, 0.64, 4))], *_KLL)
SQL["analyzer_kll_sketch"] = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, '{i}' AS instance, '{n}' AS name, round(CAST({v} AS DOUBLE), {DIGITS}) AS value" for e, i, n, v in _KLL)


def frequency(name: str, analyzer: Any, columns: list[str], metric: str, value: str, where: str = "") -> None:
    """A query for a grouping analyzer; value: SQL over the frequency table's n."""
    some = " OR ".join(f"{c} IS NOT NULL" for c in columns)
    cond = f" WHERE ({some})" + (f" AND {where}" if where else "")
    entity = "Column" if len(columns) == 1 else "Multicolumn"
    metrics(name, [analyzer])
    SQL[name] = (f"SELECT '{entity}' AS entity, '{','.join(columns)}' AS instance, '{metric}' AS name, round(CAST({value} AS DOUBLE), {DIGITS}) AS value "
                 f"FROM (SELECT {', '.join(columns)}, count(*) AS n FROM {ITEMS} t{cond} GROUP BY {', '.join(columns)})")


ONCE = "sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)"
frequency("analyzer_count_distinct", CountDistinct(["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"], "CountDistinct", "count(*)")
frequency("analyzer_distinctness", Distinctness("l_partkey"), ["l_partkey"], "Distinctness", "count(*) * 1.0 / sum(n)")
frequency("analyzer_distinctness_where", Distinctness(["l_partkey", "gap"], LATE), ["l_partkey", "gap"], "Distinctness", "count(*) * 1.0 / sum(n)", LATE)
frequency("analyzer_uniqueness", Uniqueness(["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"], "Uniqueness", f"{ONCE} * 1.0 / sum(n)")
frequency("analyzer_uniqueness_nulls", Uniqueness(["l_orderkey", "gap"]), ["l_orderkey", "gap"], "Uniqueness", f"{ONCE} * 1.0 / sum(n)")
frequency("analyzer_unique_value_ratio", UniqueValueRatio(["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"], "UniqueValueRatio", f"{ONCE} * 1.0 / count(*)")
frequency("analyzer_entropy", Entropy("gap"), ["gap"], "Entropy", "ln(sum(n)) - sum(n * ln(n)) / sum(n)")
metrics("analyzer_mutual_information", [MutualInformation(["l_returnflag", "gap"])])
SQL["analyzer_mutual_information"] = f"""
WITH j AS (SELECT l_returnflag AS x, gap AS y, count(*) AS n FROM {ITEMS} t WHERE l_returnflag IS NOT NULL OR gap IS NOT NULL GROUP BY 1, 2),
a AS (SELECT x, sum(n) AS nx FROM j GROUP BY x), b AS (SELECT y, sum(n) AS ny FROM j GROUP BY y), s AS (SELECT sum(n) AS t FROM j)
SELECT 'Multicolumn' AS entity, 'l_returnflag,gap' AS instance, 'MutualInformation' AS name,
round(CAST(sum(n * 1.0 / t * ln(n * 1.0 * t / (nx * ny))) AS DOUBLE), {DIGITS}) AS value FROM j JOIN a USING (x) JOIN b USING (y), s"""


def histogram_sql(c: str, limit: int) -> str:
    head = f"SELECT 'Column' AS entity, '{c}' AS instance,"
    base = f"(SELECT coalesce(CAST({c} AS VARCHAR), 'NullValue') AS v, count(*) AS n FROM {ITEMS} t GROUP BY 1)"
    top = f"(SELECT v, n FROM {base} ORDER BY n DESC, v LIMIT {limit})"
    return (f"{head} 'Histogram.bins' AS name, CAST(count(*) AS DOUBLE) AS value FROM {base} "
            f"UNION ALL {head} 'Histogram.abs.' || v AS name, CAST(n AS DOUBLE) AS value FROM {top} "
            f"UNION ALL {head} 'Histogram.ratio.' || v AS name, round(n * 1.0 / (SELECT count(*) FROM lineitem), {DIGITS}) AS value FROM {top}")


metrics("analyzer_histogram", [Histogram("gap")])
SQL["analyzer_histogram"] = histogram_sql("gap", 1000)
metrics("analyzer_histogram_max_bins", [Histogram("text_number", maxDetailBins=3)])
SQL["analyzer_histogram_max_bins"] = histogram_sql("text_number", 3)
metrics("analyzer_histogram_binned", [Histogram("l_quantity", lambda c: F.floor(c / 10).cast("int"))])
SQL["analyzer_histogram_binned"] = histogram_sql("l_quantity", 1000).replace("CAST(l_quantity AS VARCHAR)", "CAST(CAST(floor(l_quantity / 10) AS INTEGER) AS VARCHAR)")


def approx_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch's count is within 15 % of the exact one."""
    df = items(spark, sf_dir)
    got = AnalysisRunner(spark).onData(df).addAnalyzers([ApproxCountDistinct("l_partkey"), CountDistinct("l_partkey")]).run().metrics()
    return spark.createDataFrame([("l_partkey", got[1].value, abs(got[0].value - got[1].value) <= 0.15 * got[1].value)],
                                 "instance string, exact double, within_tolerance boolean")


QUERIES["analyzer_approx_count_distinct_within_tolerance"] = approx_count_distinct
SQL["analyzer_approx_count_distinct_within_tolerance"] = (
    "SELECT 'l_partkey' AS instance, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS exact, count(DISTINCT l_partkey) > 0 AS within_tolerance FROM lineitem")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight metrics in one scan."""
    wanted = [Size(), Completeness("gap"), Mean("l_quantity"), Minimum("l_quantity"), Maximum("l_tax"), Sum("l_extendedprice"),
              StandardDeviation("l_discount"), Compliance("cheap", "l_extendedprice < 1000")]
    context = AnalysisRunner(spark).onData(items(spark, sf_dir)).addAnalyzers(wanted).run()
    return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", 4))


QUERIES["analysis_fused_scan"] = fused
SQL["analysis_fused_scan"] = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, '{i}' AS instance, '{n}' AS name, round(CAST({v} AS DOUBLE), 4) AS value FROM {ITEMS} t" for e, i, n, v in (
        ("Dataset", "*", "Size", "count(*)"), column("gap", "Completeness", "count(gap) * 1.0 / count(*)"), column("l_quantity", "Mean", "avg(l_quantity)"),
        column("l_quantity", "Minimum", "min(l_quantity)"), column("l_tax", "Maximum", "max(l_tax)"), column("l_extendedprice", "Sum", "sum(l_extendedprice)"),
        column("l_discount", "StandardDeviation", "stddev_pop(l_discount)"),
        column("cheap", "Compliance", "sum(CASE WHEN l_extendedprice < 1000 THEN 1 ELSE 0 END) * 1.0 / count(*)")))


# -- checks -------------------------------------------------------------------

def check(method: str, build: Callable[[Check], Check], value: str, holds: str, name: str | None = None) -> None:
    """A query for one method of Check; value: SQL of the metric; holds: SQL of the assertion on v."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = build(Check(spark, CheckLevel.Warning, method))
        result = VerificationSuite(spark).onData(items(spark, sf_dir)).addCheck(made).run()
        c = made.constraints[-1]
        got = c.pick(result.metrics[c.analyzer].value)
        shown = float(got) if isinstance(got, (int, float)) else math.nan
        row = result.checkResults[-1]
        df = spark.createDataFrame([(method, row["check_status"], row["constraint_status"], shown)],
                                   "method string, check_status string, constraint_status string, value double")
        return df.withColumn("value", F.round(F.nanvl("value", F.lit(-1.0)), DIGITS))

    key = f"check_{name or method}"
    QUERIES[key] = run
    SQL[key] = (f"SELECT '{method}' AS method, CASE WHEN {holds} THEN 'Success' ELSE 'Warning' END AS check_status, "
                f"CASE WHEN {holds} THEN 'Success' ELSE 'Failure' END AS constraint_status, round(CAST({{}} AS DOUBLE), {DIGITS}) AS value "
                f"FROM (SELECT {value} AS v FROM {ITEMS} t)").format("v" if "struct" not in holds else "-1")


def rate(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) * 1.0 / count(*)"


def freq(columns: str, value: str) -> str:
    some = " OR ".join(f"{c.strip()} IS NOT NULL" for c in columns.split(","))
    return f"(SELECT {value} FROM (SELECT count(*) AS n FROM {ITEMS} q WHERE {some} GROUP BY {columns}) r)"


check("hasSize", lambda c: c.hasSize(lambda x: x > 100), "count(*)", "v > 100")
check("isComplete", lambda c: c.isComplete("gap"), rate("gap IS NOT NULL"), "v = 1")
check("hasCompleteness", lambda c: c.hasCompleteness("gap", lambda x: x > 0.5), rate("gap IS NOT NULL"), "v > 0.5")
check("areComplete", lambda c: c.areComplete(["l_tax", "l_orderkey"]), rate("l_tax IS NOT NULL AND l_orderkey IS NOT NULL"), "v = 1")
check("haveCompleteness", lambda c: c.haveCompleteness(["gap", "l_tax"], lambda x: x < 0.9), rate("gap IS NOT NULL AND l_tax IS NOT NULL"), "v < 0.9")
check("areAnyComplete", lambda c: c.areAnyComplete(["gap", "l_tax"]), rate("gap IS NOT NULL OR l_tax IS NOT NULL"), "v = 1")
check("haveAnyCompleteness", lambda c: c.haveAnyCompleteness(["gap"], lambda x: x > 0.99), rate("gap IS NOT NULL"), "v > 0.99")
check("isUnique", lambda c: c.isUnique("l_partkey"), freq("l_partkey", f"{ONCE} * 1.0 / sum(n)") + " FROM (SELECT 1)", "v = 1")
check("isPrimaryKey", lambda c: c.isPrimaryKey("l_orderkey", "l_linenumber"), freq("l_orderkey, l_linenumber", f"{ONCE} * 1.0 / sum(n)"), "v = 1")
check("hasUniqueness", lambda c: c.hasUniqueness(["l_orderkey", "l_partkey"], lambda x: x > 0.9), freq("l_orderkey, l_partkey", f"{ONCE} * 1.0 / sum(n)"), "v > 0.9")
check("hasDistinctness", lambda c: c.hasDistinctness(["l_partkey"], lambda x: x < 0.5), freq("l_partkey", "count(*) * 1.0 / sum(n)"), "v < 0.5")
check("hasUniqueValueRatio", lambda c: c.hasUniqueValueRatio(["l_partkey", "l_suppkey"], lambda x: x > 0.5), freq("l_partkey, l_suppkey", f"{ONCE} * 1.0 / count(*)"), "v > 0.5")
check("hasNumberOfDistinctValues", lambda c: c.hasNumberOfDistinctValues("gap", lambda x: x == 7), "count(DISTINCT coalesce(gap, -1))", "v = 7")
check("hasHistogramValues", lambda c: c.hasHistogramValues("l_returnflag", lambda d: d["R"].ratio > 0.1), rate("l_returnflag = 'R'"), "'struct' <> '' AND v > 0.1")
check("kllSketchSatisfies", lambda c: c.kllSketchSatisfies("l_quantity", lambda d: d.buckets[0].count > 100 and d.parameters[0] == 0.64),
      f"count(*) FILTER (WHERE l_quantity < (SELECT min(l_quantity) + (max(l_quantity) - min(l_quantity)) / 100 FROM {ITEMS} r))", "'struct' <> '' AND v > 100")
check("hasEntropy", lambda c: c.hasEntropy("l_returnflag", lambda x: x > 0.5), freq("l_returnflag", "ln(sum(n)) - sum(n * ln(n)) / sum(n)"), "v > 0.5")
check("hasMutualInformation", lambda c: c.hasMutualInformation("l_returnflag", "gap", lambda x: x < 0.1),
      "(SELECT value FROM (" + SQL["analyzer_mutual_information"] + ") m)", "v < 0.1")
check("hasApproxQuantile", lambda c: c.hasApproxQuantile("l_linenumber", ".5", lambda x: x < 6), "quantile_disc(l_linenumber, 0.5)", "v < 6")
check("hasMinLength", lambda c: c.hasMinLength("text_number", lambda x: x >= 1), "min(length(text_number))", "v >= 1")
check("hasMaxLength", lambda c: c.hasMaxLength("text_truth", lambda x: x < 5), "max(length(text_truth))", "v < 5")
check("hasMin", lambda c: c.hasMin("l_quantity", lambda x: x >= 1), "min(l_quantity)", "v >= 1")
check("hasMax", lambda c: c.hasMax("l_quantity", lambda x: x <= 10), "max(l_quantity)", "v <= 10")
check("hasMean", lambda c: c.hasMean("l_quantity", lambda x: 20 < x < 30), "avg(l_quantity)", "v > 20 AND v < 30")
check("hasSum", lambda c: c.hasSum("l_quantity", lambda x: x > 1e4), "sum(l_quantity)", "v > 1e4")
check("hasStandardDeviation", lambda c: c.hasStandardDeviation("l_quantity", lambda x: x < 1), "stddev_pop(l_quantity)", "v < 1")
check("hasCorrelation", lambda c: c.hasCorrelation("l_quantity", "l_extendedprice", lambda x: x > 0), "corr(l_quantity, l_extendedprice)", "v > 0")
check("satisfies", lambda c: c.satisfies("l_tax >= 0 AND l_discount < 0.05", "cheap", lambda x: x > 0.2), rate("l_tax >= 0 AND l_discount < 0.05"), "v > 0.2")
check("hasPattern", lambda c: c.hasPattern("day", "^199[0-9]-", lambda x: x >= 0), rate("regexp_matches(day, '^199[0-9]-')"), "v >= 0")
check("isNonNegative", lambda c: c.isNonNegative("gap"), rate("coalesce(gap, 0) >= 0"), "v = 1")
check("isPositive", lambda c: c.isPositive("l_discount"), rate("coalesce(l_discount, 1) > 0"), "v = 1")
check("isLessThan", lambda c: c.isLessThan("l_tax", "l_discount", lambda x: x > 0.5), rate("l_tax < l_discount"), "v > 0.5")
check("isLessThanOrEqualTo", lambda c: c.isLessThanOrEqualTo("gap", "l_quantity", lambda x: x > 0.5), rate("gap <= l_quantity"), "v > 0.5")
check("isGreaterThan", lambda c: c.isGreaterThan("l_quantity", "gap", lambda x: x > 0.9), rate("l_quantity > gap"), "v > 0.9")
check("isGreaterThanOrEqualTo", lambda c: c.isGreaterThanOrEqualTo("l_extendedprice", "l_quantity"), rate("l_extendedprice >= l_quantity"), "v = 1")
check("isContainedIn", lambda c: c.isContainedIn("l_returnflag", ["A", "N"], lambda x: x > 0.5), rate("l_returnflag IS NULL OR l_returnflag IN ('A', 'N')"), "v > 0.5")
check("hasDataType", lambda c: c.hasDataType("text_number", ConstrainableDataTypes.Integral), rate("text_number IS NOT NULL"), "v = 1")
check("hasDataType", lambda c: c.hasDataType("gap", ConstrainableDataTypes.Numeric), "max(1.0)", "v = 1", name="hasDataType_numeric")
check("hasSize", lambda c: c.hasSize(lambda x: x < 100).where("l_returnflag = 'R'"), "count(*) FILTER (WHERE l_returnflag = 'R')", "v < 100", name="where")
SQL["check_isUnique"] = SQL["check_isUnique"].replace(" FROM (SELECT 1)", "")
for _k in [k for k in SQL if k.startswith("check_") and "r) AS v FROM" in SQL[k] or k == "check_hasMutualInformation"]:
    SQL[_k] = SQL[_k].replace(f" AS v FROM {ITEMS} t)", " AS v)")  # the metric is a subquery: one row, not one per item


def approx_distinct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Check(spark, CheckLevel.Error, "distinct").hasApproxCountDistinct("l_linenumber", lambda x: 6 <= x <= 8)
    result = VerificationSuite(spark).onData(items(spark, sf_dir)).addCheck(made).run()
    return VerificationResult.checkResultsAsDataFrame(spark, result).select("check_status", "constraint_status")


QUERIES["check_hasApproxCountDistinct"] = approx_distinct_check
SQL["check_hasApproxCountDistinct"] = f"SELECT 'Success' AS check_status, 'Success' AS constraint_status FROM (SELECT count(DISTINCT l_linenumber) AS n FROM {ITEMS} t) WHERE n BETWEEN 6 AND 8"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of generated contact data that the four named patterns accept."""
    users = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("@example.com")).alias("email"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "http://").otherwise("htp:/"), F.lit("example.com/"), F.col("c_custkey").cast("string")).alias("url"),
        F.when(F.col("c_custkey") % 5 == 0, "000-00-0000").otherwise("123-45-6789").alias("ssn"),
        F.when(F.col("c_custkey") % 4 == 0, "1111").otherwise("4532677117740914").alias("card"))
    some = lambda x: x >= 0
    made = (Check(spark, CheckLevel.Error, "patterns").containsEmail("email", some).containsURL("url", some)
            .containsSocialSecurityNumber("ssn", some).containsCreditCardNumber("card", some))
    result = VerificationSuite(spark).onData(users).addCheck(made).run()
    return VerificationResult.successMetricsAsDataFrame(spark, result).select("instance", F.round("value", DIGITS).alias("value"))


QUERIES["check_contains_patterns"] = patterns
SQL["check_contains_patterns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS instance, round(sum(CASE WHEN c_custkey % {k} {op} 0 THEN 1 ELSE 0 END) * 1.0 / count(*), {DIGITS}) AS value FROM customer"
    for c, k, op in (("email", 3, "<>"), ("url", 2, "="), ("ssn", 5, "<>"), ("card", 4, "<>")))


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of different levels, as result rows."""
    a = Check(spark, CheckLevel.Error, "keys").isComplete("l_orderkey").isPrimaryKey("l_orderkey", "l_linenumber")
    b = Check(spark, CheckLevel.Warning, "gaps").isComplete("gap").hasMin("l_quantity", lambda x: x >= 1)
    result = VerificationSuite(spark).onData(items(spark, sf_dir)).addCheck(a).addCheck(b).run()
    df = VerificationResult.checkResultsAsDataFrame(spark, result)
    return df.select("check", "check_level", "check_status", "constraint_status", F.length("constraint_message").alias("message_length"))


QUERIES["verification_check_results"] = verification
SQL["verification_check_results"] = f"""WITH m AS (SELECT count(*) - count(l_orderkey) AS nulls, count(*) AS n, count(gap) AS filled, min(l_quantity) AS low FROM {ITEMS} t),
u AS (SELECT count(*) FILTER (WHERE c = 1) * 1.0 / sum(c) AS alone FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) g),
c AS (SELECT 'keys' AS "check", 'Error' AS check_level, 1 AS i, CAST(1 - nulls / n AS DOUBLE) AS v, nulls = 0 AS ok FROM m
UNION ALL SELECT 'keys', 'Error', 2, alone, alone = 1 FROM u UNION ALL SELECT 'gaps', 'Warning', 3, CAST(filled AS DOUBLE) / n, filled = n FROM m
UNION ALL SELECT 'gaps', 'Warning', 4, low, low >= 1 FROM m)
SELECT "check", check_level, CASE WHEN bool_and(ok) OVER (PARTITION BY "check") THEN 'Success' ELSE check_level END AS check_status,
CASE WHEN ok THEN 'Success' ELSE 'Failure' END AS constraint_status,
CAST(CASE WHEN ok THEN 0 ELSE length('Value: ' || CAST(v AS VARCHAR) || ' does not meet the constraint requirement!') END AS INTEGER) AS message_length FROM c"""

# -- results by row -----------------------------------------------------------

def by_row(name: str, build: Callable[[Check], Check], cond: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir)
        made = build(Check(spark, CheckLevel.Error, "ok"))
        result = VerificationSuite(spark).onData(df).addCheck(made).run()
        return VerificationResult.rowLevelResultsAsDataFrame(spark, result, df).select("l_orderkey", "l_linenumber", "ok")

    QUERIES[f"rowlevel_{name}"] = run
    SQL[f"rowlevel_{name}"] = f"SELECT l_orderkey, l_linenumber, {cond} AS ok FROM {ITEMS} t"


by_row("is_complete", lambda c: c.isComplete("gap"), "gap IS NOT NULL")
by_row("satisfies", lambda c: c.satisfies("gap < 4", "few"), "coalesce(gap < 4, false)")
by_row("contained_in", lambda c: c.isContainedIn("l_returnflag", ["A", "N"]), "coalesce(l_returnflag IN ('A', 'N'), true)")
by_row("pattern", lambda c: c.hasPattern("day", "-0[1-6]-"), "regexp_matches(day, '-0[1-6]-')")
by_row("unique", lambda c: c.isUnique("l_partkey"), "count(*) OVER (PARTITION BY l_partkey) = 1")
by_row("unique_where", lambda c: c.isUnique("l_partkey").where("l_returnflag = 'R'"),
       "l_returnflag <> 'R' OR count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_partkey) = 1")
by_row("two_constraints", lambda c: c.isComplete("gap").isPositive("l_discount"), "gap IS NOT NULL AND l_discount > 0")
by_row("where", lambda c: c.isComplete("gap").where("l_returnflag = 'R'"), "l_returnflag <> 'R' OR gap IS NOT NULL")
by_row("minimum", lambda c: c.hasMin("gap", lambda x: x >= 3), "gap IS NULL OR gap >= 3")


# -- profiles -----------------------------------------------------------------

PROFILED = ["l_quantity", "gap", "l_returnflag", "text_number"]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ColumnProfilerRunner(spark).onData(items(spark, sf_dir)).restrictToColumns(PROFILED).run()
    rows = []
    for c, p in got.profiles.items():
        facts = {"completeness": p.completeness, **{k: getattr(p, k) for k in ("mean", "minimum", "maximum", "minLength", "maxLength") if getattr(p, k, None) is not None}}
        rows += [(c, p.dataType, k, round(float(v), DIGITS)) for k, v in facts.items()]
    return spark.createDataFrame(rows, "column string, data_type string, fact string, value double")


def _profile_sql() -> str:
    out = []
    for c, kind, number in (("l_quantity", "Fractional", "l_quantity"), ("gap", "Integral", "gap"), ("l_returnflag", "String", None), ("text_number", "Integral", "CAST(text_number AS DOUBLE)")):
        facts = {"completeness": f"count({c}) * 1.0 / count(*)"}
        if number:
            facts |= {"mean": f"avg({number})", "minimum": f"min({number})", "maximum": f"max({number})"}
        else:
            facts |= {"minLength": f"min(length({c}))", "maxLength": f"max(length({c}))"}
        out += [f"SELECT '{c}' AS \"column\", '{kind}' AS data_type, '{k}' AS fact, round(CAST({v} AS DOUBLE), {DIGITS}) AS value FROM {ITEMS} t" for k, v in facts.items()]
    return " UNION ALL ".join(out)


QUERIES["profile_columns"] = profiles
SQL["profile_columns"] = _profile_sql()


def profile_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ColumnProfilerRunner(spark).onData(items(spark, sf_dir)).restrictToColumns(["l_returnflag", "gap"]).run()
    rows = [(c, v.value, v.absolute, round(v.ratio, DIGITS)) for c, p in got.profiles.items() for v in p.histogram]
    return spark.createDataFrame(rows, "column string, bin string, n long, ratio double")


QUERIES["profile_histograms"] = profile_histograms
SQL["profile_histograms"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'NullValue') AS bin, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM lineitem), {DIGITS}) AS ratio "
    f"FROM {ITEMS} t GROUP BY 2" for c in ("l_returnflag", "gap"))


def profile_kll(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = (ColumnProfilerRunner(spark).onData(items(spark, sf_dir)).restrictToColumns(["l_quantity"]).withKLLProfiling()
           .setKLLParameters(KLLParameters(2048, 0.64, 5)).run())
    return spark.createDataFrame([(b.lowValue, b.highValue, b.count) for b in got.profiles["l_quantity"].kll.buckets], "low double, high double, n long")


QUERIES["profile_kll"] = profile_kll
SQL["profile_kll"] = """WITH m AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high, (max(l_quantity) - min(l_quantity)) / 5 AS step FROM lineitem),
b AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS i),
c AS (SELECT least(CAST(floor((l_quantity - low) / step) AS INTEGER), 4) AS i, count(*) AS n FROM lineitem, m GROUP BY 1)
SELECT low + b.i * step AS low, CASE WHEN b.i = 4 THEN high ELSE low + (b.i + 1) * step END AS high, coalesce(n, 0) AS n FROM b CROSS JOIN m LEFT JOIN c ON c.i = b.i"""


def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and deviations of numeric profiles; a text column is profiled by its predefined type, and one has no histogram for its threshold."""
    got = (ColumnProfilerRunner(spark).onData(items(spark, sf_dir)).restrictToColumns(["l_quantity", "text_number", "l_returnflag"])
           .setPredefinedTypes({"text_number": DataTypeInstances.Integral}).withLowCardinalityHistogramThreshold(2).run())
    rows = [(c, p.dataType, float(getattr(p, "sum", None) or 0), round(float(getattr(p, "stdDev", None) or 0), 4), p.histogram is not None)
            for c, p in got.profiles.items()]
    return spark.createDataFrame(rows, "column string, kind string, total double, deviation double, has_histogram boolean")


QUERIES["profile_numbers"] = profile_numbers
SQL["profile_numbers"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, CAST({s} AS DOUBLE) AS total, CAST({d} AS DOUBLE) AS deviation, {h} AS has_histogram FROM {ITEMS} t"
    for c, k, s, d, h in (("l_quantity", "Fractional", "sum(l_quantity)", "round(stddev_pop(l_quantity), 4)", "false"),
                          ("text_number", "Integral", "sum(CAST(text_number AS DOUBLE))", "round(stddev_pop(CAST(text_number AS DOUBLE)), 4)", "false"),
                          ("l_returnflag", "String", "0", "0", "count(DISTINCT l_returnflag) <= 2")))

# -- suggestions --------------------------------------------------------------

def suggestion(name: str, rule: Any, sql: str | None = None, columns: tuple[str, ...] = ("l_orderkey", "gap", "l_returnflag", "text_number", "l_discount")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir).select(*columns)
        found = ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(rule).run()["constraint_suggestions"]
        return spark.createDataFrame([(s["column_name"], s["description"], s["code_for_constraint"]) for s in found],
                                     "column_name string, description string, code string")

    QUERIES[f"suggest_{name}"] = run
    if sql:
        SQL[f"suggest_{name}"] = sql


def _said(c: str, text: str, code: str) -> str:
    return f"SELECT '{c}' AS column_name, '{text}' AS description, '{code}' AS code"


suggestion("complete_if_complete", CompleteIfCompleteRule(), " UNION ALL ".join(
    _said(c, f"''{c}'' is not null", f'.isComplete("{c}")') for c in ("l_orderkey", "l_returnflag", "text_number", "l_discount")))
suggestion("non_negative_numbers", NonNegativeNumbersRule(), " UNION ALL ".join(
    _said(c, f"''{c}'' has no negative values", f'.isNonNegative("{c}")') for c in ("l_orderkey", "gap", "text_number", "l_discount")))
suggestion("retain_type", RetainTypeRule(), _said("text_number", "''text_number'' has type Integral", '.hasDataType("text_number", ConstrainableDataTypes.Integral)'))
suggestion("categorical_range", CategoricalRangeRule(), f"""
WITH f AS (SELECT l_returnflag AS v, count(*) AS n FROM {ITEMS} t GROUP BY 1)
SELECT 'l_returnflag' AS column_name, '''l_returnflag'' has value range ' || string_agg('''' || v || '''', ', ' ORDER BY n DESC, v) AS description,
'.isContainedIn("l_returnflag", [' || string_agg('"' || v || '"', ', ' ORDER BY n DESC, v) || '])' AS code FROM f""")
suggestion("fractional_categorical_range", FractionalCategoricalRangeRule(), """
WITH c AS (SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT *, sum(n) OVER (ORDER BY n DESC, v) - n AS before, sum(n) OVER () AS total FROM c),
a AS (SELECT string_agg('''' || v || '''', ', ' ORDER BY n DESC, v) AS shown, string_agg('"' || v || '"', ', ' ORDER BY n DESC, v) AS listed,
      CAST(sum(n) AS DOUBLE) / max(total) AS s, max(total) AS total FROM t WHERE before < 0.9 * total),
b AS (SELECT *, floor(100 * (s - 1.96 * sqrt(s * (1 - s) / total))) / 100 AS bound FROM a)
SELECT 'l_returnflag' AS column_name, '''l_returnflag'' has value range ' || shown || ' for at least ' || CAST(CAST(100 * bound AS INTEGER) AS VARCHAR) || '% of values' AS description,
'.isContainedIn("l_returnflag", [' || listed || '], lambda x: x >= ' || CAST(bound AS VARCHAR) || ', "It should be above ' || CAST(bound AS VARCHAR) || '!")' AS code FROM b""")
suggestion("unique_if_approximately_unique", UniqueIfApproximatelyUniqueRule(), " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '''{c}'' is unique' AS description, '.isUnique(\"{c}\")' AS code FROM {ITEMS} t HAVING count(DISTINCT {c}) >= 0.92 * count(*)"
    for c in ("l_orderkey", "l_partkey", "day")), columns=("l_orderkey", "l_partkey", "day"))


def unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniqueness rule on a key, with the verdict of the rows held out on the suggestion."""
    made = (ConstraintSuggestionRunner(spark).onData(table(spark, sf_dir, "orders").select("o_orderkey")).addConstraintRule(UniqueIfApproximatelyUniqueRule())
            .useTrainTestSplitWithTestsetRatio(0.3, 1).run()["constraint_suggestions"])
    return spark.createDataFrame([(s["column_name"], s["code_for_constraint"], s["constraint_result_on_test_set"]) for s in made],
                                 "column_name string, code string, on_test_set string")


QUERIES["suggest_unique_key"] = unique_key
SQL["suggest_unique_key"] = ("SELECT 'o_orderkey' AS column_name, '.isUnique(\"o_orderkey\")' AS code, 'Success' AS on_test_set FROM orders "
                             "HAVING count(DISTINCT o_orderkey) = count(*)")
suggestion("retain_completeness", RetainCompletenessRule(), f"""
WITH s AS (SELECT count(gap) * 1.0 / count(*) AS p, count(*) AS n FROM {ITEMS} t), b AS (SELECT CAST(floor(100 * (p - 1.96 * sqrt(p * (1 - p) / n))) AS INTEGER) AS c FROM s)
SELECT 'gap' AS column_name, '''gap'' has less than ' || (100 - c) || '% missing values' AS description,
'.hasCompleteness("gap", lambda x: x >= ' || (CASE WHEN c % 10 = 0 THEN '0.' || (c / 10)::INTEGER ELSE '0.' || lpad(CAST(c AS VARCHAR), 2, '0') END) || ', "It should be above ' ||
(CASE WHEN c % 10 = 0 THEN '0.' || (c / 10)::INTEGER ELSE '0.' || lpad(CAST(c AS VARCHAR), 2, '0') END) || '!")' AS code FROM b""")


# -- anomalies and the repository ---------------------------------------------

MONTHLY = "(SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"


def monthly(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """Orders per month: a history of the Size metric."""
    rows = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).count().orderBy("month").collect()
    return [(m, float(n)) for m, n in rows]


def anomaly(name: str, strategy: Any, normal: str | None) -> None:
    """Each month judged by all before it; normal: SQL of the verdict over the window table w."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = monthly(spark, sf_dir)
        values = [v for _, v in series]
        rows = [(m, v, strategy.problem(values[:i]) is None and strategy.is_normal(values[:i], v)) for i, (m, v) in enumerate(series)]
        return spark.createDataFrame(rows, "month string, value double, normal boolean")

    QUERIES[f"anomaly_{name}"] = run
    if normal:
        SQL[f"anomaly_{name}"] = f"""SELECT month, v AS value, {normal} AS normal FROM (
SELECT month, v, lag(v, 1) OVER (ORDER BY month) AS p, lag(v, 2) OVER (ORDER BY month) AS p2,
avg(v) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
stddev_samp(v) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
avg(v) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS mi, stddev_pop(v) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS si FROM {MONTHLY} x) w"""


anomaly("simple_threshold", SimpleThresholdStrategy(10, 1e9), "v BETWEEN 10 AND 1e9")
anomaly("absolute_change", AbsoluteChangeStrategy(-8.0, 8.0), "p IS NULL OR v - p BETWEEN -8 AND 8")
anomaly("absolute_change_second_order", AbsoluteChangeStrategy(-12.0, 12.0, 2), "p2 IS NULL OR v - 2 * p + p2 BETWEEN -12 AND 12")
anomaly("relative_rate_of_change", RelativeRateOfChangeStrategy(0.9, 1.1), "p IS NULL OR v / p BETWEEN 0.9 AND 1.1")
anomaly("batch_normal", BatchNormalStrategy(1.0, 1.0), "m IS NULL OR v BETWEEN m - coalesce(s, 0) AND m + coalesce(s, 0)")
anomaly("online_normal", OnlineNormalStrategy(1.0, 1.0, 0.0, False), "v BETWEEN mi - si AND mi + si")
anomaly("holt_winters", HoltWinters(), None)


def anomaly_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest year's order count against the year before, through a repository."""
    orders, repository = table(spark, sf_dir, "orders"), InMemoryMetricsRepository(spark)
    result = None
    for i, year in enumerate((1995, 1996)):
        part = orders.where(F.year("o_orderdate") == year)
        result = (VerificationSuite(spark).onData(part).useRepository(repository).saveOrAppendResult(ResultKey(i))
                  .addAnomalyCheck(RelativeRateOfChangeStrategy(0.5, 2.0), Size()).run())
    history = repository.load().forAnalyzers([Size()]).getSuccessMetricsAsDataFrame()
    return history.select("dataset_date", "name", "value").withColumn("status", F.lit(result.status))


QUERIES["anomaly_check_with_repository"] = anomaly_check
SQL["anomaly_check_with_repository"] = """WITH y AS (SELECT CAST(year(o_orderdate) - 1995 AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1)
SELECT d AS dataset_date, 'Size' AS name, n AS value, (SELECT CASE WHEN max(n) FILTER (WHERE d = 1) / max(n) FILTER (WHERE d = 0) BETWEEN 0.5 AND 2 THEN 'Success' ELSE 'Warning' END FROM y) AS status FROM y"""


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each priority's orders, saved under tags and queried back."""
    repo, orders = InMemoryMetricsRepository(spark), table(spark, sf_dir, "orders")
    for i, status in enumerate(("F", "O", "P")):
        (AnalysisRunner(spark).onData(orders.where(F.col("o_orderstatus") == status)).addAnalyzer(Size()).addAnalyzer(Completeness("o_custkey"))
         .useRepository(repo).saveOrAppendResult(ResultKey(1000 + i, {"status": status})).run())
    got = repo.load().after(1001).forAnalyzers([Size()]).getSuccessMetricsAsDataFrame()
    return got.select("entity", "instance", "name", "value", "dataset_date", "status")


QUERIES["repository_query"] = repository
SQL["repository_query"] = " UNION ALL ".join(
    f"SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, CAST({d} AS BIGINT) AS dataset_date, '{s}' AS status FROM orders WHERE o_orderstatus = '{s}'"
    for d, s in ((1001, "O"), (1002, "P")))


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each priority's orders, saved to a file through Hadoop under tags, twice, and read back by tag and date."""
    path, orders = FileSystemMetricsRepository.helper_metrics_file(spark), table(spark, sf_dir, "orders")
    repo = FileSystemMetricsRepository(spark, path)
    for i, status in enumerate(("F", "O", "F")):
        (AnalysisRunner(spark).onData(orders.where(F.col("o_orderstatus") == status)).addAnalyzer(Size()).useRepository(repo)
         .saveOrAppendResult(ResultKey(1000 + i, {"status": status})).run())
    got = FileSystemMetricsRepository(spark, path).load().withTagValues({"status": "F"}).before(1001).getSuccessMetricsAsJson()
    return spark.createDataFrame([(m["name"], float(m["value"]), int(m["dataset_date"]), m["status"]) for m in got],
                                 "name string, value double, dataset_date long, status string")


QUERIES["repository_files"] = repository_files
SQL["repository_files"] = "SELECT 'Size' AS name, CAST(count(*) AS DOUBLE) AS value, CAST(1000 AS BIGINT) AS dataset_date, 'F' AS status FROM orders WHERE o_orderstatus = 'F'"


def two_binnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histograms of one column under different binnings, kept apart by a repository."""
    repo = InMemoryMetricsRepository(spark)
    tens, halves = Histogram("l_quantity", lambda c: F.floor(c / 10).cast("int")), Histogram("l_quantity", lambda c: F.floor(c / 25).cast("int"))
    AnalysisRunner(spark).onData(items(spark, sf_dir)).addAnalyzer(tens).addAnalyzer(halves).useRepository(repo).saveOrAppendResult(ResultKey(1)).run()
    got = [repo.load().forAnalyzers([a]).getSuccessMetricsAsJson() for a in (tens, halves)]
    return spark.createDataFrame([(k, m["name"], round(float(m["value"]), DIGITS)) for k, ms in zip(("tens", "halves"), got, strict=True) for m in ms
                                  if m["name"] == "Histogram.bins"], "binning string, name string, value double")


QUERIES["repository_two_binnings"] = two_binnings
SQL["repository_two_binnings"] = " UNION ALL ".join(
    f"SELECT '{k}' AS binning, 'Histogram.bins' AS name, CAST(count(DISTINCT floor(l_quantity / {d})) AS DOUBLE) AS value FROM lineitem" for k, d in (("tens", 10), ("halves", 25)))


def offset_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation of values far from zero, from the states of parts."""
    df = items(spark, sf_dir).select("l_returnflag", (F.col("l_quantity") + 1e9).alias("far"))
    parts = [states.states(df.where(F.col("l_returnflag") == f), ["far"]) for f in ("A", "N", "R")]
    found = states.metrics(states.merge(parts)).where("name = 'StandardDeviation'")
    return found.select("instance", "name", F.round("value", 3).alias("value"))


QUERIES["states_merged_offset"] = offset_states
SQL["states_merged_offset"] = "SELECT 'far' AS instance, 'StandardDeviation' AS name, round(stddev_pop(l_quantity), 3) AS value FROM lineitem"


def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the whole table from the states of its parts."""
    df = items(spark, sf_dir)
    parts = [states.states(df.where(F.col("l_returnflag") == f), ["l_quantity", "gap"]) for f in ("A", "N", "R")]
    return states.metrics(states.merge(parts)).where("name <> 'ApproxCountDistinct'").withColumn("value", F.round("value", 4))


QUERIES["states_merged"] = merged_states
SQL["states_merged"] = " UNION ALL ".join(
    f"SELECT 'Column' AS entity, '{c}' AS instance, '{n}' AS name, round(CAST({v} AS DOUBLE), 4) AS value FROM {ITEMS} t"
    for c in ("l_quantity", "gap") for n, v in (("Completeness", f"count({c}) * 1.0 / count(*)"), ("Sum", f"sum({c})"), ("Mean", f"avg({c})"),
                                                ("StandardDeviation", f"stddev_pop({c})"), ("Minimum", f"min({c})"), ("Maximum", f"max({c})")))


# -- states of parts: each flag's items are read once, and an empty part -----------------

STATE_PARTS = ("A", "N", "R", "none")


def from_states(name: str, analyzers: list, *of: str, digits: int = DIGITS) -> None:
    """Metrics of all items from the states of their parts; the SQL is that of the queries ``of`` over the whole."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir)
        merged = States.merge([States.of(df.where(F.col("l_returnflag") == f), analyzers) for f in STATE_PARTS])
        context = AnalysisRunner.onStates(merged, analyzers)
        return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", digits))

    QUERIES[name] = run
    SQL[name] = " UNION ALL ".join(f"({SQL[q]})" for q in of) if len(of) > 1 else SQL[of[0]]


def whole(analyzer: Any, columns: list[str], metric: str, value: str, where: str = "") -> str:
    """SQL of a grouping metric, through a query of its own that is not kept."""
    frequency("tmp", analyzer, columns, metric, value, where)
    QUERIES.pop("tmp")
    return SQL.pop("tmp")


_GROUPED = [(Uniqueness(["l_orderkey", "gap"]), ["l_orderkey", "gap"], "Uniqueness", f"{ONCE} * 1.0 / sum(n)", ""),
            (Distinctness(["l_partkey", "gap"], LATE), ["l_partkey", "gap"], "Distinctness", "count(*) * 1.0 / sum(n)", LATE),
            (UniqueValueRatio(["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"], "UniqueValueRatio", f"{ONCE} * 1.0 / count(*)", ""),
            (CountDistinct(["l_suppkey"]), ["l_suppkey"], "CountDistinct", "count(*)", ""),
            (Entropy("gap"), ["gap"], "Entropy", "ln(sum(n)) - sum(n * ln(n)) / sum(n)", "")]
from_states("states_frequency", [g[0] for g in _GROUPED], "analyzer_entropy")
SQL["states_frequency"] = " UNION ALL ".join(whole(*g) for g in _GROUPED)
from_states("states_mutual_information", [MutualInformation(["l_returnflag", "gap"])], "analyzer_mutual_information")
from_states("states_histogram", [Histogram("gap")], "analyzer_histogram")
from_states("states_data_type", [DataType("gap")], "analyzer_data_type_gap")
from_states("states_correlation", [Correlation("l_quantity", "l_extendedprice"), Correlation("gap", "l_tax", LATE)], "analyzer_correlation")
SQL["states_correlation"] += (f" UNION ALL SELECT 'Multicolumn' AS entity, 'gap,l_tax' AS instance, 'Correlation' AS name, "
                              f"round(CAST(corr(gap, l_tax) AS DOUBLE), {DIGITS}) AS value FROM {ITEMS} t WHERE {LATE}")


def grouped_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five grouping metrics of different columns and filters from one scan."""
    context = AnalysisRunner(spark).onData(items(spark, sf_dir)).addAnalyzers([g[0] for g in _GROUPED]).run()
    return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", DIGITS))


QUERIES["analysis_grouping_sets"] = grouped_sets
SQL["analysis_grouping_sets"] = SQL["states_frequency"]


def states_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all orders after each year's orders have been read alone, the last one through a run on saved states."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    store = StateStore(spark, FileSystemMetricsRepository.helper_metrics_file(spark, "states"))
    wanted = [Size(), Mean("o_totalprice"), StandardDeviation("o_totalprice", "o_orderstatus = 'F'"), Uniqueness(["o_custkey"]), Entropy("o_orderpriority")]
    context = AnalyzerContext()
    for year in [r[0] for r in orders.select("year").distinct().orderBy("year").collect()]:
        context = AnalysisRunner(spark).onData(orders.where(F.col("year") == year)).addAnalyzers(wanted).withStates(store, str(year)).run()
    return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", 4))


QUERIES["states_by_year"] = states_by_year
_BY = "(SELECT {c}, count(*) AS n FROM orders GROUP BY {c})"
SQL["states_by_year"] = " UNION ALL ".join(f"SELECT '{e}' AS entity, '{i}' AS instance, '{n}' AS name, round(CAST({v} AS DOUBLE), 4) AS value FROM {t}" for e, i, n, v, t in (
    ("Dataset", "*", "Size", "count(*)", "orders"), (*column("o_totalprice", "Mean", "avg(o_totalprice)"), "orders"),
    (*column("o_totalprice", "StandardDeviation", "stddev_pop(o_totalprice)"), "orders WHERE o_orderstatus = 'F'"),
    (*column("o_custkey", "Uniqueness", f"{ONCE} * 1.0 / sum(n)"), _BY.format(c="o_custkey")),
    (*column("o_orderpriority", "Entropy", "ln(sum(n)) - sum(n * ln(n)) / sum(n)"), _BY.format(c="o_orderpriority"))))


def kll_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and buckets from merged sketches: the exact value, and by how much of all rows the sketch is off, in steps of two per cent."""
    df, asked = items(spark, sf_dir), [ApproxQuantile("l_extendedprice", 0.5), KLLSketch("l_extendedprice", KLLParameters(4096, 0.64, 4))]
    merged = States.merge([States.of(df.where(F.col("l_returnflag") == f), asked) for f in STATE_PARTS])
    median, kll = (o.value for o in merged.outcomes(asked).values())
    cuts = [("median", median, 0.5)] + [(f"bucket {i}", b.highValue, sum(x.count for x in kll.buckets[:i + 1])) for i, b in enumerate(kll.buckets[:-1])]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("l_extendedprice") <= v if k == "median" else F.col("l_extendedprice") < v, 1)).alias(k)
                                                 for k, v, _ in cuts]).first()
    return spark.createDataFrame([(k, int(abs(one[k] / one["n"] - (x if k == "median" else x / one["n"])) // 0.02)) for k, _, x in cuts], "cut string, off long")


QUERIES["states_kll_within_bound"] = kll_states
SQL["states_kll_within_bound"] = " UNION ALL ".join(
    f"SELECT '{k}' AS cut, CAST(0 AS BIGINT) AS off FROM (SELECT count(*) AS n FROM lineitem) x" for k in ("median", "bucket 0", "bucket 1", "bucket 2"))


# -- quantiles without error ---------------------------------------------------------

metrics("analyzer_quantile_selection", [ApproxQuantiles("l_extendedprice", [0.0, 0.01, 0.5, 0.999, 1.0], 0.0), ApproxQuantile("gap", 0.5, 0.0, LATE)],
        *[column("l_extendedprice", f"ApproxQuantiles-{q}", f"quantile_disc(l_extendedprice, {q})") for q in (0.01, 0.5, 0.999)],
        column("l_extendedprice", "ApproxQuantiles-0.0", "min(l_extendedprice)"), column("l_extendedprice", "ApproxQuantiles-1.0", "max(l_extendedprice)"))
SQL["analyzer_quantile_selection"] += (f" UNION ALL SELECT 'Column' AS entity, 'gap' AS instance, 'ApproxQuantile-0.5' AS name, "
                                       f"round(CAST(quantile_disc(gap, 0.5) AS DOUBLE), {DIGITS}) AS value FROM {ITEMS} t WHERE {LATE}")


# -- anomalies of many series --------------------------------------------------------

BY_MONTH = ("(SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)")


def series(name: str, strategy: Any, normal: str | None) -> None:
    """Each month's orders of each priority after the months before, all in one job; normal: SQL of the verdict over the windows w."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
            F.count(F.lit(1)).cast("double").alias("value"))
        return judge_series(months, strategy, ["series"], "value", "month").select("series", "month", "value", "normal")

    QUERIES[f"series_{name}"] = run
    if normal:
        over = "OVER (PARTITION BY series ORDER BY month"
        SQL[f"series_{name}"] = f"""SELECT series, month, v AS value, {normal} AS normal FROM (
SELECT series, month, v, lag(v, 1) {over}) AS p, lag(v, 2) {over}) AS p2,
avg(v) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, stddev_samp(v) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
avg(v) {over} ROWS UNBOUNDED PRECEDING) AS mi, stddev_pop(v) {over} ROWS UNBOUNDED PRECEDING) AS si FROM {BY_MONTH} x) w"""


series("simple_threshold", SimpleThresholdStrategy(10, 1e9), "v BETWEEN 10 AND 1e9")
series("absolute_change", AbsoluteChangeStrategy(-8.0, 8.0), "p IS NULL OR v - p BETWEEN -8 AND 8")
series("absolute_change_second_order", AbsoluteChangeStrategy(-12.0, 12.0, 2), "p2 IS NULL OR v - 2 * p + p2 BETWEEN -12 AND 12")
series("relative_rate_of_change", RelativeRateOfChangeStrategy(0.9, 1.1), "p IS NULL OR v / p BETWEEN 0.9 AND 1.1")
series("batch_normal", BatchNormalStrategy(1.0, 1.0), "m IS NULL OR v BETWEEN m - coalesce(s, 0) AND m + coalesce(s, 0)")
series("online_normal", OnlineNormalStrategy(1.0, 1.0, 0.0, False), "v BETWEEN mi - si AND mi + si")
series("online_normal_without_anomalies", OnlineNormalStrategy(2.0, 2.0), None)
series("holt_winters_fixed_weights", HoltWinters(MetricInterval.Monthly, SeriesSeasonality.Yearly, (0.3, 0.1, 0.2)), None)  # its SQL follows
#: The recurrence step by step; the season's values are a list whose first is the next one's, and which a step turns by one.
_A, _B, _C = 0.3, 0.1, 0.2
SQL["series_holt_winters_fixed_weights"] = f"""WITH RECURSIVE x AS {BY_MONTH},
s AS (SELECT series, month, v, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS t FROM x),
i AS (SELECT series, avg(v) FILTER (WHERE t < 12) AS level, (avg(v) FILTER (WHERE t >= 12 AND t < 24) - avg(v) FILTER (WHERE t < 12)) / 12 AS trend FROM s GROUP BY series),
r AS (SELECT i.series, CAST(-1 AS BIGINT) AS t, level, trend, CAST(0 AS DOUBLE) AS e,
(SELECT list(s.v - i.level ORDER BY s.t) FROM s WHERE s.series = i.series AND s.t < 12) AS season FROM i
UNION ALL
SELECT q.series, q.t, q.now, {_B} * (q.now - q.level) + {1 - _B} * q.trend, q.v - (q.level + q.trend + q.own), list_concat(q.season[2:12], [{_C} * (q.v - q.now) + {1 - _C} * q.own])
FROM (SELECT r.series, s.t, s.v, r.level, r.trend, r.season, r.season[1] AS own, {_A} * (s.v - r.season[1]) + {1 - _A} * (r.level + r.trend) AS now
FROM r JOIN s ON s.series = r.series AND s.t = r.t + 1) q)
SELECT s.series, s.month, s.v AS value, CASE WHEN s.t < 24 THEN NULL ELSE abs(e) <= greatest(1.96 * sd, 1e-9) END AS normal
FROM s JOIN (SELECT series, t, e, stddev_pop(e) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd FROM r WHERE t >= 0) w
ON w.series = s.series AND w.t = s.t"""


# -- repositories: typed values, binnings by Python functions -----------------------------

def reused_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram and quantiles that a second run takes from files; its own data is empty."""
    df, repo = items(spark, sf_dir), FileSystemMetricsRepository(spark)
    wanted = [Histogram("gap"), ApproxQuantiles("l_quantity", [0.5], 0.0)]
    AnalysisRunner(spark).onData(df).addAnalyzers(wanted).useRepository(repo).saveOrAppendResult(ResultKey(1)).run()
    again = FileSystemMetricsRepository(spark, repo.path)
    context = AnalysisRunner(spark).onData(df.where("false")).addAnalyzers(wanted).useRepository(again).reuseExistingResultsForKey(ResultKey(1)).run()
    return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", DIGITS))


QUERIES["repository_reused_values"] = reused_values
SQL["repository_reused_values"] = (SQL["analyzer_histogram"] + f" UNION ALL SELECT 'Column' AS entity, 'l_quantity' AS instance, 'ApproxQuantiles-0.5' AS name, "
                                   f"round(CAST(quantile_disc(l_quantity, 0.5) AS DOUBLE), {DIGITS}) AS value FROM lineitem")


def width(step: int) -> Any:
    """A binning by a Python function."""

    @F.pandas_udf("long")
    def binned(x: pd.Series) -> pd.Series:
        return (x // step).astype("int64")

    return binned


def two_function_binnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two binnings by one Python function with different widths, saved twice and read back by label."""
    repo = InMemoryMetricsRepository(spark)
    made = [Histogram("l_quantity", width(w), binningLabel=f"width {w}") for w in (10, 25)]
    for _ in range(2):
        AnalysisRunner(spark).onData(items(spark, sf_dir)).addAnalyzers(made).useRepository(repo).saveOrAppendResult(ResultKey(1)).run()
    asked = [Histogram("l_quantity", width(w), binningLabel=f"width {w}") for w in (10, 25)]
    rows = [(w, m["name"], round(float(m["value"]), DIGITS)) for w, a in zip((10, 25), asked, strict=True)
            for m in repo.load().forAnalyzers([a]).getSuccessMetricsAsJson() if not m["name"].startswith("Histogram.ratio")]
    return spark.createDataFrame(rows, "width long, name string, value double")


QUERIES["repository_two_function_binnings"] = two_function_binnings
SQL["repository_two_function_binnings"] = " UNION ALL ".join(
    f"SELECT CAST({w} AS BIGINT) AS width, 'Histogram.bins' AS name, CAST(count(DISTINCT floor(l_quantity / {w})) AS DOUBLE) AS value FROM lineitem UNION ALL "
    f"SELECT CAST({w} AS BIGINT) AS width, 'Histogram.abs.' || CAST(CAST(floor(l_quantity / {w}) AS BIGINT) AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 2"
    for w in (10, 25))


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and deviations of each status, saved one by one, compacted, and read as a table that has not passed through the driver."""
    orders, repo = table(spark, sf_dir, "orders"), FileSystemMetricsRepository(spark)
    for i, status in enumerate(("F", "O", "P")):
        (AnalysisRunner(spark).onData(orders.where(F.col("o_orderstatus") == status)).addAnalyzer(Size()).addAnalyzer(Maximum("o_totalprice")).useRepository(repo)
         .saveOrAppendResult(ResultKey(1000 + i, {"status": status})).run())
    repo.compact()
    return metrics_table(FileSystemMetricsRepository(spark, repo.path)).select("dataset_date", F.col("tags")["status"].alias("status"), "name", F.round("value", 2).alias("value"))


QUERIES["repository_history_table"] = history_table
SQL["repository_history_table"] = " UNION ALL ".join(
    f"SELECT CAST({1000 + i} AS BIGINT) AS dataset_date, '{s}' AS status, '{n}' AS name, round(CAST({v} AS DOUBLE), 2) AS value FROM orders WHERE o_orderstatus = '{s}'"
    for i, s in enumerate("FOP") for n, v in (("Size", "count(*)"), ("Maximum", "max(o_totalprice)")))


def one_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of one name judge rows together."""
    df = items(spark, sf_dir)
    a, b = Check(spark, CheckLevel.Error, "same").isUnique("l_partkey"), Check(spark, CheckLevel.Warning, "same").isComplete("gap")
    result = VerificationSuite(spark).onData(df).addCheck(a).addCheck(b).run()
    return VerificationResult.rowLevelResultsAsDataFrame(spark, result, df).select("l_orderkey", "l_linenumber", "same")


QUERIES["rowlevel_checks_of_one_name"] = one_name
SQL["rowlevel_checks_of_one_name"] = f"SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) = 1 AND gap IS NOT NULL AS same FROM {ITEMS} t"


def kll_without_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of a column with NaN, which no bucket holds."""
    df = items(spark, sf_dir).select(F.when(F.col("l_linenumber") == 1, math.nan).otherwise(F.col("l_quantity")).alias("x"))
    got = AnalysisRunner(spark).onData(df).addAnalyzer(KLLSketch("x", KLLParameters(2048, 0.64, 4))).run().outcomes
    return spark.createDataFrame([(i, b.lowValue, b.count) for i, b in enumerate(next(iter(got.values())).value.buckets)], "bucket long, low double, n long")


QUERIES["analyzer_kll_without_nan"] = kll_without_nan
_SOME = "(SELECT l_quantity AS x FROM lineitem WHERE l_linenumber <> 1)"
SQL["analyzer_kll_without_nan"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS bucket, CAST(min(x) + {i} * (max(x) - min(x)) / 4 AS DOUBLE) AS low, "
    f"(SELECT count(*) FROM {_SOME} y, (SELECT min(x) AS a, (max(x) - min(x)) / 4.0 AS w FROM {_SOME} q) m WHERE least(floor((x - a) / w), 3) = {i}) AS n FROM {_SOME} z"
    for i in range(4))


# -- inputs of other kinds, and the faces of the library ---------------------------------

def shared(spark: SparkSession, name: str) -> str:
    return FileSystemMetricsRepository.helper_metrics_file(spark, name)


_FACTS = [Size(), Completeness("gap"), Mean("l_quantity"), Uniqueness(["l_orderkey", "l_linenumber"])]
_FACTS_SQL = " UNION ALL ".join(f"SELECT '{e}' AS entity, '{i}' AS instance, '{n}' AS name, round(CAST({v} AS DOUBLE), {DIGITS}) AS value FROM {t}" for e, i, n, v, t in (
    ("Dataset", "*", "Size", "count(*)", f"{ITEMS} t"), (*column("gap", "Completeness", "count(gap) * 1.0 / count(*)"), f"{ITEMS} t"),
    (*column("l_quantity", "Mean", "avg(l_quantity)"), f"{ITEMS} t"),
    ("Multicolumn", "l_orderkey,l_linenumber", "Uniqueness", f"{ONCE} * 1.0 / sum(n)", f"(SELECT count(*) AS n FROM {ITEMS} t GROUP BY l_orderkey, l_linenumber) g")))
_FACT_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "gap"]


def facts(spark: SparkSession, data: Any) -> DataFrame:
    context = AnalysisRunner(spark).onData(data).addAnalyzers(_FACTS).run()
    return AnalyzerContext.successMetricsAsDataFrame(spark, context).withColumn("value", F.round("value", DIGITS))


def from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as CSV with a header and read back with inferred types; an empty field is null."""
    path = shared(spark, "items.csv")
    items(spark, sf_dir).select(*_FACT_COLUMNS).write.option("header", True).csv(path)
    return facts(spark, spark.read.csv(path, header=True, inferSchema=True))


def from_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the name of a view in the catalog."""
    items(spark, sf_dir).select(*_FACT_COLUMNS).createOrReplaceTempView("plumbline_items")
    return facts(spark, spark.table("plumbline_items"))


def from_pandas_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a pandas table, and metrics as one."""
    few = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").toPandas()
    got = AnalyzerContext.successMetricsAsDataFrame(spark, AnalysisRunner(spark).onData(few).addAnalyzers([Size(), Mean("n_regionkey"), MaxLength("n_name")]).run(), pandas=True)
    return spark.createDataFrame(got)


def from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics exported as JSON, as rows."""
    context = AnalysisRunner(spark).onData(items(spark, sf_dir)).addAnalyzers(_FACTS).run()
    rows = [(m["entity"], m["instance"], m["name"], round(m["value"], DIGITS)) for m in AnalyzerContext.successMetricsAsJson(spark, context)]
    return spark.createDataFrame(rows, "entity string, instance string, name string, value double")


def by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's own runner, checks and profiler; two constraints added together."""
    session, df = QualitySession(spark), items(spark, sf_dir)
    check = session.createCheck(CheckLevel.Warning, "session")
    check = check.addConstraints([check.isComplete("gap"), check.hasSize(lambda n: n > 0)])
    result = VerificationSuite(spark).onData(df).addCheck(check).run()
    checked = [(r["constraint_status"], 1.0) for r in VerificationResult.checkResultsAsJson(spark, result)]
    size = AnalyzerContext.successMetricsAsJson(spark, session.createAnalysisRunner(df).addAnalyzer(Size()).run())[0]
    repo = InMemoryMetricsRepository(spark)
    profiles_ = (session.createColumnProfileRunner(df).restrictToColumns(["gap"]).useRepository(repo).saveOrAppendResult(ResultKey(3)).run())
    kept = [m for m in repo.load().getSuccessMetricsAsJson() if m["name"] == "Completeness"]
    rows = [*checked, ("Size", size["value"]), ("Records", float(profiles_.numRecords)), ("Kept", round(kept[0]["value"], DIGITS)),
            (str(profiles_.profiles["gap"]).split(":")[0], 1.0)]
    return spark.createDataFrame(rows, "what string, value double")


for _name, _query in (("source_csv", from_csv), ("source_catalog_table", from_catalog), ("sink_json", from_json)):
    QUERIES[_name] = _query
    SQL[_name] = _FACTS_SQL
QUERIES["source_pandas"] = from_pandas_table
SQL["source_pandas"] = " UNION ALL ".join(f"SELECT '{e}' AS entity, '{i}' AS instance, '{n}' AS name, CAST({v} AS DOUBLE) AS value FROM nation" for e, i, n, v in (
    ("Dataset", "*", "Size", "count(*)"), column("n_regionkey", "Mean", "avg(n_regionkey)"), column("n_name", "MaxLength", "max(length(n_name))")))
QUERIES["session_facade"] = by_session
SQL["session_facade"] = (f"WITH m AS (SELECT count(*) AS n, count(gap) AS filled FROM {ITEMS} t) "
                         "SELECT CASE WHEN filled = n THEN 'Success' ELSE 'Failure' END AS what, CAST(1 AS DOUBLE) AS value FROM m "
                         "UNION ALL SELECT CASE WHEN n > 0 THEN 'Success' ELSE 'Failure' END, 1 FROM m UNION ALL SELECT 'Size', n FROM m UNION ALL SELECT 'Records', n FROM m "
                         f"UNION ALL SELECT 'Kept', round(filled * 1.0 / n, {DIGITS}) FROM m UNION ALL SELECT 'NumericProfiles for column', 1 FROM m")
