import math

import pandas as pd
import pytest

from plumbline import (
    AnalysisRunner,
    AnalyzerContext,
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    Correlation,
    CountDistinct,
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
)
from plumbline.plans.planner import fused
from plumbline.sources.pandas_io import from_pandas


@pytest.fixture(scope="module")
def df(spark):
    # Rows whose metrics are known.
    return spark.createDataFrame([("foo", 1, 5, 1), ("bar", 2, 6, 3), ("baz", 3, None, 1)], "a string, b long, c long, d long")


def values(df, *analyzers):
    spark = df.sparkSession
    context = AnalysisRunner(spark).onData(df).addAnalyzers(analyzers).run()
    got = [r["value"] for r in AnalyzerContext.successMetricsAsDataFrame(spark, context).collect()]
    assert got == [r["value"] for r in AnalyzerContext.successMetricsAsJson(spark, context)]
    return got


# The metrics of the rows above.
@pytest.mark.parametrize(("analyzer", "expected"), [
    (Size(), [3.0]), (Size("b > 1"), [2.0]), (Completeness("b"), [1.0]), (Completeness("c"), [2 / 3]), (Completeness("c", "b > 2"), [0.0]),
    (Compliance("top b", "b >= 2"), [2 / 3]), (Compliance("c", "c >= 2"), [2 / 3]), (Compliance("x", "b >=2 AND d >= 2"), [1 / 3]),
    (Compliance("find a", 'a = "foo"'), [1 / 3]), (PatternMatch("a", "ba(r|z)"), [2 / 3]), (Minimum("b"), [1.0]), (Minimum("c"), [5.0]),
    (Maximum("b"), [3.0]), (Mean("b"), [2.0]), (Mean("c"), [5.5]), (Sum("b"), [6.0]), (Sum("c"), [11.0]),
    (StandardDeviation("b"), [0.816496580927726]), (StandardDeviation("c"), [0.5]), (MinLength("a"), [3.0]), (MaxLength("a"), [3.0]),
    (Correlation("b", "c"), [1.0]), (Correlation("b", "d"), [0.0]), (Correlation("b", "a"), []), (ApproxCountDistinct("b"), [3.0]),
    (ApproxCountDistinct("c"), [2.0]), (ApproxQuantile("b", 0.5), [2.0]), (ApproxQuantile("c", 0.5), [5.0]), (ApproxQuantile("b", 0.25), [1.0]),
    (ApproxQuantiles("b", [0.25, 0.5, 0.75]), [1.0, 2.0, 3.0]), (ApproxQuantiles("c", [0.25, 0.5, 0.75]), [5.0, 5.0, 6.0]),
    (DataType("b"), [5, 0, 0, 0, 0, 3, 1, 0, 0, 0, 0]), (DataType("c"), [5, 0, 0, 0, 0, 2, 2 / 3, 1, 1 / 3, 0, 0]),
    (CountDistinct("b"), [3.0]), (CountDistinct(["b", "c"]), [3.0]), (Distinctness("c"), [1.0]), (Distinctness(["d"]), [2 / 3]),
    (Uniqueness(["d", "d"]), [1 / 3]), (Uniqueness(["a"]), [1.0]), (UniqueValueRatio(["d"]), [0.5]), (Entropy("b"), [math.log(3)]),
    (Entropy("c"), [math.log(2)]), (MutualInformation(["b", "c"]), [2 / 3 * math.log(3)]), (MutualInformation(["b", "d"]), [0.6365141682948128]),
    (Histogram("c"), [3, 1, 1 / 3, 1, 1 / 3, 1, 1 / 3]), (Histogram("b", maxDetailBins=2), [3, 1, 1 / 3, 1, 1 / 3]),
    (Mean("a"), []), (MinLength("b"), []), (Mean("nope"), []), (Compliance("bad", "nope > 1"), []),
])
def test_golden(df, analyzer, expected):
    assert values(df, analyzer) == pytest.approx(expected, rel=1e-12)


def test_failures_do_not_spread(df):
    assert values(df, Mean("a"), Size(), Correlation("b", "a"), Compliance("bad", "this is not sql"), Sum("b")) == [3.0, 6.0]


def test_runtime_failure_is_one_metric(spark, df):
    got = values(df, Size(), Compliance("cast", "CAST(a AS INT) > 0"), Sum("b"))
    assert got == [3.0, 6.0]


def test_missing_column_message(df):
    from plumbline.plans.planner import compute

    assert compute(df, [Completeness("nope")])[Completeness("nope")].error == "Input data does not include column nope!"


def test_kll(df):
    from plumbline.plans.planner import compute

    a = KLLSketch("b", KLLParameters(2, 0.64, 2))
    got = compute(df, [a])[a].value
    assert [(b.lowValue, b.highValue, b.count) for b in got.buckets] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]
    assert got.argmax == 1 and got.parameters == [0.64, 2.0] and {1.0, 2.0, 3.0} <= set(got.computePercentiles())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b long")
    assert values(empty, Size(), Completeness("a"), Mean("b"), Entropy("a"), Histogram("a"), DataType("b"), KLLSketch("b"), Uniqueness(["a"])) == [0.0]


def test_one_scan(df):
    plan = fused(df, [Size(), Completeness("c"), Mean("b"), StandardDeviation("b")])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_shared_filter_reaches_the_files(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = fused(lineitem, [Size("l_quantity > 10"), Mean("l_tax", "l_quantity > 10")])._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_binning(df):
    assert values(df, Histogram("b", lambda c: c > 1)) == pytest.approx([2, 2, 2 / 3, 1, 1 / 3])


def test_odd_column_names(spark):
    odd = spark.createDataFrame([(1, "x"), (None, "y")], "`a.b` long, `c d` string")
    assert values(odd, Completeness("a.b"), Mean("a.b"), Uniqueness(["c d", "a.b"]), Histogram("a.b")) == [0.5, 1.0, 1.0, 2.0, 1.0, 0.5, 1.0, 0.5]


def test_pandas_parity(spark):
    table = pd.DataFrame({"strings": ["foo", "bar"], "ints": [1, 2], "bools": [True, False], "floats": [1.0, 2.0], "nans": [float("nan")] * 2})
    with pytest.warns(UserWarning, match="converted"):
        run = AnalysisRunner(spark).onData(table)
    assert run.df.dtypes == [("strings", "string"), ("ints", "bigint"), ("bools", "boolean"), ("floats", "double"), ("nans", "double")]
    assert values(from_pandas(spark, table), *[Completeness(c) for c in table]) == [1.0] * 5


def test_type_errors(spark):
    for bad in (lambda: AnalysisRunner("x"), lambda: AnalysisRunner(spark).onData("x")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(NotImplementedError):
        PatternMatch("a", "b", "group")
