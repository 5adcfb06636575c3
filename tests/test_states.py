"""States of parts against metrics of the whole."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline import (
    AnalysisRunner,
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
from plumbline.plans.planner import all_frequency_stats, compute
from plumbline.plans.states import States, StateStore

FORM = "day long, x double, y long, word string, none double"
EXACT = [Size(), Size("y > 2"), Completeness("x"), Completeness("x", "y > 2"), Compliance("small", "x < 3"), PatternMatch("word", "^a"), Minimum("x"), Maximum("x", "y > 1"),
         Mean("x"), Sum("x"), Mean("x", "y < 4"), StandardDeviation("x"), StandardDeviation("x", "y > 2"), MinLength("word"), MaxLength("word"), Correlation("x", "y"),
         Correlation("x", "y", "y > 1"), DataType("word"), Mean("none"), Correlation("none", "x"), Minimum("word"), Mean("missing"), Completeness("x", "broken ("),
         CountDistinct(["word", "y"]), Distinctness("word"), Distinctness(["x", "y"], "y > 2"), Uniqueness(["x"]), Uniqueness(["x", "word"], "y > 1"), UniqueValueRatio(["word"]),
         Entropy("word"), Entropy("none"), MutualInformation(["word", "y"]), MutualInformation(["word", "y"], "x > 1"), Histogram("word"), Histogram("word", maxDetailBins=2),
         Histogram("x", lambda c: F.floor(c / 2)), Histogram("y", where="x > 2")]


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for i in range(240):
        made.append((i % 4, None if i % 7 == 0 else (i * 37 % 101) / 10, None if i % 11 == 0 else i % 6, None if i % 5 == 0 else ["a", "ab", "12", "true", ""][i * i % 5], None))
    return spark.createDataFrame(made, FORM)


def same(got, want):
    assert got.ok == want.ok, (got, want)
    if not got.ok:
        assert got.error == want.error
    elif isinstance(want.value, float):
        assert math.isclose(got.value, want.value, rel_tol=1e-12, abs_tol=1e-12) or math.isnan(got.value) and math.isnan(want.value)
    else:
        assert got.value == want.value


def test_states_of_parts_equal_the_whole(spark, rows):
    want = compute(rows, EXACT)
    parts = [States.of(rows.where(F.col("day") == d), EXACT) for d in range(4)] + [States.of(rows.where("false"), EXACT)]
    for merged in (States.merge(parts), States.merge([States.merge(parts[:2]), States.merge(parts[2:])])):
        got = merged.outcomes(EXACT)
        for a in EXACT:
            same(got[a], want[a])


def test_sketch_states(spark):
    df = spark.range(20_000).select((F.col("id") % 4).alias("day"), F.when(F.col("id") == 11, math.nan).when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("x"), F.lit(math.nan).alias("z"))
    wanted = [KLLSketch("x", KLLParameters(2048, 0.64, 10)), ApproxQuantile("x", 0.5), ApproxQuantiles("x", [0.1, 0.9]), ApproxCountDistinct("x"), KLLSketch("z")]
    got = States.merge([States.of(df.where(F.col("day") == d), wanted) for d in range(4)]).outcomes(wanted)
    kll, median, two, distinct, empty = (got[a] for a in wanted)
    exact = sorted(r[0] for r in df.where("x is not null and not isnan(x)").select("x").collect())
    bound = 0.02 * len(exact)
    rank = lambda v: sum(x <= v for x in exact)
    assert abs(rank(median.value) - 0.5 * len(exact)) < bound and all(abs(rank(v) - q * len(exact)) < bound for q, v in two.value.items())
    assert sum(b.count for b in kll.value.buckets) == len(exact) and all(abs(b.count - len(exact) / 10) < bound for b in kll.value.buckets)
    assert kll.value.buckets[0].lowValue == exact[0] and kll.value.buckets[-1].highValue == exact[-1]
    assert abs(distinct.value - len(exact)) < 0.05 * len(exact) and not empty.ok


def test_a_new_day_reads_that_day_only(spark, rows, tmp_path):
    store = StateStore(spark, str(tmp_path / "states"))
    wanted = [Size(), Mean("x"), Correlation("x", "y"), Uniqueness(["word", "y"]), Histogram("word"), Entropy("word", "y > 1")]
    for d in range(4):
        rows.where(F.col("day") == d).write.parquet(str(tmp_path / f"day{d}"))
    for d in range(3):
        AnalysisRunner(spark).onData(spark.read.parquet(str(tmp_path / f"day{d}"))).addAnalyzers(wanted).withStates(store, f"day/{d}").run()
    for d in range(3):
        (tmp_path / f"day{d}").rename(tmp_path / f"gone{d}")  # the days before are not there to be read
    last = spark.read.parquet(str(tmp_path / "day3"))
    got = AnalysisRunner(spark).onData(last).addAnalyzers(wanted).withStates(store, "day/3").run().outcomes
    again = AnalysisRunner(spark).onData(last).addAnalyzers(wanted).withStates(store, "day/3").run().outcomes
    want = compute(rows, wanted)
    for a in wanted:
        same(got[a], want[a])
        same(again[a], want[a])
    assert sorted(store.parts()) == [f"day/{d}" for d in range(4)]
    merged = store.merged(["day/0", "day/1"], wanted)
    assert all("states" in f for t in [merged.scans, *merged.tables.values()] for f in t.inputFiles())
    some = AnalysisRunner.onStates(merged, wanted).outcomes
    for a in wanted:
        same(some[a], compute(rows.where("day < 2"), wanted)[a])
    with pytest.raises(ValueError):
        store.merged(["none"], wanted)


def test_all_grouping_sets_in_one_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    keys = [(("word",), None), (("x", "y"), None), (("word", "y"), "x > 2"), (("none",), None)]
    plan = all_frequency_stats(df, keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand") == 1 and "partial_count" in plan
    wanted = [Uniqueness(["word"]), Entropy("word"), Distinctness(["x", "y"]), CountDistinct(["word", "y"]), Uniqueness(["word", "y"], "x > 2"), Entropy("none"),
              UniqueValueRatio(["y", "word"]), Uniqueness(["y"], "1 / (y - y) > 0")]
    together = compute(df, wanted)
    for a in wanted:
        same(together[a], compute(df, [a])[a])
    assert together[wanted[0]].ok and not together[wanted[5]].ok and not together[wanted[7]].ok
    many = [Distinctness(["x", "y", "word"], f"y > {i}") for i in range(25)]
    assert [o.value for o in compute(df, many).values()] == [compute(df, [a])[a].value for a in many]
