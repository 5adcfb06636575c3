"""Series of histories, appended and typed histories, running metrics of a stream, and mended identities."""

import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import (
    AbsoluteChangeStrategy,
    AnalysisRunner,
    ApproxQuantiles,
    BatchNormalStrategy,
    Check,
    CheckLevel,
    Completeness,
    Correlation,
    DataType,
    Entropy,
    FileSystemMetricsRepository,
    Histogram,
    HoltWinters,
    InMemoryMetricsRepository,
    KLLParameters,
    KLLSketch,
    Maximum,
    Mean,
    OnlineNormalStrategy,
    RelativeRateOfChangeStrategy,
    ResultKey,
    SimpleThresholdStrategy,
    Size,
    Uniqueness,
    VerificationResult,
    VerificationSuite,
)
from plumbline.operators.series import judge_series
from plumbline.plans.planner import compute
from plumbline.plans.states import States, StateStore
from plumbline.sources.pandas_io import from_pandas
from plumbline.sources.repository import metrics_table
from plumbline.streaming.monitor import running_metrics


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", t, None if t == 7 and k == 1 else float(rng.choice([0.0, 1.0, 5.0, 20.0]) if k < 3 else 10 + t % 7 + rng.normal() * 0.1 + 9 * (t == 30)))
            for k in range(5) for t in range(40 if k != 4 else 3)]
    return spark.createDataFrame(rows, "series string, dataset_date long, value double").repartition(5)


@pytest.mark.parametrize("strategy", [
    SimpleThresholdStrategy(1.0, 10.0), SimpleThresholdStrategy(None, 5.0), AbsoluteChangeStrategy(-4.0, 4.0), AbsoluteChangeStrategy(-4.0, None, 3),
    AbsoluteChangeStrategy(0.0, 6.0, 0), RelativeRateOfChangeStrategy(0.5, 4.0), RelativeRateOfChangeStrategy(None, 1.0, 2), BatchNormalStrategy(1.0, 1.0),
    BatchNormalStrategy(0.5, None, True), OnlineNormalStrategy(1.0, 1.0, 0.0, False), OnlineNormalStrategy(1.0, 2.0), HoltWinters(weights=(0.4, 0.1, 0.3))])
def test_series_are_judged_as_their_values_one_by_one(history, strategy):
    got = {}
    for r in judge_series(history, strategy, ["series"]).collect():
        got.setdefault(r["series"], []).append((r["dataset_date"], r["value"], r["normal"]))
    for rows in got.values():
        rows.sort()
        values = [v for _, v, _ in rows]
        for i, (_, v, normal) in enumerate(rows):
            want = None if strategy.problem(values[:i]) is not None else bool(strategy.is_normal(values[:i], v))
            assert normal == want
    assert len(got) == 5 and len(got["s1"]) == 39
    with pytest.raises(ValueError):
        judge_series(history.withColumn("normal", F.lit(1)), strategy, ["series"])


def test_writers_at_once_keep_each_others_rows(spark, tmp_path):
    path, df = str(tmp_path / "deep" / "metrics"), spark.range(5)
    repos = [FileSystemMetricsRepository(spark, path) for _ in range(2)]

    def write(k):
        for i in range(4):
            AnalysisRunner(spark).onData(df).addAnalyzer(Size()).useRepository(repos[k]).saveOrAppendResult(ResultKey(10 * k + i, {"writer": str(k)})).run()
            repos[k].compact()

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = FileSystemMetricsRepository(spark, path).load().getSuccessMetricsAsJson()
    assert sorted(m["dataset_date"] for m in found) == [0, 1, 2, 3, 10, 11, 12, 13]
    repos[0].compact()
    assert len(repos[0]._saves()) == 1 and metrics_table(repos[1]).count() == 8 and metrics_table(InMemoryMetricsRepository(spark)).count() == 0


def test_a_new_save_replaces_all_of_an_analyzer(spark, tmp_path):
    for repo in (InMemoryMetricsRepository(spark), FileSystemMetricsRepository(spark, str(tmp_path / "m"))):
        for values in (["a", "b"], ["c"]):
            df = spark.createDataFrame([(v,) for v in values], "v string")
            AnalysisRunner(spark).onData(df).addAnalyzer(Histogram("v")).addAnalyzer(Size()).useRepository(repo).saveOrAppendResult(ResultKey(1)).run()
        assert {m["name"] for m in repo.load().getSuccessMetricsAsJson()} == {"Histogram.bins", "Histogram.abs.c", "Histogram.ratio.c", "Size"}


def test_an_old_file_is_read_and_added_to(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text('{"dataset_date": 5, "tags": [["k", "v"]], "analyzer": "Size(where=None)", "entity": "Dataset", "instance": "*", "name": "Size", "value": 3.0}\n')
    repo = FileSystemMetricsRepository(spark, str(path))
    AnalysisRunner(spark).onData(spark.range(2)).addAnalyzer(Size()).useRepository(repo).saveOrAppendResult(ResultKey(6)).run()
    assert [(m["dataset_date"], m["value"]) for m in FileSystemMetricsRepository(spark, str(path)).load().forAnalyzers([Size()]).getSuccessMetricsAsJson()] == [(5, 3.0), (6, 2.0)]


def test_values_of_every_kind_are_reused(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), str(i % 3)) for i in range(50)] + [(None, None), (math.nan, "x")], "x double, t string")
    wanted = [Histogram("t"), KLLSketch("x", KLLParameters(64, 0.64, 3)), ApproxQuantiles("x", [0.25, 0.5], 0.0), DataType("t"), Size(), Maximum("x")]
    repo = FileSystemMetricsRepository(spark, str(tmp_path / "m"))
    first = AnalysisRunner(spark).onData(df).addAnalyzers(wanted).useRepository(repo).saveOrAppendResult(ResultKey(1, {"a": "b"})).run().outcomes
    again = AnalysisRunner(spark).onData(spark.range(0)).addAnalyzers(wanted).useRepository(FileSystemMetricsRepository(spark, str(tmp_path / "m")))
    got = again.reuseExistingResultsForKey(ResultKey(1, {"a": "b"})).run().outcomes
    assert all(repr(got[a]) == repr(first[a]) for a in wanted)


def test_binnings_by_functions_need_labels(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "x long")

    def width(step):
        @F.pandas_udf("long")
        def binned(x: pd.Series) -> pd.Series:
            return x // step

        return binned

    with_label = [Histogram("x", width(w), binningLabel=f"w{w}") for w in (10, 25)]
    plain = Histogram("x", lambda c: F.floor(c / 10))
    around = width(7)
    bare = [Histogram("x", width(10)), Histogram("x", lambda c: around(c))]
    got = compute(df, [*with_label, plain, *bare])
    assert [got[a].value.numberOfBins for a in (*with_label, plain)] == [3, 2, 3]
    assert all(not got[a].ok and "binningLabel" in got[a].error for a in bare)
    assert with_label[0].key == Histogram("x", width(10), binningLabel="w10").key != with_label[1].key and plain.key == Histogram("x", lambda c: F.floor(c / 10)).key


def test_checks_of_one_name_and_names_of_columns(spark):
    df = spark.createDataFrame([(1, 2), (1, -1), (3, 4)], "x long, y long")
    result = (VerificationSuite(spark).onData(df).addCheck(Check(spark, CheckLevel.Error, "same").isUnique("x")).addCheck(Check(spark, CheckLevel.Error, "same").isNonNegative("y")).run())
    assert sorted((r["y"], r["same"]) for r in VerificationResult.rowLevelResultsAsDataFrame(spark, result, df).collect()) == [(-1, False), (2, False), (4, True)]
    clash = VerificationSuite(spark).onData(df).addCheck(Check(spark, CheckLevel.Error, "y").isUnique("x")).run()
    with pytest.raises(ValueError):
        VerificationResult.rowLevelResultsAsDataFrame(spark, clash, df)
    with pytest.raises(TypeError):
        VerificationSuite(spark).onData(df).addAnomalyCheck(SimpleThresholdStrategy(0, 1), ApproxQuantiles("x", [0.5]))


def test_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,), (None,)], "x double")
    kll = compute(df, [KLLSketch("x", KLLParameters(8, 0.64, 2))])[KLLSketch("x", KLLParameters(8, 0.64, 2))].value
    assert [(b.lowValue, b.highValue, b.count) for b in kll.buckets] == [(1.0, 2.0, 1), (2.0, 3.0, 1)]
    wanted = [Completeness("x"), Maximum("x"), Mean("x")]
    got = States.merge([States.of(df.limit(2), wanted), States.of(df.where("x = 3 or x is null"), wanted)]).outcomes(wanted)
    assert got[wanted[0]].value == 0.75 and math.isnan(got[wanted[1]].value) and math.isnan(got[wanted[2]].value)


def test_running_metrics_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), str(i % 4)) for i in range(60)], "i long, x double, t string")
    for b in range(3):
        df.where(F.col("i") % 3 == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wanted = [Size(), Mean("x"), Correlation("i", "x"), Uniqueness(["t"]), Entropy("t"), Histogram("t")]
    store, seen = StateStore(spark, str(tmp_path / "states")), {}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = running_metrics(stream, wanted, store, lambda n, c: seen.update({n: c}))
    query = writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert sorted(seen) == [0, 1, 2] and len(store.parts()) == 2
    want = compute(df, wanted)

    def same(context):
        for a in wanted:
            got = context.outcomes[a].value
            assert got == want[a].value or math.isclose(got, want[a].value, rel_tol=1e-12)

    same(seen[2])
    # The last batch again, as after a failure: totals stay.
    last = sorted(p for p in (tmp_path / "in").glob("*.parquet"))
    rows = [spark.read.parquet(str(p)) for p in last]
    before = store.load("1", wanted).outcomes([Size()])[Size()].value
    assert before == 40.0
    again = next(r for r in rows if States.merge([store.load("1", wanted), States.of(r, wanted)]).outcomes([Mean("x"), Correlation("i", "x")])[Correlation("i", "x")].value
                 == pytest.approx(want[wanted[2]].value))
    repeat = running_metrics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), wanted, store, lambda n, c: seen.update({n: c}))
    assert repeat is not None
    store.save("2", States.merge([store.load("1", wanted), States.of(again, wanted)]))
    same(AnalysisRunner.onStates(store.load("2", wanted), wanted))


def test_pandas_through_arrow(spark):
    n = 1_000_000
    x = np.arange(n, dtype=float)
    x[::10] = np.nan
    table = pd.DataFrame({"x": x, "i": np.arange(n, dtype="int32"), "b": np.arange(n) % 2 == 0, "t": ["a", None] * (n // 2), "d": np.datetime64("2024-01-02T03:04:05") + np.arange(n).astype("timedelta64[s]")})
    df = from_pandas(spark, table)
    assert dict(df.dtypes) == {"x": "double", "i": "int", "b": "boolean", "t": "string", "d": "timestamp_ntz"}
    got = df.agg(F.count("x"), F.count(F.when(F.isnan("x"), 1)), F.count("t"), F.sum("i"), F.min("d"), F.count(F.when(F.col("b"), 1))).first()
    assert tuple(got)[:4] == (n, n // 10, n // 2, n * (n - 1) // 2) and str(got[4]) == "2024-01-02 03:04:05" and got[5] == n // 2
    odd = from_pandas(spark, pd.DataFrame({"o": [[1, 2], None, {"a": 1}], "d": [pd.NaT, pd.Timestamp("2020-01-01"), pd.NaT], 3: [1, 2, 3]}))
    assert [tuple(r) for r in odd.select("o", F.col("3"), F.col("d").isNull()).collect()] == [("[1, 2]", 1, True), (None, 2, False), ("{'a': 1}", 3, True)]
