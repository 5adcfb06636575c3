import pytest

from plumbline import (
    DEFAULT,
    AbsoluteChangeStrategy,
    AnalysisRunner,
    BatchNormalStrategy,
    ColumnProfilerRunner,
    Completeness,
    ConstraintSuggestionRunner,
    FileSystemMetricsRepository,
    FractionalCategoricalRangeRule,
    HoltWinters,
    InMemoryMetricsRepository,
    KLLParameters,
    Mean,
    MetricInterval,
    OnlineNormalStrategy,
    RateOfChangeStrategy,
    RelativeRateOfChangeStrategy,
    ResultKey,
    SeriesSeasonality,
    SimpleThresholdStrategy,
    Size,
    UniqueIfApproximatelyUniqueRule,
    VerificationResult,
    VerificationSuite,
)
from plumbline.operators.profiles import StringColumnProfile
from plumbline.streaming import states
from plumbline.streaming.monitor import monitor


@pytest.mark.parametrize(("strategy", "history", "newest", "normal"), [
    (SimpleThresholdStrategy(1.0, 3.0), [], 3, True), (SimpleThresholdStrategy(None, 2.0), [9], 3, False), (AbsoluteChangeStrategy(-4.0), [5], 2, True),
    (AbsoluteChangeStrategy(-3.0), [5], 2, True), (AbsoluteChangeStrategy(1.0), [5], 2, False), (AbsoluteChangeStrategy(None, 2.0), [2], 5, False),
    (AbsoluteChangeStrategy(None, 5.0), [2], 5, True), (RelativeRateOfChangeStrategy(None, 2.5), [2], 5, True), (RelativeRateOfChangeStrategy(None, 2.0), [2], 5, False),
    (RelativeRateOfChangeStrategy(0.4), [5], 2, True), (RelativeRateOfChangeStrategy(0.8, 1.2), [20], 30, False), (OnlineNormalStrategy(1.5, 1.5, ignoreStartPercentage=0.0), [2], 5, True),
    (OnlineNormalStrategy(0.5, 0.5, 0.0), [1], 5, False), (OnlineNormalStrategy(0.5, 0.5, 0.0), [5], 1, False), (OnlineNormalStrategy(1.0, 1.0, 0.0), [3], 6, True),
    (BatchNormalStrategy(0.5, 0.5), [5, 2], 1, False), (BatchNormalStrategy(0.5, 0.5), [5, 2], 3.5, True), (HoltWinters(), [1] * 14, 1, True), (HoltWinters(), [2] * 14, 5, False),
    (HoltWinters(MetricInterval.Monthly, SeriesSeasonality.Yearly), [1] * 24, 1, True), (AbsoluteChangeStrategy(-1.0, 1.0), [], 100, True),
])
def test_strategies(strategy, history, newest, normal):
    assert strategy.is_normal([float(x) for x in history], float(newest)) is normal


def test_short_history_and_deprecation():
    assert HoltWinters().problem([1.0] * 13) and HoltWinters().problem([1.0] * 14) is None
    with pytest.raises(DeprecationWarning):
        RateOfChangeStrategy(1.0)


def test_anomaly_check(spark):
    repo = InMemoryMetricsRepository(spark)
    yesterday = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    today = yesterday.union(yesterday).union(yesterday.limit(1))
    for key, data, status in ((1, yesterday, "Success"), (2, today, "Warning")):
        result = (VerificationSuite(spark).onData(data).useRepository(repo).saveOrAppendResult(ResultKey(spark, key, {}))
                  .addAnomalyCheck(RelativeRateOfChangeStrategy(maxRateIncrease=2.0), Size()).run())
        assert result.status == status
    row = VerificationResult.checkResultsAsJson(spark, result)[0]
    assert row["constraint_message"] == "Value: 5.0 does not meet the constraint requirement!" and row["check_status"] == "Warning"
    assert VerificationResult.successMetricsAsJson(spark, result) == [{"entity": "Dataset", "instance": "*", "name": "Size", "value": 5.0}]
    history = repo.load().forAnalyzers([Size()]).getSuccessMetricsAsDataFrame().sort("dataset_date")
    assert [r["value"] for r in history.collect()] == [2.0, 5.0]


@pytest.mark.parametrize("kind", ["memory", "file", "remote"])
def test_repository(spark, tmp_path, kind):
    path = {"file": f"{tmp_path}/m.json", "remote": f"file://{tmp_path}/remote.json"}.get(kind)
    repo = InMemoryMetricsRepository(spark) if path is None else FileSystemMetricsRepository(spark, path)
    df = spark.createDataFrame([(19,), (21,), (None,)], "age long")
    for date, tag in ((10, "a"), (20, "b")):
        AnalysisRunner(spark).onData(df).addAnalyzer(Mean("age")).addAnalyzer(Completeness("age")).useRepository(repo).saveOrAppendResult(ResultKey(date, {"tag": tag})).run()
    AnalysisRunner(spark).onData(df).addAnalyzer(Size()).useRepository(repo).saveOrAppendResult(ResultKey(20, {"tag": "b"})).run()
    again = repo if path is None else FileSystemMetricsRepository(spark, path)
    assert len(again.load().getSuccessMetricsAsJson()) == 5
    assert {r["tag"] for r in again.load().before(10).getSuccessMetricsAsJson()} == {"a"}
    assert [r["name"] for r in again.load().after(11).withTagValues({"tag": "b"}).forAnalyzers([Size()]).getSuccessMetricsAsJson()] == ["Size"]
    assert "tag" in again.load().getSuccessMetricsAsDataFrame().columns
    with pytest.raises(AttributeError):
        again.before(10)
    with pytest.raises(ValueError):
        AnalysisRunner(spark).onData(df).saveOrAppendResult(ResultKey(1))


def test_reuse(spark):
    repo, key = InMemoryMetricsRepository(spark), ResultKey(5)
    two, three = spark.range(2), spark.range(3)
    run = lambda df, k: AnalysisRunner(spark).onData(df).addAnalyzer(Size()).useRepository(repo).saveOrAppendResult(k)
    run(two, key).run()
    assert run(three, ResultKey(6)).reuseExistingResultsForKey(key).run().outcomes[Size()].value == 2.0
    assert run(three, ResultKey(7)).reuseExistingResultsForKey(ResultKey(99)).run().outcomes[Size()].value == 3.0


def test_string_profile(spark):
    df = spark.createDataFrame([("ant", "dragonfly"), ("bee", "earwig"), ("bee", None), ("cricket", None)], "a string, b string")
    got = ColumnProfilerRunner(spark).onData(df).run()
    a, b = got.profiles["a"], got.profiles["b"]
    assert got.numRecords == 4 and isinstance(a, StringColumnProfile) and (a.minLength, a.maxLength) == (3, 7)
    assert str(a).startswith("StringProfiles for column: a:") and '"minLength": 3' in str(a) and not a.isDataTypeInferred
    assert {v.value: (v.count, v.ratio) for v in a.histogram} == {"ant": (1, 0.25), "bee": (2, 0.5), "cricket": (1, 0.25)}
    assert a.typeCounts["String"] == 4 and b.typeCounts["String"] == 2
    assert (b.completeness, b.approximateNumDistinctValues, b.minLength, b.maxLength) == (0.5, 2, 0, 9)


def test_numeric_profile(spark):
    df = spark.createDataFrame([("foo", 1, 5), ("bar", 2, 6), ("baz", 3, None)], "a string, b long, c long")
    b = ColumnProfilerRunner(spark).onData(df).withKLLProfiling().setKLLParameters(KLLParameters(spark, 2, 0.64, 2)).cacheInputs(True).run().profiles["b"]
    assert (b.kll.apply(1).lowValue, b.kll.apply(1).highValue, b.kll.apply(1).count, b.kll.argmax) == (2.0, 3.0, 2, 1)
    assert {1.0, 2.0, 3.0} <= set(b.approxPercentiles) and (b.minimum, b.maximum, b.mean, b.sum) == (1.0, 3.0, 2.0, 6.0)


ITEMS = [("thingA", "13.0", "IN_TRANSIT", "true"), ("thingA", "5", "DELAYED", "false"), ("thingB", None, "DELAYED", None), ("thingC", None, "IN_TRANSIT", "false"),
         ("thingD", "1.0", "DELAYED", "true"), ("thingC", "7.0", "UNKNOWN", None), ("thingC", "20", "UNKNOWN", None), ("thingE", "20", "DELAYED", "false"),
         ("thingA", "13.0", "IN_TRANSIT", "true"), ("thingA", "5", "DELAYED", "false"), ("thingB", None, "DELAYED", None), ("thingC", None, "IN_TRANSIT", "false"),
         ("thingD", "1.0", "DELAYED", "true"), ("thingC", "17.0", "UNKNOWN", None), ("thingC", "22", "UNKNOWN", None), ("thingE", "23", "DELAYED", "false")]


def test_suggestions(spark):
    df = spark.createDataFrame(ITEMS, "productName string, totalNumber string, status string, valuable string")
    found = ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(DEFAULT()).run()["constraint_suggestions"]
    code = {(s["column_name"], s["code_for_constraint"]) for s in found}
    assert ("valuable", '.hasCompleteness("valuable", lambda x: x >= 0.38, "It should be above 0.38!")') in code
    assert ("valuable", '.hasDataType("valuable", ConstrainableDataTypes.Boolean)') in code
    assert ("totalNumber", '.hasCompleteness("totalNumber", lambda x: x >= 0.53, "It should be above 0.53!")') in code
    assert ("totalNumber", '.hasDataType("totalNumber", ConstrainableDataTypes.Fractional)') in code and ("totalNumber", '.isNonNegative("totalNumber")') in code
    assert ("status", '.isContainedIn("status", ["DELAYED", "IN_TRANSIT", "UNKNOWN"])') in code and ("productName", '.isComplete("productName")') in code
    assert "'valuable' has less than 62% missing values" in {s["description"] for s in found}
    assert not any(s["suggesting_rule"] == "FractionalCategoricalRangeRule" for s in found)


def test_single_rules_and_split(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(["foo", "bar", "baz"] * 10)], "a string, d long")
    run = lambda rule: ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(rule)
    assert [s["column_name"] for s in run(FractionalCategoricalRangeRule()).run()["constraint_suggestions"]] == ["a"]
    assert [s["column_name"] for s in run(UniqueIfApproximatelyUniqueRule()).run()["constraint_suggestions"]] == ["d"]
    split = run(DEFAULT()).useTrainTestSplitWithTestsetRatio(0.3).run()["constraint_suggestions"]
    assert split and all(s["constraint_result_on_test_set"] in ("Success", "Failure") for s in split)


def test_unique_column_whose_sketch_misses_by_more_than_the_tolerance(spark):
    df = spark.range(59 * 400, 60 * 400).selectExpr("id", "id - id % 2 AS twice", "id - (id % 400 < 40)::int AS nearly")
    assert abs(1 - df.selectExpr("approx_count_distinct(id)").first()[0] / 400) > 0.08
    run = ConstraintSuggestionRunner(spark).onData(df).addConstraintRule(UniqueIfApproximatelyUniqueRule())
    exact = [c for c in df.columns if df.select(c).distinct().count() >= 0.92 * 400]
    assert [s["column_name"] for s in run.run()["constraint_suggestions"]] == exact == ["id", "nearly"]
    assert run.columnProfiles.profiles["id"].numDistinctValues == 400


def test_states_merge_to_the_whole(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS x")
    parts = [states.states(df.where(f"id % 4 = {i}"), ["id", "x"]) for i in range(4)]
    got = {(r["instance"], r["name"]): r["value"] for r in states.metrics(states.merge(parts)).collect()}
    whole = {(r["instance"], r["name"]): r["value"] for r in states.metrics(states.states(df, ["id", "x"])).collect()}
    assert got == pytest.approx(whole) and got["x", "Completeness"] == 0.66 and got["id", "ApproxCountDistinct"] == pytest.approx(100, rel=0.05)


def test_stream_monitor(spark, tmp_path):
    from plumbline import Check, CheckLevel

    src = f"{tmp_path}/in"
    spark.range(10).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    repo, seen = InMemoryMetricsRepository(spark), []
    query = monitor(stream, [Check(spark, CheckLevel.Error, "ids").isComplete("id").hasSize(lambda x: x == 10)], repo,
                    lambda i, r: seen.append((i, r.status))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen == [(0, "Success")] and len(repo.load().getSuccessMetricsAsJson()) == 2
