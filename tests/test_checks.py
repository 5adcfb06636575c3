import pytest

from plumbline import (
    Check,
    CheckLevel,
    ConstrainableDataTypes,
    KLLParameters,
    VerificationResult,
    VerificationSuite,
)

#: Rows and expected results that must equal those of the API's users.
ROWS = [
    ("foo", 1, 5, 5, 3, 1, "a", 0, "5130566665286573", "foo@example.com", "123-45-6789", "http://userid@example.com:8080", "true"),
    ("bar", 2, 6, 5, 2, 2, "b", -1, "4532677117740914", "bar@example.com", "123456789", "http://foo.com/(something)?after=parens", "false"),
    ("baz", 3, None, 5, 1, 1, None, 2, "340145324521741", "yourusername@example.com", "000-00-0000", "http://userid@example.com:8080", "true"),
]
FORM = ("a string, b long, c long, d long, e long, f long, g string, h long, creditCard string, email string, ssn string, URL string, "
        "boolean string")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, FORM)


def run(df, build):
    check = Check(df.sparkSession, CheckLevel.Warning, "test")
    build(check)
    result = VerificationSuite(df.sparkSession).onData(df).addCheck(check).run()
    rows = VerificationResult.checkResultsAsDataFrame(df.sparkSession, result).collect()
    assert [r.asDict() for r in rows] == VerificationResult.checkResultsAsJson(df.sparkSession, result)
    return [(r["constraint_status"] == "Success") for r in rows], [r["constraint_message"] for r in rows], result


N, S = ConstrainableDataTypes.Numeric, ConstrainableDataTypes.String


@pytest.mark.parametrize(("build", "good"), [
    (lambda c: c.hasSize(lambda x: x == 3), True), (lambda c: c.hasSize(lambda x: x == 4), False), (lambda c: c.isComplete("b"), True),
    (lambda c: c.isComplete("c"), False), (lambda c: c.hasCompleteness("c", lambda x: x >= 2 / 3), True), (lambda c: c.areComplete(["a", "b"]), True),
    (lambda c: c.areComplete(["a", "c"]), False), (lambda c: c.haveCompleteness(["a", "c"], lambda x: x == 2 / 3), True),
    (lambda c: c.areAnyComplete(["a", "c"]), True), (lambda c: c.areAnyComplete(["c"]), False), (lambda c: c.haveAnyCompleteness(["c", "g"], lambda x: x == 2 / 3), True),
    (lambda c: c.isUnique("b"), True), (lambda c: c.isUnique("f"), False), (lambda c: c.isPrimaryKey("d", "f"), False), (lambda c: c.isPrimaryKey("d", "f", "b"), True),
    (lambda c: c.hasUniqueness(["d", "d"], lambda x: x == 0), True), (lambda c: c.hasUniqueness(["b", "f"], lambda x: x == 1), True),
    (lambda c: c.hasDistinctness(["c"], lambda x: x == 1), True), (lambda c: c.hasDistinctness(["d"], lambda x: x == 1 / 3), True),
    (lambda c: c.hasUniqueValueRatio(["f"], lambda x: x == 0.5), True), (lambda c: c.hasNumberOfDistinctValues("b", lambda x: x == 3), True),
    (lambda c: c.hasHistogramValues("b", lambda d: d["1"].absolute == 1 and d["2"].ratio == 1 / 3), True),
    (lambda c: c.kllSketchSatisfies("b", lambda d: d.apply(0).count == 1 and d.apply(1).highValue == 3.0, KLLParameters(2, 0.64, 2)), True),
    (lambda c: c.hasEntropy("d", lambda x: x == 0), True), (lambda c: c.hasMutualInformation("b", "d", lambda x: abs(x) < 1e-12), True),
    (lambda c: c.hasApproxQuantile("f", ".75", lambda x: x == 2), True), (lambda c: c.hasApproxQuantile("a", 0.5, lambda x: x == 2), False),
    (lambda c: c.hasMinLength("g", lambda x: x == 1), True), (lambda c: c.hasMinLength("b", lambda x: x == 1), False), (lambda c: c.hasMaxLength("a", lambda x: x == 3), True),
    (lambda c: c.hasMin("h", lambda x: x == -1), True), (lambda c: c.hasMin("a", lambda x: True), False), (lambda c: c.hasMax("c", lambda x: x == 6), True),
    (lambda c: c.hasMean("b", lambda x: x == 2), True), (lambda c: c.hasSum("c", lambda x: x == 11), True), (lambda c: c.hasStandardDeviation("c", lambda x: x == 0.5), True),
    (lambda c: c.hasApproxCountDistinct("b", lambda x: x == 3), True), (lambda c: c.hasCorrelation("b", "e", lambda x: x == -1), True),
    (lambda c: c.satisfies("b >= 2 AND d = 5", "two", lambda x: x == 2 / 3), True), (lambda c: c.satisfies("nope > 1", "bad"), False),
    (lambda c: c.hasPattern("a", "ba(r|z)", lambda x: x == 2 / 3), True), (lambda c: c.containsCreditCardNumber("creditCard"), True),
    (lambda c: c.containsEmail("email"), True), (lambda c: c.containsEmail("a"), False), (lambda c: c.containsURL("URL"), True),
    (lambda c: c.containsSocialSecurityNumber("ssn", lambda x: x == 2 / 3), True), (lambda c: c.hasDataType("b", N), True), (lambda c: c.hasDataType("a", S), True),
    (lambda c: c.hasDataType("boolean", ConstrainableDataTypes.Boolean), True), (lambda c: c.hasDataType("a", N), False), (lambda c: c.isNonNegative("h"), False),
    (lambda c: c.isNonNegative("c"), True), (lambda c: c.isPositive("c"), True), (lambda c: c.isPositive("h"), False), (lambda c: c.isLessThan("b", "c"), False),
    (lambda c: c.isLessThan("b", "c", lambda x: x == 2 / 3), True), (lambda c: c.isLessThan("b", "d"), True), (lambda c: c.isLessThanOrEqualTo("b", "c", lambda x: x == 2 / 3), True),
    (lambda c: c.isGreaterThan("d", "b"), True), (lambda c: c.isGreaterThanOrEqualTo("c", "d", lambda x: x == 2 / 3), True), (lambda c: c.isContainedIn("a", ["foo", "bar", "baz"]), True),
    (lambda c: c.isContainedIn("c", ["5", "6"]), True), (lambda c: c.isContainedIn("a", ["foo"]), False), (lambda c: c.hasSize(lambda x: x == 2).where("b > 1"), True),
    (lambda c: c.isComplete("c").where("b < 3"), True), (lambda c: c.isUnique("f").where("b > 1"), True), (lambda c: c.isComplete("nope"), False),
])
def test_constraint(df, build, good):
    assert run(df, build)[0] == [good]


def test_messages(df):
    _, messages, result = run(df, lambda c: c.hasCompleteness("c", lambda x: x == 1, "hint here").isComplete("123-45-6789").hasSize(lambda x: x == 3))
    assert messages == ["Value: 0.6666666666666666 does not meet the constraint requirement! hint here", "Input data does not include column 123-45-6789!", ""]
    assert result.status == "Warning"


def test_where_applies_to_the_last_constraint_only(df):
    assert run(df, lambda c: c.isComplete("c").hasSize(lambda x: x == 1).where("b = 1"))[0] == [False, True]
    with pytest.raises(TypeError):
        Check(df.sparkSession, CheckLevel.Error, "x").kllSketchSatisfies("b", lambda d: True).where("b = 1")


def test_add_constraints_counts_each_once(df):
    def build(c):
        c.addConstraints([c.isComplete("b"), c.containsEmail("email")])

    assert run(df, build)[0] == [True, True]


def test_values_must_be_text(df):
    with pytest.raises(TypeError):
        Check(df.sparkSession, CheckLevel.Error, "x").isContainedIn("b", [1, 2])


def test_levels_and_empty_checks(df):
    spark = df.sparkSession
    bad = Check(spark, CheckLevel.Error, "bad").isComplete("c")
    warn = Check(spark, CheckLevel.Warning, "warn").isComplete("c")
    assert VerificationSuite(spark).onData(df).addCheck(warn).addCheck(bad).run().status == "Error"
    empty = VerificationSuite(spark).onData(df).addCheck(Check(spark, CheckLevel.Error, "none")).run()
    assert empty.status == "Success" and empty.checkResults == []


def rows(df, *checks):
    spark = df.sparkSession
    suite = VerificationSuite(spark).onData(df)
    for c in checks:
        suite = suite.addCheck(c)
    return VerificationResult.rowLevelResultsAsDataFrame(spark, suite.run(), df).orderBy("b")


def test_row_level(df):
    spark = df.sparkSession
    one = Check(spark, CheckLevel.Error, "one").isContainedIn("a", ["foo", "baz"]).isComplete("c")
    two = Check(spark, CheckLevel.Error, "two").isUnique("f").hasMin("h", lambda x: x >= 0)
    size = Check(spark, CheckLevel.Error, "size").hasSize(lambda x: x > 0)
    part = Check(spark, CheckLevel.Error, "part").isComplete("c").where("b < 3")
    got = rows(df, one, two, size, part)
    assert "size" not in got.columns and got.columns[:13] == df.columns
    assert [tuple(r) for r in got.select("one", "two", "part").collect()] == [(True, False, True), (False, False, True), (False, False, True)]
