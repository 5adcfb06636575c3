"""Exact quantiles against sorted values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import ApproxQuantile, ApproxQuantiles, Mean
from plumbline.plans.planner import compute
from plumbline.plans.selection import exact_quantiles, rank_of

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def expected(values, at):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    return [values[rank_of(q, len(values)) - 1] for q in at] if values else None


@pytest.mark.parametrize("make", [
    lambda i: float(i * 7919 % 5000), lambda i: float(i % 2), lambda i: 1.0 if i % 1000 else float(i), lambda i: None if i % 3 else -float(i),
    lambda i: math.nan if i % 5 == 0 else i / 7, lambda i: None, lambda i: 5.0 + (i % 3 == 0) * 1e300])
def test_selection(spark, make):
    values = [make(i) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    for inside in (40, 10_000):
        assert exact_quantiles(df, {"x": (F.col("x"), AT)}, inside)["x"] == expected(values, AT)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(allow_nan=False, allow_infinity=False)), max_size=40), st.lists(st.floats(0, 1), min_size=1, max_size=3))
def test_selection_of_any_values(spark, values, at):
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    assert exact_quantiles(df, {"x": (F.col("x"), at)}, 3)["x"] == expected(values, at)


def test_analyzers_without_error(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000).cast("double").alias("x"), (F.col("id") % 5).alias("y"), F.lit(None).cast("double").alias("z"), F.lit("a").alias("t"))
    wanted = [ApproxQuantile("x", 0.3, 0.0), ApproxQuantile("x", 0.5, 0.0, "y = 2"), ApproxQuantiles("y", [0.2, 0.5], 0.0), ApproxQuantile("z", 0.5, 0.0),
              ApproxQuantile("t", 0.5, 0.0), ApproxQuantile("x", 0.5, 0.0, "1 / (y - 1) > 0"), Mean("x")]
    got = [compute(df, wanted)[a] for a in wanted]
    assert [o.value for o in got[:3]] == [8999.0, got[1].value, {0.2: 0.0, 0.5: 2.0}]
    inside = sorted(r[0] for r in df.where("y = 2").select("x").collect())
    assert got[1].value == inside[rank_of(0.5, len(inside)) - 1]
    assert not got[3].ok and not got[4].ok and not got[5].ok and got[6].ok


def test_no_pass_buffers_a_column(spark):
    """What is gathered is what the counts before say lies inside."""
    gathered = []
    df = spark.range(200_000).select((F.hash("id") % 100_000).cast("double").alias("x"))
    original = type(df).agg

    def watched(self, *columns):
        out = original(self, *columns)
        gathered.extend(c for c in out.columns if c.startswith("all"))
        if out.columns and any(c.startswith("all") for c in out.columns):
            row = out.first()
            assert all(len(row[c]) <= 10_000 for c in out.columns if c.startswith("all"))
        return out

    type(df).agg = watched
    try:
        found = exact_quantiles(df, {"x": (F.col("x"), [0.5])})["x"]
    finally:
        type(df).agg = original
    assert gathered and found == expected([r[0] for r in df.collect()], [0.5])
