"""Levels of quantile sketches: weights, bounds of ranks, merging, and the analyzer's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import KLLParameters, KLLSketch, Maximum
from plumbline.functions.kll import Compactors, quantiles, rank
from plumbline.plans.planner import compute


@pytest.mark.parametrize(("size", "shrink"), [(8, 0.5), (64, 0.64), (512, 0.64), (512, 0.9)])
def test_levels_hold_all_by_weight_and_ranks_are_close(size, shrink):
    rng = np.random.default_rng(1)
    values = rng.permutation(40_000).astype(float)
    one = Compactors(size, shrink)
    for part in np.array_split(values, 37):
        one.add(part)
    parts = [Compactors(size, shrink).add(p) for p in np.array_split(values, 9)]
    merged = parts[0]
    for p in parts[1:]:
        merged.merge(p)
    for sketch in (one, merged):
        assert sketch.n == len(values) and sum(map(len, sketch.levels)) <= sum(sketch.capacity(h) for h in range(len(sketch.levels)))
        off = max(abs(rank(sketch.levels, x) - x - 1) for x in range(0, 40_000, 500))
        assert off <= 8 * len(values) / size
        assert max(abs(v - q * len(values)) for q, v in zip((0.1, 0.5, 0.9), quantiles(sketch.levels, (0.1, 0.5, 0.9)), strict=True)) <= 8 * len(values) / size
    again = Compactors(size, shrink)
    for part in np.array_split(values, 37):
        again.add(part)
    assert all((a == b).all() for a, b in zip(one.levels, again.levels, strict=True))


def test_small_and_empty():
    assert quantiles([], [0.5]) == [] and Compactors(64, 0.5).n == 0 and rank([[]], 3) == 0
    s = Compactors(64, 0.64).add(np.array([3.0, 1.0, 2.0]))
    assert quantiles(s.levels, [0.0, 1 / 3, 0.5, 1.0]) == [1.0, 1.0, 2.0, 3.0] and rank(s.levels, 2.0) == 2 and s.merge(Compactors(64, 0.64)).n == 3


def test_analyzer_gives_levels(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 10 != 3, (F.col("id") * 7919 % 50_000).cast("double")).alias("x"), F.lit(7).alias("c")).repartition(130)
    wanted = [KLLSketch("x", KLLParameters(256, 0.64, 5)), KLLSketch("c", KLLParameters(256, 0.64, 2)), KLLSketch("x", KLLParameters(2048, 0.5, 3)), Maximum("x")]
    a, c, b, top = (o.value for o in compute(df, wanted).values())
    exact = sorted(r[0] for r in df.where("x is not null").select("x").collect())
    for got, size in ((a, 256), (b, 2048)):
        assert len(got.data) > 1 and sum(len(level) << h for h, level in enumerate(got.data)) == len(exact) == sum(x.count for x in got.buckets)
        assert all(abs(np.searchsorted(exact, v) - (i + 1) / 100 * len(exact)) <= 8 * len(exact) / size for i, v in enumerate(got.computePercentiles()))
    assert [x.count for x in a.buckets] == [sum(lo <= v < hi or hi == top and v == hi for v in exact) for lo, hi in ((x.lowValue, x.highValue) for x in a.buckets)]
    assert [x.count for x in c.buckets] == [0, 50_000] and set(c.computePercentiles()) == {7.0}
