"""Plans the jobs of a set of analyzers.

All scan analyzers share one aggregation. Grouping analyzers share a frequency table for
each (columns, filter). Each analyzer fails by itself: preconditions and expressions are
checked against the schema before any job runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    ParseException,
    PythonException,
    SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kll import Compactors
from ..operators.analyzers import (
    Analyzer,
    ApproxQuantile,
    ApproxQuantiles,
    EmptyState,
    FrequencyStats,
    GroupingAnalyzer,
    Histogram,
    KLLSketch,
    MutualInformation,
    ScanAnalyzer,
    col,
)
from ..operators.metrics import Distribution, DistributionValue, Outcome
from .selection import exact_quantiles

#: What Spark raises for the data or the expressions on it, not for the cluster.
DATA_ERRORS = (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
               NumberFormatException, ParseException, PythonException, SparkRuntimeException)


def compute(df: DataFrame, analyzers: Iterable[Analyzer]) -> dict[Analyzer, Outcome]:
    """The outcome of each distinct analyzer, in the order given."""
    wanted = list(dict.fromkeys(analyzers))
    out: dict[Analyzer, Outcome] = {}
    sound: list[Analyzer] = []
    for a in wanted:
        problem = a.precondition(df.schema) or expression_problem(df, a)
        if problem is None:
            sound.append(a)
        else:
            out[a] = Outcome(error=problem)
    exact = [a for a in sound if isinstance(a, (ApproxQuantile, ApproxQuantiles)) and a.relativeError == 0]
    out |= scan(df, [a for a in sound if isinstance(a, ScanAnalyzer) and a not in exact])
    out |= selected(df, exact)
    out |= grouped(df, [a for a in sound if isinstance(a, GroupingAnalyzer)])
    for a in sound:
        if isinstance(a, Histogram):
            out[a] = attempt(lambda a=a: histogram(df, a))
    return {a: out[a] for a in wanted}


def attempt(make) -> Outcome:
    try:
        return Outcome(make())
    except EmptyState as e:
        return Outcome(error=str(e))
    except (*DATA_ERRORS, ArithmeticError, ValueError, TypeError, KeyError) as e:  # a job that fails on its data is the metric's failure
        return Outcome(error=first_line(e))


def first_line(e: Exception) -> str:
    """What an error says first."""
    return next((x.strip() for x in str(e).splitlines() if x.strip()), type(e).__name__)


def expression_problem(df: DataFrame, a: Analyzer) -> str | None:
    """An error of analysis in the analyzer's own expressions, found without a job."""
    try:
        if isinstance(a, ScanAnalyzer):
            df.agg(*a.aggregates(df.schema)).schema
        elif getattr(a, "where", None) is not None:
            df.where(a.where).schema
        return None
    except (AnalysisException, ParseException) as e:
        return first_line(e)


def common_filter(analyzers: list[ScanAnalyzer]) -> str | None:
    """The filter that all share, so that it can reach the files."""
    filters = {getattr(a, "where", None) for a in analyzers}
    return filters.pop() if len(filters) == 1 else None


def fused(df: DataFrame, analyzers: list[ScanAnalyzer]) -> DataFrame:
    """One row with the aggregate columns of all scan analyzers, from one scan."""
    columns: list[Column] = []
    for i, a in enumerate(analyzers):
        columns += [c.alias(f"m{i}_{j}") for j, c in enumerate(a.aggregates(df.schema))]
    if (shared := common_filter(analyzers)) is not None:
        df = df.where(shared)
    return df.agg(*columns)


def scan(df: DataFrame, analyzers: list[ScanAnalyzer]) -> dict[Analyzer, Outcome]:
    if not analyzers:
        return {}
    try:
        row = fused(df, analyzers).first()
    except DATA_ERRORS:  # a lost executor or a missing file is no metric's failure
        if len(analyzers) == 1:
            return {analyzers[0]: attempt(lambda: _raise_again(df, analyzers[0]))}
        # One bad value fails a shared job: find whose it is by halves.
        half = len(analyzers) // 2
        return scan(df, analyzers[:half]) | scan(df, analyzers[half:])
    out: dict[Analyzer, Outcome] = {}
    sketches: dict[KLLSketch, list] = {}
    for i, a in enumerate(analyzers):
        got = [row[f"m{i}_{j}"] for j in range(len(a.aggregates(df.schema)))]
        if isinstance(a, KLLSketch) and got[0] is not None:
            sketches[a] = got
        else:
            out[a] = attempt(lambda a=a, got=got: a.value(got))
    return out | buckets(df, sketches)


def selected(df: DataFrame, analyzers: list) -> dict[Analyzer, Outcome]:
    """Quantiles without error, a few passes for all; one bad value costs its own column alone."""
    if not analyzers:
        return {}
    try:
        found = exact_quantiles(df, {a: (a.number(), list(a.quantiles) if isinstance(a, ApproxQuantiles) else [a.quantile]) for a in analyzers})
    except DATA_ERRORS as e:
        if len(analyzers) == 1:
            return {analyzers[0]: Outcome(error=first_line(e))}
        half = len(analyzers) // 2
        return selected(df, analyzers[:half]) | selected(df, analyzers[half:])
    return {a: attempt(lambda a=a: a.value([None if found[a] is None else found[a] if isinstance(a, ApproxQuantiles) else found[a][0]])) for a in analyzers}


def _raise_again(df: DataFrame, a: ScanAnalyzer):
    return a.value(list(df.agg(*a.aggregates(df.schema)).first()))


#: Sketches of so many tasks are merged by one task of the first step.
SKETCH_FAN_IN = 64
SUMMARY = "i int, part long, counts array<long>, levels array<array<double>>"


def buckets(df: DataFrame, found: dict[KLLSketch, list]) -> dict[Analyzer, Outcome]:
    """Bucket counts and sketches of all columns in a second scan: one summary a task and column, merged in two steps."""
    if not found:
        return {}
    sketches = list(found)
    plan = [(float(found[a][0]), float(found[a][1]), a.parameters.numberOfBuckets, a.parameters.sketchSize, a.parameters.shrinkingFactor) for a in sketches]
    schema = pa.schema([("i", pa.int32()), ("part", pa.int64()), ("counts", pa.list_(pa.int64())), ("levels", pa.list_(pa.list_(pa.float64())))])

    def rows(made: list[tuple[int, int, np.ndarray, Compactors]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"i": i, "part": p, "counts": c.tolist(), "levels": [x.tolist() for x in s.levels]} for i, p, c, s in made], schema)

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(i, TaskContext.get().partitionId(), np.zeros(n, np.int64), Compactors(size, shrink)) for i, (_, _, n, size, shrink) in enumerate(plan)]
        for batch in batches:
            for (i, _, counts, sketch), (low, high, n, _, _) in zip(made, plan, strict=True):
                x = batch.column(i).drop_null().to_numpy()
                at = np.floor((x - low) / ((high - low) / n)).astype(np.int64) if high > low else np.full(len(x), n - 1)
                counts += np.bincount(np.clip(at, 0, n - 1), minlength=n)
                sketch.add(x)
        yield rows(made)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                i, part, counts, levels = (batch.column(c)[r].as_py() for c in range(4))
                one = (i, part, np.array(counts, np.int64), Compactors(*plan[i][3:], levels))
                if now is not None and now[:2] == one[:2]:
                    now = (*now[:2], now[2] + one[2], now[3].merge(one[3]))
                    continue
                if now is not None:
                    yield rows([now])
                now = one
        if now is not None:
            yield rows([now])

    columns = df.select(*[a.number().alias(f"c{i}") for i, a in enumerate(sketches)])
    summaries = columns.mapInArrow(summarize, SUMMARY)
    for part in (F.expr(f"part div {SKETCH_FAN_IN}"), F.lit(0).cast("long")):
        summaries = summaries.withColumn("part", part).repartition("i", "part").sortWithinPartitions("i", "part").mapInArrow(merge, SUMMARY)
    try:
        got = {r["i"]: r for r in summaries.collect()}
    except DATA_ERRORS as e:
        return {a: Outcome(error=first_line(e)) for a in sketches}
    return {a: Outcome(a.distribution(*plan[i][:2], got[i]["levels"], dict(enumerate(got[i]["counts"])))) for i, a in enumerate(sketches)}


def frequencies(df: DataFrame, columns: tuple[str, ...], where: str | None) -> DataFrame:
    """(g0, g1, ..., n): how often each combination occurs, rows without any value left out."""
    if where is not None:
        df = df.where(where)
    names = list(dict.fromkeys(columns))
    some = F.coalesce(*[F.when(col(c).isNotNull(), True) for c in names])
    return df.where(some).groupBy(*[col(c).alias(f"g{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("n"))


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.when(F.col("n") == 1, 1)).alias("singles"),
        F.coalesce(F.sum(F.col("n") * F.log("n")), F.lit(0.0)).alias("c_log_c")]


def frequency_stats(table: DataFrame) -> DataFrame:
    return table.agg(*_stats())


def derived(column: str, where: str | None) -> Column:
    """The column in rows that pass the filter, else null."""
    return col(column) if where is None else F.when(F.expr(where), col(column))


#: Grouping columns of one job; Spark numbers grouping sets with as many bits.
MOST_GROUPING_COLUMNS = 60


def grouping_jobs(keys: list[tuple]) -> list[list[tuple]]:
    """The (columns, filter) pairs, in runs that have no more derived columns together than one job takes."""
    jobs: list[list[tuple]] = []
    used: set = set()
    for columns, where in keys:
        own = {(c, where) for c in columns}
        if not jobs or len(used | own) > MOST_GROUPING_COLUMNS:
            jobs.append([])
            used = set()
        jobs[-1].append((columns, where))
        used |= own
    return jobs


def all_frequency_stats(df: DataFrame, keys: list[tuple]) -> DataFrame:
    """(set, groups, rows, singles, c_log_c) for each (columns, filter) pair, by its index, from one scan.

    One Expand feeds one aggregation with a map-side step, as GROUPING SETS over the columns under their filters; a group without any
    value stands for rows that its filter or its nulls leave out.
    """
    names: dict[tuple, str] = {}
    for columns, where in keys:
        for c in columns:
            names.setdefault((c, where), f"g{len(names)}")
    sets = [[names[c, where] for c in columns] for columns, where in keys]
    wide = df.select(*[derived(c, where).alias(n) for (c, where), n in names.items()])
    counted = wide.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names.values()]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    bits = list(names.values())
    mask = lambda s: sum(1 << (len(bits) - 1 - i) for i, b in enumerate(bits) if b not in s)
    number, some = F.lit(None).cast("int"), F.lit(False)
    for i, s in enumerate(sets):
        here = F.col("gid") == F.lit(mask(s))
        number = F.when(here, F.lit(i)).otherwise(number)
        some = some | (here & reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in s]))
    return counted.where(some).groupBy(number.alias("set")).agg(*_stats())


def grouped(df: DataFrame, analyzers: list[GroupingAnalyzer]) -> dict[Analyzer, Outcome]:
    out: dict[Analyzer, Outcome] = {}
    shared: dict[tuple, list[GroupingAnalyzer]] = {}
    for a in analyzers:
        if isinstance(a, MutualInformation):
            out[a] = attempt(lambda a=a: mutual_information(df, a))
        else:
            shared.setdefault((tuple(dict.fromkeys(a.columns)), getattr(a, "where", None)), []).append(a)
    for job in grouping_jobs(list(shared)):
        for key, stats in group_stats(df, job).items():
            if isinstance(stats, str):
                out |= {a: Outcome(error=stats) for a in shared[key]}
            else:
                out |= {a: attempt(lambda a=a, stats=stats: a.checked(stats)) for a in shared[key]}
    return out


def group_stats(df: DataFrame, keys: list[tuple]) -> dict[tuple, FrequencyStats | str]:
    """What each frequency table tells, or why it cannot be had; one bad value costs its own table alone."""
    try:
        if len(keys) == 1:
            return {keys[0]: FrequencyStats(*frequency_stats(frequencies(df, *keys[0])).first())}
        found = {r["set"]: FrequencyStats(r["groups"], r["rows"], r["singles"], r["c_log_c"]) for r in all_frequency_stats(df, keys).collect()}
        return {k: found.get(i, FrequencyStats(0, 0, 0, 0.0)) for i, k in enumerate(keys)}
    except DATA_ERRORS as e:
        if len(keys) == 1:
            return {keys[0]: first_line(e)}
        half = len(keys) // 2
        return group_stats(df, keys[:half]) | group_stats(df, keys[half:])


def mutual_information(df: DataFrame, a: MutualInformation) -> float:
    """Sum over pairs of p(x, y) ln(p(x, y) / (p(x) p(y))), from sums of counts.

    The joint table and its two margins are aggregated in one job that shares the joint's shuffle.
    """
    return information_of(frequencies(df, a.columns, a.where), a)


def information_of(joint: DataFrame, a: MutualInformation) -> float:
    """The same from the joint frequency table."""
    if len(set(a.columns)) == 1:
        joint = joint.withColumn("g1", F.col("g0"))
    both = F.when(F.col("g0").isNotNull() & F.col("g1").isNotNull(), F.col("n"))
    log_sum = lambda weight, of: F.sum(weight * F.log(of))
    parts = [joint.agg(F.lit(0).alias("k"), F.sum("n").cast("double").alias("n"), F.sum(both).cast("double").alias("pairs"),
                       log_sum(both, F.col("n")).alias("s"))]
    for k, g in ((1, "g0"), (2, "g1")):
        margin = joint.where(F.col(g).isNotNull()).groupBy(g).agg(F.sum("n").alias("c"), F.sum(both).alias("w"))
        parts.append(margin.agg(F.lit(k).alias("k"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("double").alias("pairs"),
                                log_sum(F.col("w"), F.col("c")).alias("s")))
    rows = {r["k"]: r for r in parts[0].union(parts[1]).union(parts[2]).collect()}
    n = rows[0]["n"]
    if not n:
        raise EmptyState(f"Empty state for analyzer {a.key}, all input values were NULL.")
    if not rows[0]["pairs"]:
        return 0.0
    return (rows[0]["s"] - (rows[1]["s"] or 0.0) - (rows[2]["s"] or 0.0) + math.log(n) * rows[0]["pairs"]) / n


def binned(df: DataFrame, a: Histogram) -> DataFrame:
    """(v, n): how often each bin occurs."""
    if a.where is not None:
        df = df.where(a.where)
    return df.groupBy(a.bins().alias("v")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, a: Histogram) -> Distribution:
    return histogram_of(binned(df, a), a)


def histogram_of(counts: DataFrame, a: Histogram) -> Distribution:
    """Totals and the most frequent bins, ties by value; one job, whose two halves share the shuffle of the counts."""
    totals = counts.agg(F.lit(None).cast("string").alias("v"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins"))
    top = counts.orderBy(F.desc("n"), "v").limit(a.details).select("v", "n", F.lit(None).cast("long").alias("bins"))
    rows = totals.unionByName(top).collect()
    total, bins = next((r["n"], r["bins"]) for r in rows if r["bins"] is not None)
    if not bins:
        raise EmptyState(f"Empty state for analyzer {a.key}, all input values were NULL.")
    best = sorted(((r["v"], r["n"]) for r in rows if r["bins"] is None), key=lambda x: (-x[1], x[0]))
    return Distribution({v: DistributionValue(v, n, n / total) for v, n in best}, bins)
