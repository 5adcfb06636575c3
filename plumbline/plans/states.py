"""States of metrics: what is left of a part of the data when it has been read once.

A part's states are one small row for each scan analyzer and one frequency table for each set of grouping columns, filter and
binning. States of parts (days, batches, partitions) merge to the states of the whole, and metrics are computed from states
alone. Filters and parameters are part of an analyzer's identity, and so of its state's.

Rows merge by sums, extremes and sketches; deviations and correlations by co-moments about the common mean, which keeps digits
far from zero. Frequency tables merge by key with a map-side step and never leave Spark. Quantiles come from a KLL sketch, also
where an analyzer asks for a smaller error; bucket counts come from the sketch's ranks, and a grid of its percentiles stands in place of levels.

NaN counts as a value: it makes means, sums, deviations and maxima NaN, as in a scan of the whole; sketches leave it out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import VALUE_CLASSES, value_class
from ..operators.analyzers import (
    Analyzer,
    ApproxCountDistinct,
    ApproxQuantile,
    ApproxQuantiles,
    Completeness,
    Compliance,
    Correlation,
    DataType,
    EmptyState,
    FrequencyStats,
    GroupingAnalyzer,
    Histogram,
    KLLSketch,
    Maximum,
    MaxLength,
    Mean,
    Minimum,
    MinLength,
    MutualInformation,
    PatternMatch,
    ScanAnalyzer,
    Size,
    StandardDeviation,
    Sum,
    col,
)
from ..operators.metrics import Outcome
from ..sources.files import Files, stamp
from .planner import (
    attempt,
    binned,
    expression_problem,
    frequencies,
    frequency_stats,
    histogram_of,
    information_of,
)

#: Columns of a state; ``hits`` is how many values the others are of.
FIELDS = {"rows": "long", "hits": "long", "low": "double", "high": "double", "mean": "double", "m2": "double", "mean_y": "double", "m2_y": "double",
          "xy": "double", "hll": "binary", "kll": "binary", "counts": "array<long>"}
#: Size of sketches for quantiles.
QUANTILE_SKETCH = 4096


def sketch_size(a: Analyzer) -> int:
    return min(65535, max(8, a.parameters.sketchSize)) if isinstance(a, KLLSketch) else QUANTILE_SKETCH


def state_columns(a: ScanAnalyzer, schema: Any) -> dict[str, Column]:
    """What is kept of a part for the analyzer."""
    kept = {"rows": a.rows_kept()}
    if isinstance(a, Size):
        return kept
    if isinstance(a, Compliance):
        return kept | {"hits": a.hits(F.expr(a.predicate))}
    if isinstance(a, PatternMatch):
        return kept | {"hits": a.hits(col(a.column).cast("string").rlike(a.pattern))}
    if isinstance(a, Correlation):
        x, y = (a.kept(col(c).cast("double")) for c in a.columns)
        both = x.isNotNull() & y.isNotNull()
        x, y, n = F.when(both, x), F.when(both, y), F.count(F.when(both, 1))
        return kept | {"hits": n, "mean": F.avg(x), "m2": F.var_pop(x) * n, "mean_y": F.avg(y), "m2_y": F.var_pop(y) * n, "xy": F.covar_pop(x, y) * n}
    value = a.kept(col(a.columns[0]))
    kept["hits"] = F.count(value)
    if isinstance(a, (Minimum, Maximum)):
        return kept | {"low": F.min(a.number()), "high": F.max(a.number())}
    if isinstance(a, (Mean, Sum, StandardDeviation)):
        return kept | {"mean": F.avg(a.number()), "m2": F.var_pop(a.number()) * F.count(value)}
    if isinstance(a, (MinLength, MaxLength)):
        return kept | {"low": F.min(F.length(value)).cast("double"), "high": F.max(F.length(value)).cast("double")}
    if isinstance(a, ApproxCountDistinct):
        return kept | {"hll": F.hll_sketch_agg(value.cast("string"), F.lit(14))}
    if isinstance(a, DataType):
        kind = value_class(col(a.column), schema[a.column].dataType)
        return kept | {"counts": F.array(*[F.count(a.kept(F.when(kind == c, 1))) for c in VALUE_CLASSES])}
    if isinstance(a, (ApproxQuantile, ApproxQuantiles, KLLSketch)):
        number = F.when(~F.isnan(a.number()), a.number())
        n = F.count(number)
        return kept | {"hits": n, "low": F.min(number), "high": F.max(number),
                       "kll": F.when(n > 0, F.kll_sketch_agg_double(number, F.lit(sketch_size(a))))}
    if isinstance(a, Completeness):
        return kept
    raise TypeError(f"{a.name} has no state that merges")


def table_key(a: Analyzer) -> str:
    """Identity of the frequency table that the analyzer needs."""
    if isinstance(a, Histogram):
        return f"bins {a.column!r} {a.where!r} {'' if a.binningUdf is None else a.binning!r}"
    return f"groups {list(dict.fromkeys(a.columns))!r} {getattr(a, 'where', None)!r}"


def has_table(a: Analyzer) -> bool:
    return isinstance(a, (GroupingAnalyzer, Histogram))


@dataclass
class States:
    """States of analyzers over a part of the data, or over several parts."""

    spark: SparkSession
    scans: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Analyzers that the part's schema does not allow, by key.
    problems: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, analyzers: Iterable[Analyzer]) -> States:
        """The states of all rows of df: one aggregation for all scan analyzers, a table for each set of grouping columns."""
        out = cls(df.sparkSession)
        scans = []
        for a in dict.fromkeys(analyzers):
            problem = a.precondition(df.schema) or expression_problem(df, a)
            if problem is not None:
                out.problems[a.key] = problem
            elif has_table(a):
                if table_key(a) not in out.tables:
                    out.tables[table_key(a)] = binned(df, a) if isinstance(a, Histogram) else frequencies(df, a.columns, getattr(a, "where", None))
            else:
                scans.append(a)
        if scans:
            rows = []
            for a in scans:
                kept = state_columns(a, df.schema)
                rows.append(F.struct(F.lit(a.key).alias("analyzer"), F.lit(sketch_size(a)).alias("size"),
                                     *[kept.get(f, F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items()]))
            one = df.agg(*[r.alias(f"s{i}") for i, r in enumerate(rows)])
            out.scans = one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(rows))])).alias("s")).select("s.*")
        return out

    @staticmethod
    def merge(parts: Iterable[States]) -> States:
        """The states of all rows of all parts; a part without a state for an analyzer adds nothing to it."""
        parts = list(parts)
        out = States(parts[0].spark, problems={k: v for p in parts for k, v in p.problems.items()})
        scans = [p.scans for p in parts if p.scans is not None]
        if scans:
            out.scans = merge_rows(reduce(DataFrame.unionByName, scans))
        for key in dict.fromkeys(k for p in parts for k in p.tables):
            every = reduce(DataFrame.unionByName, [p.tables[key] for p in parts if key in p.tables])
            out.tables[key] = every.groupBy(*[c for c in every.columns if c != "n"]).agg(F.sum("n").alias("n"))
        return out

    def outcomes(self, analyzers: Iterable[Analyzer]) -> dict[Analyzer, Outcome]:
        """The analyzers' values, from states alone."""
        wanted = list(dict.fromkeys(analyzers))
        rows = {} if self.scans is None else {r["analyzer"]: r for r in self.scans.withColumn("grid", _grid()).withColumn(
            "distinct", F.when(F.col("hll").isNotNull(), F.hll_sketch_estimate("hll"))).collect()}
        stats: dict[str, FrequencyStats] = {}

        def value(a: Analyzer) -> Any:
            if has_table(a):
                table = self.tables.get(table_key(a))
                if table is None:
                    raise EmptyState(self.problems.get(a.key) or f"Empty state for analyzer {a.key}, all input values were NULL.")
                if isinstance(a, Histogram):
                    return histogram_of(table, a)
                if isinstance(a, MutualInformation):
                    return information_of(table, a)
                if table_key(a) not in stats:
                    stats[table_key(a)] = FrequencyStats(*frequency_stats(table).first())
                return a.checked(stats[table_key(a)])
            if a.key not in rows:
                raise EmptyState(self.problems.get(a.key) or f"Empty state for analyzer {a.key}, all input values were NULL.")
            return self._scan_value(a, rows[a.key])

        return {a: attempt(lambda a=a: value(a)) for a in wanted}

    def _scan_value(self, a: ScanAnalyzer, r: Row) -> Any:
        if isinstance(a, Size):
            return float(r["rows"])
        if isinstance(a, (Completeness, Compliance, PatternMatch)):
            return a.value([r["hits"] / r["rows"] if r["rows"] else None])
        if isinstance(a, DataType):
            return a.value(r["counts"] or [0] * len(VALUE_CLASSES))
        if isinstance(a, ApproxCountDistinct):
            return a.value([r["distinct"] or 0])
        if not r["hits"]:
            return a.value([None])
        if isinstance(a, (Minimum, MinLength)):
            return a.value([r["low"]])
        if isinstance(a, (Maximum, MaxLength)):
            return a.value([r["high"]])
        if isinstance(a, Mean):
            return a.value([r["mean"]])
        if isinstance(a, Sum):
            return a.value([r["mean"] * r["hits"]])
        if isinstance(a, StandardDeviation):
            return a.value([math.sqrt(r["m2"] / r["hits"])])
        if isinstance(a, Correlation):
            spread = math.sqrt(r["m2"] * r["m2_y"])
            return a.value([r["xy"] / spread if spread else math.nan])
        quantiles = {"ApproxQuantile": lambda: [float(a.quantile)], "ApproxQuantiles": lambda: list(a.quantiles)}
        if type(a).__name__ in quantiles:
            got = self._ask(r["kll"], "quantile", quantiles[type(a).__name__]())
            return a.value([got[0]] if isinstance(a, ApproxQuantile) else [got])
        return self._buckets(a, r)

    def _buckets(self, a: KLLSketch, r: Row) -> Any:
        """Buckets by ranks just below their inner edges, where an inclusive rank counts the smaller values alone."""
        n, low, high = a.parameters.numberOfBuckets, r["low"], r["high"]
        counts = {n - 1: r["hits"]}
        if high > low:
            edges = [math.nextafter(low + i * ((high - low) / n), -math.inf) for i in range(1, n)]
            below = [0, *(round(x * r["hits"]) for x in self._ask(r["kll"], "rank", edges)), r["hits"]]
            counts = {i: below[i + 1] - below[i] for i in range(n)}
        return a.distribution(low, high, [r["grid"]], counts)

    def _ask(self, sketch: bytes, what: str, at: list[float]) -> list[float]:
        """Ranks or quantiles of one sketch, by Spark's functions."""
        if not at:
            return []
        f = F.kll_sketch_get_rank_double if what == "rank" else F.kll_sketch_get_quantile_double
        one = self.spark.createDataFrame([(bytearray(sketch),)], "k binary")
        return list(one.select(f("k", F.array(*[F.lit(float(x)) for x in at]))).first()[0])

    def save(self, path: str) -> None:
        if self.scans is not None:
            self.scans.write.parquet(f"{path}/scans")
        for key, table in self.tables.items():
            table.write.parquet(f"{path}/{folder_of(key)}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzers: Iterable[Analyzer]) -> States:
        """The saved states of the analyzers that the part has."""
        files, out = Files(spark, path), cls(spark)
        analyzers = list(analyzers)
        keys = [a.key for a in analyzers if not has_table(a)]
        if keys and files.exists(f"{path}/scans"):
            out.scans = spark.read.parquet(f"{path}/scans").where(F.col("analyzer").isin(keys))
        for key in dict.fromkeys(table_key(a) for a in analyzers if has_table(a)):
            if files.exists(f"{path}/{folder_of(key)}"):
                out.tables[key] = spark.read.parquet(f"{path}/{folder_of(key)}")
        return out


def folder_of(key: str) -> str:
    return "table-" + hashlib.sha256(key.encode()).hexdigest()[:24]


def _grid() -> Column:
    at = F.array(*[F.lit(i / 100) for i in range(1, 101)])
    return F.when(F.col("kll").isNotNull(), F.kll_sketch_get_quantile_double("kll", at))


def merge_rows(rows: DataFrame) -> DataFrame:
    """One row for each analyzer. Means and co-moments are taken about the common means, as each part's are known."""
    own = Window.partitionBy("analyzer")  # a row for each part
    n = F.col("hits")
    some = F.when(n > 0, n)
    whole = lambda m: F.try_divide(F.sum(F.col(m) * some).over(own), F.sum(F.when(F.col(m).isNotNull(), some)).over(own))
    rows = rows.withColumn("all_x", whole("mean")).withColumn("all_y", whole("mean_y"))
    dx, dy = F.col("mean") - F.col("all_x"), F.col("mean_y") - F.col("all_y")
    merged = rows.groupBy("analyzer", "size").agg(
        F.sum("rows").alias("rows"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("all_x").alias("mean"),
        F.sum(F.col("m2") + some * dx * dx).alias("m2"), F.first("all_y").alias("mean_y"), F.sum(F.col("m2_y") + some * dy * dy).alias("m2_y"),
        F.sum(F.col("xy") + some * dx * dy).alias("xy"), F.hll_union_agg("hll").alias("hll"),
        F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll")).alias("kll"), F.collect_list("counts").alias("all_counts"))
    sums = F.aggregate(F.slice("all_counts", F.lit(2), F.greatest(F.size("all_counts") - 1, F.lit(0))), F.element_at("all_counts", 1),
                       lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return merged.select("analyzer", "size", *[c for c in FIELDS if c != "counts"], F.when(F.size("all_counts") > 0, sums).alias("counts"))


class StateStore:
    """States of named parts in a folder that Spark reaches; a part saved again takes the place of what it was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)

    @staticmethod
    def _name(part: str) -> str:
        return "part-" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in str(part))

    def _current(self, part: str) -> str | None:
        """The newest version of the part that was saved whole."""
        folder = f"{self.path}/{self._name(part)}"
        return next((f"{folder}/{v}" for v in reversed(self.files.names(folder)) if self.files.exists(f"{folder}/{v}/whole")), None)

    def parts(self) -> list[str]:
        """Names of all parts, as saved."""
        out = []
        for folder in self.files.names(self.path):
            for v in reversed(self.files.names(f"{self.path}/{folder}")):
                if self.files.exists(f"{self.path}/{folder}/{v}/whole"):
                    out.append(self.spark.read.text(f"{self.path}/{folder}/{v}/whole").first()[0])
                    break
        return out

    def save(self, part: str, states: States) -> None:
        folder = f"{self.path}/{self._name(part)}"
        before, version = self.files.names(folder), f"{folder}/{stamp()}"
        states.save(version)
        self.files.write(f"{version}/whole", str(part).encode())  # readers see the version from here on
        for v in before:
            self.files.delete(f"{folder}/{v}")

    def load(self, part: str, analyzers: Iterable[Analyzer]) -> States | None:
        path = self._current(part)
        return None if path is None else States.load(self.spark, path, analyzers)

    def merged(self, parts: Iterable[str], analyzers: Iterable[Analyzer]) -> States:
        analyzers = list(analyzers)
        found = [s for s in (self.load(p, analyzers) for p in parts) if s is not None]
        if not found:
            raise ValueError("no states are saved for these parts")
        return States.merge(found)

    def drop(self, part: str) -> None:
        self.files.delete(f"{self.path}/{self._name(part)}")
