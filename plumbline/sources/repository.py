"""Metrics over time: in memory, or as files that are added to a folder in any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analyzers import Analyzer
from ..operators.metrics import BucketDistribution, BucketValue, Distribution, DistributionValue
from .files import Files, stamp


class ResultKey:
    """When the data is of, in epoch milliseconds, and tags."""

    def __init__(self, *args: Any, dataSetDate: int | None = None, tags: dict[str, str] | None = None):
        given = [a for a in args if not isinstance(a, SparkSession)]
        date = given[0] if given else dataSetDate
        self.dataSetDate = self.current_milli_time() if date is None else int(date)
        self.tags = dict((given[1] if len(given) > 1 else tags) or {})

    @staticmethod
    def current_milli_time() -> int:
        return time.time_ns() // 1_000_000

    def identity(self) -> tuple:
        return self.dataSetDate, tuple(sorted(self.tags.items()))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ResultKey) and self.identity() == other.identity()

    def __hash__(self) -> int:
        return hash(self.identity())

    def __repr__(self) -> str:
        return f"ResultKey({self.dataSetDate}, {self.tags})"


@dataclass(frozen=True)
class StoredMetric:
    """A metric row with its time, tags and the analyzer that it came from."""

    dataset_date: int
    tags: tuple[tuple[str, str], ...]
    analyzer: str
    entity: str
    instance: str
    name: str
    value: float


@dataclass(frozen=True)
class MetricsLoader:
    """A query over a repository; each restriction gives a new query."""

    repository: MetricsRepository
    tests: tuple = field(default=())

    def _with(self, test) -> MetricsLoader:
        return replace(self, tests=(*self.tests, test))

    def withTagValues(self, tagValues: dict[str, str]) -> MetricsLoader:
        wanted = set(tagValues.items())
        return self._with(lambda m: wanted <= set(m.tags))

    def forAnalyzers(self, analyzers: Iterable[Analyzer]) -> MetricsLoader:
        keys = {a.key for a in analyzers}
        return self._with(lambda m: m.analyzer in keys)

    def before(self, dataSetDate: int) -> MetricsLoader:
        return self._with(lambda m: m.dataset_date <= dataSetDate)

    def after(self, dataSetDate: int) -> MetricsLoader:
        return self._with(lambda m: m.dataset_date >= dataSetDate)

    def metrics(self) -> list[StoredMetric]:
        return sorted((m for m in self.repository.stored() if all(t(m) for t in self.tests)),
                      key=lambda m: (m.dataset_date, m.tags))

    def getSuccessMetricsAsJson(self, withTags: Iterable[str] | None = None) -> list[dict[str, Any]]:
        found = self.metrics()
        tags = sorted({k for m in found for k, _ in m.tags} & set(withTags) if withTags else {k for m in found for k, _ in m.tags})
        return [{"dataset_date": m.dataset_date, **{t: dict(m.tags).get(t) for t in tags}, "entity": m.entity,
                 "instance": m.instance, "name": m.name, "value": m.value} for m in found]

    def getSuccessMetricsAsDataFrame(self, withTags: Iterable[str] | None = None, pandas: bool = False) -> Any:
        rows = self.getSuccessMetricsAsJson(withTags)
        tags = [k for k in (rows[0] if rows else {}) if k not in ("dataset_date", "entity", "instance", "name", "value")]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in ("entity", "instance", "name")]
                              + [T.StructField("value", T.DoubleType()), T.StructField("dataset_date", T.LongType())]
                              + [T.StructField(t, T.StringType()) for t in tags])
        df = self.repository.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
        return df.toPandas() if pandas else df


def typed(value: Any) -> dict[str, Any]:
    """A serial form of an analyzer's value."""
    if isinstance(value, Distribution):
        return {"kind": "distribution", "bins": value.numberOfBins, "values": [[v.value, v.absolute, v.ratio] for v in value.values.values()]}
    if isinstance(value, BucketDistribution):
        return {"kind": "buckets", "buckets": [[b.lowValue, b.highValue, b.count] for b in value.buckets], "parameters": value.parameters, "data": value.data}
    if isinstance(value, dict):
        return {"kind": "numbers", "values": [[k, v] for k, v in value.items()]}
    return {"kind": "number", "value": float(value)}


def untyped(form: dict[str, Any]) -> Any:
    """The value of a serial form."""
    if form["kind"] == "distribution":
        return Distribution({v: DistributionValue(v, n, r) for v, n, r in form["values"]}, form["bins"])
    if form["kind"] == "buckets":
        return BucketDistribution([BucketValue(*b) for b in form["buckets"]], form["parameters"], form["data"])
    if form["kind"] == "numbers":
        return {k: v for k, v in form["values"]}
    return form["value"]


@dataclass(frozen=True)
class Saved:
    """What one analyzer gave for one key in one save: its metric rows, and its value in serial form."""

    saved: str
    dataset_date: int
    tags: tuple[tuple[str, str], ...]
    analyzer: str
    metrics: tuple[StoredMetric, ...]
    value: str | None

    @property
    def identity(self) -> tuple:
        return self.dataset_date, self.tags, self.analyzer


class MetricsRepository:
    """Base of repositories. A save of an analyzer for a key takes the place of what the key had of that analyzer."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def records(self) -> list[Saved]:
        """The newest save of each analyzer and key."""
        raise NotImplementedError

    def add(self, records: list[Saved]) -> None:
        raise NotImplementedError

    def stored(self) -> list[StoredMetric]:
        return [m for r in self.records() for m in r.metrics]

    def values(self, key: ResultKey) -> dict[str, Any]:
        """Values under the key by the analyzer's identity."""
        return {r.analyzer: untyped(json.loads(r.value)) for r in self.records() if (r.dataset_date, r.tags) == key.identity() and r.value is not None}

    def load(self) -> MetricsLoader:
        return MetricsLoader(self)

    def before(self, dataSetDate: int) -> MetricsLoader:
        raise AttributeError("Call load() before restricting the metrics")

    after = withTagValues = forAnalyzers = before

    def getSuccessMetricsAsJson(self, *_: Any) -> None:
        raise AttributeError("Call load() before reading the metrics")

    getSuccessMetricsAsDataFrame = getSuccessMetricsAsJson

    def save(self, key: ResultKey, context: Any) -> None:
        """Add the context's metrics to those of the key."""
        date, tags = key.identity()
        now = stamp()
        self.add([Saved(now, date, tags, a.key, tuple(StoredMetric(date, tags, a.key, m.entity, m.instance, m.name, m.value) for m in a.rows(outcome.value)),
                        json.dumps(typed(outcome.value))) for a, outcome in context.outcomes.items() if outcome.ok])


class InMemoryMetricsRepository(MetricsRepository):
    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._records: dict[tuple, Saved] = {}

    def records(self) -> list[Saved]:
        return list(self._records.values())

    def add(self, records: list[Saved]) -> None:
        self._records |= {r.identity: r for r in records}


#: A line of a history: a metric row of an analyzer, or its value in serial form under no name.
LINE = "saved string, dataset_date long, tags array<array<string>>, analyzer string, entity string, instance string, name string, value double, typed string"


class FileSystemMetricsRepository(MetricsRepository):
    """A folder with a file of JSON lines for each save, in any file system that Spark reaches.

    A save adds a file, which is there whole or not at all, so writers at the same time keep each other's rows; readers merge, and the
    newest save of an analyzer for a key counts. Many files are compacted into one. A path without a scheme lies in Hadoop's default
    file system. A single file of JSON lines, as older versions wrote, is read too; saves then go to a folder beside it.
    """

    #: Files from which on a save compacts the history.
    COMPACT_AT = 64

    def __init__(self, spark: SparkSession, path: str | None = None):
        super().__init__(spark)
        self.path = (path or self.helper_metrics_file(spark)).rstrip("/")
        self.files = Files(spark, self.path)
        self.seed = self.path if self.files.is_file(self.path) else None
        self.folder = self.path if self.seed is None else f"{self.path}.saves"

    @staticmethod
    def helper_metrics_file(spark: SparkSession, filename: str = "metrics.json") -> str:
        """A new path for metrics, in the folder that the cluster shares if it names one."""
        shared = spark.conf.get("spark.checkpoint.dir", None)
        return f"{shared.rstrip('/')}/metrics-{stamp()}/{filename}" if shared else os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), filename)

    def _saves(self) -> list[str]:
        return [f"{self.folder}/{n}" for n in self.files.names(self.folder) if not n.startswith((".", "_"))]

    def table(self) -> DataFrame:
        """Lines of the newest save of each analyzer and key, as a table; nothing passes through the driver."""
        paths = self._saves() + ([self.seed] if self.seed else [])
        lines = self.spark.read.schema(LINE).json(paths) if paths else self.spark.createDataFrame([], LINE)
        saved = F.coalesce("saved", F.lit(""))
        newest = F.max(saved).over(Window.partitionBy("dataset_date", "tags", "analyzer"))
        return lines.withColumn("newest", newest).where(saved == F.col("newest")).drop("newest").distinct()

    def records(self) -> list[Saved]:
        for attempt in range(5):
            try:
                rows = self.table().collect()  # a history of metrics, not data
                break
            except Exception as e:  # a file went into a compacted one meanwhile
                if attempt == 4 or "FILE_NOT_EXIST" not in str(e) and "FileNotFound" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                    raise
        found: dict[tuple, list] = {}
        for r in rows:
            found.setdefault((r["saved"] or "", r["dataset_date"], tuple((k, v) for k, v in r["tags"]), r["analyzer"]), []).append(r)
        return [Saved(saved, date, tags, analyzer,
                      tuple(StoredMetric(date, tags, analyzer, r["entity"], r["instance"], r["name"], r["value"]) for r in those if r["name"] is not None),
                      next((r["typed"] for r in those if r["typed"] is not None), None))
                for (saved, date, tags, analyzer), those in found.items()]

    def add(self, records: list[Saved]) -> None:
        lines = []
        for r in records:
            head = {"saved": r.saved, "dataset_date": r.dataset_date, "tags": [list(t) for t in r.tags], "analyzer": r.analyzer}
            lines += [json.dumps(head | {"entity": m.entity, "instance": m.instance, "name": m.name, "value": m.value}) for m in r.metrics]
            lines.append(json.dumps(head | {"typed": r.value}))
        if lines:
            self.files.write(f"{self.folder}/{stamp()}.json", "\n".join(lines).encode())
            if len(self._saves()) >= self.COMPACT_AT:
                self.compact()

    def compact(self) -> None:
        """One file with the newest saves in place of all files that are there now.

        The new file is in place before the others go; lines keep the time of their save, so compacting twice at once loses nothing.
        """
        merged = self._saves()
        if len(merged) < 2:
            return
        half = f"{self.folder}/.{stamp()}"
        kept = self.table()
        kept.select(F.to_json(F.struct(*[c.split()[0] for c in LINE.split(", ")]))).coalesce(1).write.text(half)
        part = next(n for n in self.files.names(half) if n.startswith("part-"))
        if not self.files.system.rename(self.files.place(f"{half}/{part}"), self.files.place(f"{self.folder}/{stamp()}.json")):
            raise OSError(f"{half} cannot be renamed")
        for path in [*merged, half]:
            self.files.delete(path)


def metrics_table(repository: MetricsRepository) -> DataFrame:
    """The whole history as a table, with a column of tags."""
    if isinstance(repository, FileSystemMetricsRepository):
        lines = repository.table().where("name is not null")
        return lines.select("dataset_date", F.map_from_entries(F.transform("tags", lambda t: F.struct(t[0], t[1]))).alias("tags"), "analyzer", "entity", "instance",
                            "name", "value")
    rows = [(m.dataset_date, dict(m.tags), m.analyzer, m.entity, m.instance, m.name, m.value) for m in repository.stored()]
    return repository.spark.createDataFrame(rows, "dataset_date long, tags map<string, string>, analyzer string, entity string, instance string, name string, value double")
