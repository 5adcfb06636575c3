"""Small pieces that several operators share: shared folders, saved tables, checked joins."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a side that is broadcast.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in
    tests on one machine, a fresh temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    rows that several later jobs use are computed once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a saved table of numbers take at most ``limit`` bytes; counted in its footers.

    A row takes 8 bytes a column, and 8 for what Spark keeps beside it.
    """
    most = limit // (8 * len(table.columns) + 8)
    return table.limit(most + 1).count() <= most


def with_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join left with a saved table of numbers.

    The right side is broadcast only up to ``limit`` bytes; beyond it Spark shuffles both
    sides and may split skewed partitions.
    """
    return left.join(F.broadcast(right) if is_small(right, limit) else right, on, how)


def range_bucket(value: Column, bounds: Sequence[int]) -> Column:
    """Index of the last of the ascending ``bounds`` that is <= value, at least 0.

    Two levels of arrays, so that a row compares with about 2 * sqrt(n) bounds.
    """
    bounds = sorted(set(bounds))
    if len(bounds) <= 1:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(int(x)) for x in bounds[::step]])
    parts = F.array(*[F.array(*[F.lit(int(x)) for x in bounds[i:i + step]])
                      for i in range(0, len(bounds), step)])
    count = lambda a: F.size(F.filter(a, lambda b: b <= value))
    coarse = F.greatest(count(heads), F.lit(1))
    fine = F.greatest(count(F.element_at(parts, coarse)), F.lit(1))
    return F.when(value.isNull(), F.lit(0)).otherwise((coarse - 1) * step + fine - 1)


def bucket_of(value: int | None, bounds: Sequence[int]) -> int:
    """What range_bucket gives, for one value; tests hold the two against each other."""
    bounds = sorted(set(bounds))
    if value is None or not bounds:
        return 0
    at = bisect_left(bounds, value)
    return max(0, at if at < len(bounds) and bounds[at] == value else at - 1)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt out evenly; others as they are.

    For work that takes long per row; such a scan is small, so its shuffle is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
