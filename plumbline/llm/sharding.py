"""Two-pass external shuffle into shards.

Pass one scatters rows into memory-sized buckets by a seeded hash. Rows that repeat so often
that they would fill a bucket are written down with a number first, which then takes part in
the hash, so that they spread like others. Pass two draws a
Fisher-Yates permutation of each bucket, numbers its rows from the bucket's offset, and
writes them. The number of a row fixes its shard: shard s holds the numbers from
floor(s * n / shards), so row counts differ by at most one, and a bucket touches few
shards. The order depends on the seed and the rows only (and on those numbers), so a lost
executor's work repeats alike. Buckets' offsets are running sums in the plan.

Defined results: null texts and ids are kept and have their own hashes; repeated rows all
keep a place of their own; an empty table gives no rows. Extra columns go along; shard and
slot columns that the rows have already are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import saved, with_small

SHARDS = 24
#: A bucket must fit into a task's memory.
BUCKET_BYTES = 32_000_000
#: So many buckets of at least a megabyte, where fewer would do, so that tasks are even.
SPREAD = 256


def permutation(n: int, seed: int, bucket: int) -> np.ndarray:
    """Fisher-Yates: swap each place, from the last, with one drawn at or before it."""
    rng = np.random.default_rng([seed, bucket])
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else order
    for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7, id_col: str = "doc_id",
                   text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs in random order, with ``shard`` int and ``slot`` long (from 0, gapless in the shard)."""
    docs = docs.drop("shard", "slot")
    names = docs.columns
    own, offset, salt = (next(n for n in (base + "_" * i for i in range(len(names) + 1)) if n not in names)
                         for base in ("bucket", "offset", "salt"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 8
    repeated = docs.groupBy(F.xxhash64(id_col, text_col).alias(salt)).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    repeated = saved(repeated.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 4)), "repeated")  # few: their bytes are in the input
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes), min(SPREAD, total // 1_000_000))
    if repeated.isEmpty():
        keyed = docs.withColumn(salt, F.lit(0).cast("long"))
    else:
        marked = docs.withColumn(salt, F.xxhash64(id_col, text_col))
        often = saved(with_small(marked, repeated.select(salt), [salt], "left_semi").withColumn(salt, F.monotonically_increasing_id()), "often")
        rest = with_small(marked, repeated.select(salt), [salt], "left_anti")
        keyed = rest.select(*names, F.lit(0).cast("long").alias(salt)).unionByName(often.select(*names, salt))
    keyed = keyed.withColumn(own, F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(salt)), F.lit(buckets)).cast("int")).drop(salt)
    counts = saved(keyed.groupBy(own).agg(F.count(F.lit(1)).alias("rows")), "buckets")
    n = counts.agg(F.sum("rows")).first()[0] or 0
    keyed = with_small(keyed, offsets(counts, own, offset), [own])
    schema = StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    starts = np.array([s * n // shards for s in range(shards)], dtype=np.int64)
    return keyed.groupBy(own).applyInArrow(_placer(starts, seed, names, offset, names.index(id_col), names.index(text_col)), schema)


def offsets(counts: DataFrame, own: str, offset: str, together: int = 1024) -> DataFrame:
    """For each bucket, how many rows those of smaller numbers hold: sums within groups of buckets, after sums of groups."""
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = counts.withColumn("part", F.floor(F.col(own) / together))
    # One row for each 1024 buckets.
    parts = grouped.groupBy("part").agg(F.sum("rows").alias("rows")).select("part", before(Window.orderBy("part")).alias("base"))
    within = grouped.select(own, "part", before(Window.partitionBy("part").orderBy(own)).alias("at"))
    return saved(within.join(parts, "part").select(own, (F.col("base") + F.col("at")).alias(offset)), "offsets")


def _placer(starts: np.ndarray, seed: int, names: list[str], offset: str, by_id: int, by_text: int) -> Callable:
    def place(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, base = key[0].as_py(), rows.column(offset)[0].as_py()
        rows = rows.select(names)
        plain = pa.table({"i": rows.column(by_id), "t": rows.column(by_text)})
        order = pa.compute.sort_indices(plain, sort_keys=[("i", "ascending"), ("t", "ascending")])
        rows = rows.take(order.take(pa.array(permutation(len(rows), seed, bucket))))
        at = base + np.arange(len(rows), dtype=np.int64)
        shard = np.searchsorted(starts, at, side="right") - 1
        return rows.append_column("shard", pa.array(shard.astype(np.int32))).append_column(
            "slot", pa.array(at - starts[shard]))

    return place


def write_shards(docs: DataFrame, path: str, **options: object) -> None:
    """Write the shuffled rows under ``path``, a folder per shard, each file in slot order."""
    shuffle_shards(docs, **options).write.partitionBy("shard").parquet(path)
