"""Document fingerprints: bottom-k sketches of word-shingle hashes.

The sketch of a text is the k smallest distinct 64-bit hashes of its shingles. The sketch
of a union of texts is the k smallest of the union of their sketches, so sketches merge
across parts, and any two estimate resemblance, containment and distinct shingle counts.

Defined results: a null text counts as empty; an empty text has an empty fingerprint; two
empty fingerprints resemble each other by 1, an empty and another by 0. Repeated rows and
repeated ids each get their own row. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, range_bucket
from .shingles import SLICE_BYTES, WIDTH, shingles, slices

K = 128
SPACE = 2.0**64


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sketch of each text, in order."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    for a, b in slices(sizes):
        hashes, at = shingles(texts.slice(a, b - a), width)
        for i in range(b - a):
            found = np.unique(hashes[at[i]:at[i + 1]])
            yield found[:k]


def encode(sketch: np.ndarray) -> str:
    """The hashes, big-endian and ascending, in URL-safe base64."""
    return base64.urlsafe_b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.urlsafe_b64decode(text), dtype=">u8").astype(np.uint64)


def merge(many: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    parts = list(many)
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest of the union that both have; exact if both sketches are whole sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    # In the sorted multiset, the first k distinct values of the union: those up to the cut.
    new = np.concatenate([[True], ~twice])
    if new.sum() > k:
        cut = both[np.flatnonzero(new)[k - 1]]
        return float(np.count_nonzero(twice & (both[1:] <= cut))) / k
    return float(np.count_nonzero(twice)) / int(new.sum())


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest as a fraction."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / ((float(sketch[k - 1]) + 1) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too: |A and B| / |A|."""
    size = distinct_count(a, k)
    if not size:
        return 1.0
    union = distinct_count(merge([a, b], k), k)
    return float(min(1.0, resemblance(a, b, k) * union / size))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                width: int = WIDTH) -> DataFrame:
    """(id, fingerprint, n_distinct) of each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sketches(batch.column(1), k, width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(encode, found), pa.string()),
                 pa.array([distinct_count(x, k) for x in found], pa.float64())],
                names=["id", "fingerprint", "n_distinct"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"id {kind}, fingerprint string, n_distinct double")
    return out.withColumnRenamed("id", id_col)


def merge_fingerprints(parts: DataFrame, by: str, k: int = K, salts: int = 32) -> DataFrame:
    """(by, fingerprint, n_distinct) of the union of each group's texts.

    Sketches merge in two steps, per (group, salt) and then per group, and each task keeps
    at most one growing sketch in memory, so one group may hold any share of the rows.
    """
    kind = parts.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, None
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if have is None or not key.equals(now):
                    if have is not None:
                        yield row(now, have)
                    now, have = key, np.zeros(0, np.uint64)
                have = merge([have, decode(text or "")], k)
        if have is not None:
            yield row(now, have)

    def row(key: pa.Scalar, sketch: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key.as_py()], key.type), pa.array([encode(sketch)]),
             pa.array([distinct_count(sketch, k)], pa.float64())], names=["k", "fingerprint", "n_distinct"])

    form = f"k {kind}, fingerprint string, n_distinct double"
    rows = parts.select(F.col(by).alias("k"), "fingerprint")
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
              .repartition("k", "salt").sortWithinPartitions("k").select("k", "fingerprint"))
    once = salted.mapInArrow(run, form).select("k", "fingerprint")
    return once.repartition("k").sortWithinPartitions("k").mapInArrow(run, form).withColumnRenamed("k", by)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to the next text.

    The edited text replaces the last floor(n/2) code points by the first as many (or all)
    of the next row's text in ascending id order; after the last row comes the first.
    Rows are cut into ranges of ids whose bounds are ids of the data. The first row of a
    range is also sent to the range before it, so texts move in one shuffle and each task
    gets one range. Null ids come first; ties are ordered by text.
    """
    spark = docs.sparkSession
    ranges = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = rows.agg(
        F.percentile_approx("id", [i / ranges for i in range(ranges)], 100 * ranges).alias("bounds"),
        F.count_if(F.col("id").isNull()).alias("nulls")).first()
    bounds = sorted(set(found["bounds"] or [0]))
    last = len(bounds) - 1
    at: Column = range_bucket(F.col("id"), bounds)
    first_of_all = F.col("id").isNull() if found["nulls"] else F.col("id") == F.lit(bounds[0])
    starts = F.col("id").isin(bounds[1:]) if last else F.lit(False)
    before = F.when(first_of_all, F.lit(last)).when(starts, F.col("part") - 1)
    rows = rows.withColumn("part", at).withColumn("before", before)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("before").isNull(), F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))))
    rows = rows.select(F.when(F.col("copy") == 0, F.col("part")).otherwise(F.col("before")).cast("int").alias("part"),
                       F.col("copy").cast("int").alias("copy"), "id", "t")
    rows = rows.repartitionById(ranges, "part").sortWithinPartitions("part", "copy", F.asc_nulls_first("id"), "t")

    def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
        n = len(ids)
        edited = [t[:len(t) - len(t) // 2] + texts[i + 1][:len(t) // 2] for i, t in enumerate(texts[:n])]
        own = list(sketches(pa.array(texts, pa.large_string()), k, width))
        new = list(sketches(pa.array(edited, pa.large_string()), k, width))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([encode(x) for x in own[:n]]), pa.array([encode(x) for x in new]),
            pa.array([resemblance(own[i], new[i], k) for i in range(n)], pa.float64()),
            pa.array([resemblance(own[i], own[i + 1], k) for i in range(n)], pa.float64()),
        ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        part = halo = None
        for batch in batches:
            for p, c, i, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c == 1:
                    if halo != p and texts and part == p:
                        yield flush(ids, [*texts, t])
                    if halo != p:
                        ids, texts, size = [], [], 0
                    halo = p
                    continue
                if size > SLICE_BYTES:
                    yield flush(ids, [*texts, t])
                    ids, texts, size = [], [], 0
                part = p
                ids.append(i)
                texts.append(t)
                size += len(t)

    return rows.mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double").withColumnRenamed("id", id_col)
