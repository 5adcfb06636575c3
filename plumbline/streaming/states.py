"""Mergeable states of metrics: one table per part of the data, merged without the data.

A state row holds, for one column, counts, sums, extremes and a distinct-count sketch.
States of parts (days, partitions, batches) merge to the state of the whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import is_nested, is_numeric
from ..operators.analyzers import col


def states(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, rows, filled, total, mean, m2, low, high, sketch), a row per column, from one scan.

    m2 is the sum of squared distances from the mean, which keeps its digits where a sum of squares loses them.
    """
    columns = list(columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        number = col(c).cast("double") if is_numeric(kind) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_nested(kind) else col(c).cast("string")
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(col(c)).alias("filled"), F.sum(number).alias("total"),
            F.avg(number).alias("mean"), (F.var_pop(number) * F.count(number)).alias("m2"), F.min(number).alias("low"), F.max(number).alias("high"),
            F.hll_sketch_agg(text).alias("sketch")).alias(f"s{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")


def merge(parts: Iterable[DataFrame]) -> DataFrame:
    """The states of the union of the parts."""
    every = reduce(DataFrame.unionByName, parts)
    own = Window.partitionBy("column")  # one row for each part
    mean = F.try_divide(F.sum(F.col("mean") * F.col("filled")).over(own), F.sum(F.when(F.col("mean").isNotNull(), F.col("filled"))).over(own))
    every = every.withColumn("whole", mean)
    apart = F.col("m2") + F.col("filled") * (F.col("mean") - F.col("whole")) ** 2
    return every.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.sum("total").alias("total"), F.first("whole").alias("mean"), F.sum(apart).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("sketch").alias("sketch"))


def metrics(merged: DataFrame) -> DataFrame:
    """(entity, instance, name, value) from states."""
    mean = F.try_divide("total", "filled")
    sd = F.sqrt(F.try_divide("m2", "filled"))
    pairs = {"Completeness": F.try_divide("filled", "rows"), "Sum": F.col("total"), "Mean": mean, "StandardDeviation": sd,
             "Minimum": F.col("low"), "Maximum": F.col("high"), "ApproxCountDistinct": F.hll_sketch_estimate("sketch").cast("double")}
    rows = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in pairs.items()])
    return merged.select(F.lit("Column").alias("entity"), F.col("column").alias("instance"), F.explode(rows).alias("m")).select(
        "entity", "instance", "m.name", "m.value").where("value is not null")
