"""pandas tables as inputs."""

from __future__ import annotations

import warnings
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Spark types of pandas types; all others become text.
KINDS = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
         "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "datetime64[ns]": T.TimestampNTZType(), "datetime64[ms]": T.TimestampNTZType(), "datetime64[s]": T.TimestampNTZType(),
         "datetime64[us]": T.TimestampNTZType()}


def schema_of(table: pd.DataFrame) -> T.StructType:
    return T.StructType([T.StructField(str(c), KINDS.get(str(k), T.StringType())) for c, k in table.dtypes.items()])


def arrow_column(values: pd.Series, kind: T.DataType) -> pa.Array:
    """The column with a validity of its own: NaN of a float column is a value, None is null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return pa.array(values.to_numpy(), from_pandas=False)
    if isinstance(kind, T.TimestampNTZType):
        return pa.array(values.to_numpy().astype("datetime64[us]"), pa.timestamp("us"), from_pandas=False)
    if isinstance(kind, T.StringType):
        return pa.array([None if v is None or v is pd.NA or v is pd.NaT else v if isinstance(v, str) else str(v) for v in values], pa.string())
    return pa.array(values.to_numpy(), from_pandas=False)


def from_pandas(spark: SparkSession, table: pd.DataFrame) -> DataFrame:
    """A Spark table of the same rows, column by column through Arrow; NaN stays NaN, None becomes null."""
    schema = schema_of(table)
    columns = [arrow_column(table.iloc[:, i], f.dataType) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def to_pandas(df: DataFrame) -> pd.DataFrame:
    return df.toPandas()


def ensure_spark(spark: SparkSession, data: Any) -> DataFrame:
    """data itself, or a Spark table of a pandas table."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        warnings.warn("A pandas DataFrame was given; it is converted to a Spark DataFrame", stacklevel=3)
        return from_pandas(spark, data)
    raise TypeError(f"A Spark or pandas DataFrame is needed, not {type(data).__name__}")


def need_session(spark: Any) -> SparkSession:
    if not isinstance(spark, SparkSession):
        raise TypeError(f"A SparkSession is needed, not {type(spark).__name__}")
    return spark
