"""Classes of column types and of values."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataTypeInstances(Enum):
    Boolean = "Boolean"
    Unknown = "Unknown"
    Fractional = "Fractional"
    Integral = "Integral"
    String = "String"


class ConstrainableDataTypes(Enum):
    Null = "Null"
    Fractional = "Fractional"
    Integral = "Integral"
    Boolean = "Boolean"
    String = "String"
    Numeric = "Numeric"


#: Order in which the classes of values are reported.
VALUE_CLASSES = ("Boolean", "Fractional", "Integral", "Unknown", "String")

BOOLEAN = r"^(true|false)$"
INTEGRAL = r"^[+-]?\d+$"
FRACTIONAL = r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"


def type_class(kind: T.DataType) -> str:
    """The class of a column's declared type."""
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integral"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Fractional"
    if isinstance(kind, T.StringType):
        return "String"
    return "Unknown"


def is_numeric(kind: T.DataType) -> bool:
    return type_class(kind) in ("Integral", "Fractional")


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def value_class(column: Column, kind: T.DataType) -> Column:
    """The class of each value; text is judged by its form, null is Unknown."""
    declared = type_class(kind)
    if declared in ("Boolean", "Integral", "Fractional"):
        return F.when(column.isNull(), "Unknown").otherwise(declared)
    if is_nested(kind):
        return F.lit("Unknown")
    text = column.cast("string")
    return (F.when(column.isNull(), "Unknown").when(text.rlike(BOOLEAN), "Boolean")
            .when(text.rlike(INTEGRAL), "Integral").when(text.rlike(FRACTIONAL), "Fractional").otherwise("String"))


def overall_class(counts: dict[str, int]) -> str:
    """One class for a column with so many values of each: the narrowest that holds them all."""
    numbers = counts.get("Integral", 0) + counts.get("Fractional", 0)
    truths = counts.get("Boolean", 0)
    if counts.get("String", 0) or (truths and numbers):
        return "String"
    if truths:
        return "Boolean"
    if numbers:
        return "Fractional" if counts.get("Fractional", 0) else "Integral"
    return "Unknown"
