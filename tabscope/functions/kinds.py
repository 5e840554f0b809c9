"""Column kinds and missing-value normalisation.

Numeric  = integral, floating and decimal types (booleans are neither numeric
nor categorical; timestamps/dates are profiled for nulls and types only).
Categorical = strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_categorical(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f.dataType)]


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]


def kind_of(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "numeric"
    if is_categorical(dt):
        return "categorical"
    return "other"


def type_name(dt: T.DataType) -> str:
    """Stable, engine-neutral type label used in reports."""
    return dt.simpleString()


def nan_to_null(c: Column) -> Column:
    """NaN is a value in Spark but 'missing' in the reference: map it to NULL."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def normalize_nan(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in floating columns (one narrow projection)."""
    targets = set(cols if cols is not None else floating_columns(df))
    flo = set(floating_columns(df))
    return df.select(*[
        nan_to_null(F.col(f.name)).cast(f.dataType).alias(f.name)
        if f.name in targets and f.name in flo else F.col(f.name)
        for f in df.schema.fields
    ])


def as_double(c: str) -> Column:
    return F.col(c).cast("double")


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))
