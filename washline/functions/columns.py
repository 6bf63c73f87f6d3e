"""Which columns an operator may touch, by Spark type, and type-safe conversions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions.names import quoted

_EPOCH = "1970-01-01 00:00:00"


def of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return of_type(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return of_type(df, T.StringType)


def boolean_columns(df: DataFrame) -> list[str]:
    return of_type(df, T.BooleanType)


def datetime_columns(df: DataFrame) -> list[str]:
    return of_type(df, T.TimestampType, T.TimestampNTZType, T.DateType)


def typed_columns(df: DataFrame) -> list[str]:
    """Numeric, boolean and datetime columns: those that count as standardised."""
    return [*numeric_columns(df), *boolean_columns(df), *datetime_columns(df)]


def missing_as_null(df: DataFrame) -> DataFrame:
    """One kind of missing: NaN becomes NULL, and an untyped column becomes text."""

    def adapt(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        if isinstance(field.dataType, T.NullType):
            return c.cast("string").alias(field.name)
        return c

    kinds = (T.DoubleType, T.FloatType, T.NullType)
    if not any(isinstance(f.dataType, kinds) for f in df.schema.fields):
        return df
    return df.select(*(adapt(f) for f in df.schema.fields))


def as_double(c: Column) -> Column:
    """Double value of a number, NULL for NaN."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def as_micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970 of a date or timestamp, the same in every session zone."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def datetime_literal(micros: int, dtype: T.DataType) -> Column:
    """The date or timestamp that lies ``micros`` after 1970."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(int(micros)))
    moment = datetime(1970, 1, 1) + timedelta(microseconds=int(micros))
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz").cast(dtype)


def has_map(dtype: T.DataType) -> bool:
    """Whether values of the type hold maps, which Spark can neither order nor hash."""
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return False
