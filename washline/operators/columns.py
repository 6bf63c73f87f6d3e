"""Column names, text columns, categorical values, and short views of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions import text as text_rules
from washline.functions.columns import of_type, text_columns
from washline.functions.names import normalize_name, quoted, unique_names

# A mapping up to this size becomes an expression; a larger one becomes a join.
INLINE_MAPPING = 200


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Rename to lower-case ASCII words joined by underscores, each name used once."""
    return df.toDF(*unique_names(normalize_name(c) for c in df.columns))


def decollide_column_names(df: DataFrame) -> DataFrame:
    """Keep names as they are but number those that differ only in case."""
    return df.toDF(*unique_names(df.columns, fold=str.lower))


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """One projection that replaces the columns in ``new`` and keeps all others."""
    if not new:
        return df
    return df.select(*(new[c].alias(c) if c in new else quoted(c) for c in df.columns))


def columns_with_non_ascii(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns that hold any non-ASCII cell, from one pass."""
    if not columns:
        return []
    row = df.agg(
        *(F.max(text_rules.has_non_ascii(quoted(c))).alias(f"u{i}") for i, c in enumerate(columns))
    ).first()
    return [c for c, found in zip(columns, row) if found]


def clean_text_columns(
    df: DataFrame,
    *,
    lowercase: bool = True,
    categorical_mapping: Mapping[str, Mapping[str, str | None]] | None = None,
    tokens_after_strip: bool = False,
    unicode: bool | Sequence[str] = True,
) -> DataFrame:
    """Clean every text column, then apply the categorical mapping.

    ``unicode`` may name the columns that need NFKC; the others stay free of Python.
    """
    names = text_columns(df)
    tidy = {
        c: text_rules.tidy_text(quoted(c), tokens_after_strip=tokens_after_strip) for c in names
    }
    df = replace_columns(df, tidy)
    # NFKC mentions its column more than once: as a step of its own it reads the tidy text.
    needs_nfkc = names if unicode is True else [c for c in names if c in (unicode or ())]
    df = replace_columns(df, {c: text_rules.nfkc(quoted(c)) for c in needs_nfkc})
    if lowercase:
        df = replace_columns(df, {c: F.lower(quoted(c)) for c in names})
    return normalize_categorical_text(df, categorical_mapping)


def mapped_type(dtype: T.DataType, values: Mapping[object, object]) -> T.DataType:
    """Type of a mapped column: its own if all new values fit it, else a wider number or text."""
    new = [v for v in values.values() if v is not None]
    if isinstance(dtype, T.StringType) or any(isinstance(v, str) for v in new):
        return T.StringType()
    if isinstance(dtype, T.BooleanType):
        return dtype if all(isinstance(v, bool) for v in new) else T.StringType()
    if isinstance(dtype, T.IntegralType):
        whole = all(isinstance(v, int) or float(v).is_integer() for v in new)
        return (dtype if _fits(dtype, new) else T.LongType()) if whole else T.DoubleType()
    return dtype if isinstance(dtype, (T.DoubleType, T.DecimalType)) else T.DoubleType()


def _fits(dtype: T.DataType, values: Sequence[object]) -> bool:
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
    return all(-(1 << bits) <= int(v) < 1 << bits for v in values)


def _mapping_table(df: DataFrame, column: str, values: Mapping[object, object]) -> tuple[list, T.DataType]:
    """(old, new) pairs as text whose old value is one of the column's type, and the new type."""
    dtype = df.schema[column].dataType
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return [(text(old), text(new)) for old, new in values.items() if old is not None], mapped_type(dtype, values)


def _mapping_expression(df: DataFrame, column: str, values: Mapping[object, object]) -> Column:
    pairs, target = _mapping_table(df, column, values)
    dtype, c = df.schema[column].dataType, quoted(column)
    if isinstance(dtype, T.StringType):
        table = F.create_map(*[F.lit(x) for pair in pairs for x in pair]).cast("map<string,string>")
        return F.when(F.map_contains_key(table, c), F.element_at(table, c)).otherwise(c)
    result = c.cast(target)
    for old, new in pairs:
        # A key that is no value of the type matches nothing.
        result = F.when(c == F.lit(old).try_cast(dtype), F.lit(new).try_cast(target)).otherwise(result)
    return result


def _mapping_join(df: DataFrame, column: str, values: Mapping[object, object]) -> DataFrame:
    """The dictionary as a table; Spark broadcasts it if its size in bytes allows."""
    pairs, target = _mapping_table(df, column, values)
    dtype = df.schema[column].dataType
    table = df.sparkSession.createDataFrame(
        [(*pair, True) for pair in pairs], "__old string, __new string, __hit boolean"
    ).select(
        F.col("__old").try_cast(dtype).alias("__old"), F.col("__new").try_cast(target).alias("__new"), "__hit"
    )
    joined = df.join(table, quoted(column) == F.col("__old"), "left")
    mapped = F.when(F.col("__hit"), F.col("__new")).otherwise(quoted(column).cast(target))
    return joined.select(*(mapped.alias(c) if c == column else quoted(c) for c in df.columns))


def normalize_categorical_text(
    df: DataFrame,
    mapping: Mapping[str, Mapping[object, object]] | None,
    *,
    inline_limit: int = INLINE_MAPPING,
) -> DataFrame:
    """Replace listed values column by column; other values and absent columns stay.

    Keys are values of the column, of any plain type: codes as well as text. A column becomes
    text, or a wider number, if a new value is none of its type.
    """
    if not mapping:
        return df
    plain = set(of_type(df, T.StringType, T.NumericType, T.BooleanType))
    present = {c: values for c, values in mapping.items() if c in plain and values}
    small = {c: v for c, v in present.items() if len(v) <= inline_limit}
    df = replace_columns(df, {c: _mapping_expression(df, c, v) for c, v in small.items()})
    for column, values in present.items():
        if column not in small:
            df = _mapping_join(df, column, values)
    return df


def as_cell_text(df: DataFrame, width: int) -> DataFrame:
    """All columns as text cut to ``width`` characters, NULL where missing."""

    def cell(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        return F.substring(c.cast("string"), 1, width).alias(field.name)

    return df.select(*(cell(f) for f in df.schema.fields))


def head_rows(df: DataFrame, n: int, width: int, order_key: str | None = None) -> DataFrame:
    """First ``n`` rows (by ``order_key`` if given) as short text cells.

    Rows are chosen before cells are cut, so only ``n`` rows are ever converted.
    """
    chosen = df.orderBy(quoted(order_key)).limit(n) if order_key else df.limit(n)
    return as_cell_text(chosen, width)


def preview_rows(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """Two rows with cells of at most 80 characters."""
    return head_rows(df, 2, 80, order_key)


def sample_rows(df: DataFrame, order_key: str | None = None) -> DataFrame:
    """Fifty rows with cells of at most 200 characters."""
    return head_rows(df, 50, 200, order_key)
