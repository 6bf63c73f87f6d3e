"""Data-quality profile of a table: types, gaps, small cardinalities, numeric statistics."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions.columns import as_double, missing_as_null, numeric_columns
from washline.functions.names import quoted
from washline.operators.columns import sample_rows
from washline.operators.missing import present_counts
from washline.operators.statistics import (
    Moments,
    column_facts,
    distinct_estimates,
    moments,
    quantiles,
    stacked,
)

# Fixed value: cardinalities above this are not reported.
SMALL_CARDINALITY = 50

# The estimate is off by a few percent, so this screen cannot lose a reportable column.
_SCREEN = 4 * SMALL_CARDINALITY

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def table_schema(df: DataFrame) -> DataFrame:
    """Column names and types, one row each."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "column string, dtype string",
    )


@dataclass(frozen=True)
class _Facts:
    """What one pass over the table tells about all columns."""

    rows: int
    present: dict[str, int]
    estimates: dict[str, int]
    moments: dict[str, Moments]


def _facts(df: DataFrame) -> _Facts:
    rows = missing_as_null(df)
    plain = {f.name for f in rows.schema.fields if not isinstance(f.dataType, _NESTED)}
    # A hash stands for the value: the sketch only needs equal values to look equal.
    hashes = {
        c: F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c)) if c in plain else F.lit(1).cast("long"))
        for c in rows.columns
    }
    numbers = {c: as_double(quoted(c)) for c in numeric_columns(df)}
    return _Facts(*column_facts(rows, hashes, numbers))


def _percentages(facts: _Facts) -> dict[str, float]:
    n = facts.rows
    return {c: 100.0 * (n - k) / n if n else float("nan") for c, k in facts.present.items()}


def missing_percentages(df: DataFrame) -> dict[str, float]:
    rows, present = present_counts(df)
    return {c: 100.0 * (rows - n) / rows if rows else float("nan") for c, n in present.items()}


def small_cardinalities(df: DataFrame, estimates: Mapping[str, int] | None = None) -> dict[str, int]:
    """Different non-missing values of every column that has at most 50 of them.

    A sketch screens all columns in one pass; only the few-valued ones are counted exactly,
    so the distinct (column, value) pairs stay few.
    """
    df = missing_as_null(df)
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]
    if not names:
        return {}
    if estimates is None:
        # A hash stands for the value: the sketch only needs equal values to look equal.
        hashed = {c: F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c))) for c in names}
        estimates = distinct_estimates(df, hashed)
    few = [c for c in names if estimates[c] <= _SCREEN]
    if not few:
        return {}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    texts = {c: _identity(quoted(c), dtypes[c]).cast("string") for c in few}
    exact = stacked(df, texts).distinct().groupBy("col").count()
    counts = {**dict.fromkeys(few, 0), **{few[row.col]: row["count"] for row in exact.collect()}}
    return {c: n for c, n in counts.items() if n <= SMALL_CARDINALITY}


def _identity(c: Column, dtype: T.DataType) -> Column:
    # Adding zero makes 0.0 of -0.0, which is the same number under another name.
    return c + F.lit(0.0) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c


def numeric_statistics(
    df: DataFrame, *, accuracy: int | None = None, known: Mapping[str, Moments] | None = None
) -> dict[str, dict]:
    """Mean, deviation, extremes and median of every numeric column."""
    names = numeric_columns(df)
    values = {c: as_double(quoted(c)) for c in names}
    stats = moments(df, values) if known is None else known
    medians = quantiles(
        df, {c: (0.5,) for c in names}, columns=values, known=stats, accuracy=accuracy
    )
    return {
        c: {
            "mean": stats[c].mean,
            "std": stats[c].std,
            "min": stats[c].low,
            "max": stats[c].high,
            "median": medians.get(c, {}).get(0.5),
        }
        for c in names
    }


def profile_missing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(missing_percentages(df).items()), "column string, missing_pct double"
    )


def profile_cardinality(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(c, int(n)) for c, n in small_cardinalities(df).items()],
        "column string, n_distinct bigint",
    )


def profile_numeric(df: DataFrame, *, accuracy: int | None = None) -> DataFrame:
    rows = [(c, *s.values()) for c, s in numeric_statistics(df, accuracy=accuracy).items()]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, mean double, std double, min double, max double, median double",
    )


def profile_table(df: DataFrame, *, accuracy: int | None = None) -> DataFrame:
    """One row per column with everything known about it."""
    facts = _facts(df)
    gaps = _percentages(facts)
    counts = small_cardinalities(df, facts.estimates)
    stats = numeric_statistics(df, accuracy=accuracy, known=facts.moments)
    rows = []
    for f in df.schema.fields:
        numbers = tuple(stats[f.name].values()) if f.name in stats else (None,) * 5
        distinct = counts.get(f.name)
        rows.append(
            (
                f.name,
                f.dataType.simpleString(),
                gaps[f.name],
                None if distinct is None else int(distinct),
                *numbers,
            )
        )
    return df.sparkSession.createDataFrame(
        rows,
        "column string, dtype string, missing_pct double, n_distinct bigint, mean double,"
        " std double, min double, max double, median double",
    )


def profile_document(
    df: DataFrame,
    summary: Mapping[str, object],
    dataset_kind: str | None = None,
    order_key: str | None = None,
) -> DataFrame:
    """The profile, the run summary and the sample rows as one JSON document."""
    facts = _facts(df)
    document = {
        "dataset_kind": dataset_kind or "unknown",
        "summary": dict(summary),
        "schema": [{"name": f.name, "dtype": f.dataType.simpleString()} for f in df.schema.fields],
        "missing_pct": _percentages(facts),
        "small_cardinality": small_cardinalities(df, facts.estimates),
        "numeric_stats": numeric_statistics(df, known=facts.moments),
        "sample_rows": [row.asDict() for row in sample_rows(df, order_key).collect()],  # 50 rows
    }
    text = json.dumps(document, default=str, ensure_ascii=False)
    return df.sparkSession.createDataFrame([(text,)], "profile string")
