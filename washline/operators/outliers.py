"""Outliers: bounds from one fused statistics pass, then a cap or a row filter."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.errors import InvalidInputError
from washline.functions.columns import as_double, missing_as_null, numeric_columns
from washline.functions.names import quoted
from washline.operators.columns import replace_columns
from washline.operators.statistics import Moments, moments, quantiles
from washline.staging import stage

# Fixed values.
METHODS = ("cap", "remove", None)
SKEW_FOR_IQR = 0.5
IQR_FACTOR = 1.5
STD_FACTOR = 3


@dataclass(frozen=True)
class Bounds:
    """Accepted closed range of a column and the rule it comes from."""

    low: float
    high: float
    method: str


def choose_method(stats: Moments, auto_detect: bool = True) -> str:
    """``IQR`` for skewed columns, ``Z-score`` for others; always ``IQR`` without auto."""
    if not auto_detect:
        return "IQR"
    return "IQR" if stats.skew is not None and abs(stats.skew) > SKEW_FOR_IQR else "Z-score"


def needs_quartiles(stats: Moments, auto_detect: bool = True) -> bool:
    return stats.varies and choose_method(stats, auto_detect) == "IQR"


def bounds_of(
    stats: Moments, quartiles: Mapping[float, float] | None, auto_detect: bool = True
) -> Bounds | None:
    """Bounds of one column, or None where the rule has nothing to say."""
    if not stats.varies:
        return None
    method = choose_method(stats, auto_detect)
    if method == "IQR":
        q1, q3 = quartiles[0.25], quartiles[0.75]
        margin = IQR_FACTOR * (q3 - q1)
        low, high = q1 - margin, q3 + margin
    else:
        margin = STD_FACTOR * stats.std
        low, high = stats.mean - margin, stats.mean + margin
    if margin == 0 or math.isnan(low) or math.isnan(high):
        return None
    return Bounds(low, high, method)


def has_outliers(stats: Moments, bounds: Bounds | None) -> bool:
    """Whether any value lies outside, told from the column's range alone."""
    return bounds is not None and (stats.low < bounds.low or stats.high > bounds.high)


def fit_bounds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    auto_detect: bool = True,
    accuracy: int | None = None,
    known: Mapping[str, Moments] | None = None,
) -> tuple[dict[str, Bounds | None], dict[str, Moments]]:
    """Bounds of each column, all computed on the same rows. Also returns the moments."""
    columns = list(numeric_columns(df) if columns is None else columns)
    if known is None:
        known = moments(df, columns)
    quartiles = quantiles(
        df,
        {c: (0.25, 0.75) for c in columns if needs_quartiles(known[c], auto_detect)},
        known=known,
        accuracy=accuracy,
    )
    return {c: bounds_of(known[c], quartiles.get(c), auto_detect) for c in columns}, dict(known)


def outside(c: Column, bounds: Bounds) -> Column:
    """True for values beyond the bounds, False for missing ones."""
    value = as_double(c)
    return F.coalesce((value < bounds.low) | (value > bounds.high), F.lit(False))


def capped_type(dtype: T.DataType, bounds: Bounds) -> T.DataType:
    """Decimals stay; whole-number columns stay whole only if both bounds are whole numbers."""
    whole = bounds.low.is_integer() and bounds.high.is_integer()
    keeps = isinstance(dtype, (T.DoubleType, T.DecimalType)) or (isinstance(dtype, T.IntegralType) and whole)
    return dtype if keeps else T.DoubleType()


def cap_expression(c: Column, dtype: T.DataType, bounds: Bounds) -> Column:
    """Value limited to the bounds. Missing stays missing: no comparison holds for it."""
    target = capped_type(dtype, bounds)
    low, high = (F.lit(float(b)) for b in (bounds.low, bounds.high))
    value = c.cast(target)
    # A bound beyond the type's range limits nothing.
    return (
        F.when(c.cast("double") < low, F.coalesce(low.try_cast(target), value))
        .when(c.cast("double") > high, F.coalesce(high.try_cast(target), value))
        .otherwise(value)
    )


def apply_caps(df: DataFrame, bounds: Mapping[str, Bounds]) -> DataFrame:
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return replace_columns(
        df, {c: cap_expression(quoted(c), dtypes[c], b) for c, b in bounds.items()}
    )


def apply_ranges(df: DataFrame, bounds: Mapping[str, Bounds]) -> DataFrame:
    """Keep rows inside every range; rows with a missing value stay."""
    for c, b in bounds.items():
        df = df.where(~outside(quoted(c), b))
    return df


def fit_caps(
    df: DataFrame, *, auto_detect: bool = True, accuracy: int | None = None
) -> dict[str, Bounds]:
    """Bounds of the columns that hold outliers."""
    bounds, known = fit_bounds(df, auto_detect=auto_detect, accuracy=accuracy)
    return {c: b for c, b in bounds.items() if has_outliers(known[c], b)}


def fit_ranges(
    df: DataFrame,
    *,
    auto_detect: bool = True,
    accuracy: int | None = None,
    known: Mapping[str, Moments] | None = None,
) -> dict[str, Bounds]:
    """Ranges for row removal, in column order, each on the rows the earlier ones left."""
    ranges, removing = fit_all_ranges(df, auto_detect=auto_detect, accuracy=accuracy, known=known)
    return {c: ranges[c] for c in removing}


def fit_all_ranges(
    df: DataFrame,
    *,
    auto_detect: bool = True,
    accuracy: int | None = None,
    known: Mapping[str, Moments] | None = None,
) -> tuple[dict[str, Bounds], list[str]]:
    """Ranges of all columns that have some, and the columns whose range removes rows of ``df``.

    All waiting columns are measured together. Columns without outliers leave the rows as
    they are, so the measurement is repeated only after a column that does remove rows.
    """
    waiting = numeric_columns(df)
    ranges: dict[str, Bounds] = {}
    removing: list[str] = []
    rows = df
    staged = False
    while waiting:
        bounds, stats = fit_bounds(
            rows, waiting, auto_detect=auto_detect, accuracy=accuracy, known=known
        )
        known = None
        first = next((c for c in waiting if has_outliers(stats[c], bounds[c])), None)
        settled = waiting if first is None else waiting[: waiting.index(first) + 1]
        ranges.update({c: bounds[c] for c in settled if bounds[c] is not None})
        if first is None:
            break
        removing.append(first)
        rows = apply_ranges(rows, {first: bounds[first]})
        waiting = waiting[len(settled) :]
        if waiting and not staged:
            # The rounds that follow read numbers only, not the source.
            rows, staged = stage(rows.select(*(quoted(c) for c in waiting))), True
    return ranges, removing


def handle_outliers(
    df: DataFrame,
    method: str | None = "cap",
    auto_detect: bool = True,
    *,
    accuracy: int | None = None,
) -> DataFrame:
    """Cap values at the bounds, or remove rows beyond them, in all numeric columns.

    ``accuracy`` replaces exact quartiles by ``percentile_approx`` of that accuracy.
    """
    if method not in METHODS:
        raise InvalidInputError(f"unknown outlier method {method!r}; choose from {METHODS}")
    df = missing_as_null(df)
    if method == "cap":
        return apply_caps(df, fit_caps(df, auto_detect=auto_detect, accuracy=accuracy))
    if method == "remove":
        return apply_ranges(df, fit_ranges(df, auto_detect=auto_detect, accuracy=accuracy))
    return df


def outlier_report(df: DataFrame, *, auto_detect: bool = True) -> DataFrame:
    """Per numeric column: rule, bounds and number of values outside (same rows for all)."""
    df = missing_as_null(df)
    bounds, stats = fit_bounds(df, auto_detect=auto_detect)
    named = list(bounds)
    counts = df.agg(
        *(
            (F.count_if(outside(quoted(c), bounds[c])) if bounds[c] else F.lit(0).cast("long")).alias(
                f"o{i}"
            )
            for i, c in enumerate(named)
        )
    ).first() if named else ()
    rows = [
        (
            c,
            choose_method(stats[c], auto_detect) if stats[c].varies else None,
            stats[c].skew,
            b.low if b else None,
            b.high if b else None,
            counts[i],
        )
        for i, (c, b) in enumerate(bounds.items())
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, method string, skew double, low double, high double, outliers bigint",
    )
