"""Missing values: one statistics pass, one fill value per column, one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions.columns import as_micros, datetime_literal, has_map, missing_as_null
from washline.functions.names import quoted
from washline.operators.columns import replace_columns
from washline.operators.frequent import sketched_modes
from washline.operators.statistics import Moments, modes, moments, quantiles
from washline.staging import stage

# Fixed values.
SKEW_FOR_MEDIAN = 0.75
REGULAR_SPACING = 0.2
REPEATED_SHARE = 0.3
UNKNOWN_TEXT = "Unknown"

_DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class Fill:
    """Fill value of one column. ``kind``: number, whole, datetime, boolean, text or forward."""

    kind: str
    value: object = None

    def expression(self, c: Column, dtype: T.DataType) -> Column:
        if self.kind == "number" and isinstance(dtype, T.DecimalType):
            # The column keeps its type; a value that does not fit leaves the gap.
            return F.coalesce(c, F.lit(float(self.value)).try_cast(dtype))
        if self.kind == "number":
            return F.coalesce(c.cast("double"), F.lit(float(self.value)))
        if self.kind == "whole":
            return F.coalesce(c, F.lit(int(self.value)).try_cast(dtype))
        if self.kind == "datetime":
            return F.coalesce(c, datetime_literal(self.value, dtype))
        return F.coalesce(c, F.lit(self.value))


def present_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and non-missing count of every column, from one pass."""
    row = missing_as_null(df).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(quoted(c)).alias(f"p{i}") for i, c in enumerate(df.columns)),
    ).first()
    return row[0], dict(zip(df.columns, row[1:]))


def missing_counts(df: DataFrame) -> DataFrame:
    """Per column ``missing`` cells, one row each."""
    rows, present = present_counts(df)
    return df.sparkSession.createDataFrame(
        [(c, rows - n) for c, n in present.items()], "column string, missing bigint"
    )


def choose_number(stats: Moments, median: float | None, strategy: str = "auto") -> float:
    """Mean, or the median for strongly skewed columns."""
    if not stats.n:
        return 0.0
    skewed = stats.skew is not None and abs(stats.skew) > SKEW_FOR_MEDIAN
    use_median = strategy == "median" or (strategy == "auto" and skewed)
    return median if use_median else stats.mean


def _median_needed(stats: Moments, strategy: str) -> bool:
    if not stats.n or strategy == "mean":
        return False
    return strategy == "median" or (stats.skew is not None and abs(stats.skew) > SKEW_FOR_MEDIAN)


def fit_numbers(
    df: DataFrame, columns: Sequence[str], strategy: str = "auto", accuracy: int | None = None
) -> dict[str, Fill]:
    stats = moments(df, columns)
    medians = quantiles(
        df,
        {c: (0.5,) for c in columns if _median_needed(stats[c], strategy)},
        known=stats,
        accuracy=accuracy,
    )
    return {
        c: Fill("number", choose_number(stats[c], medians.get(c, {}).get(0.5), strategy))
        for c in columns
    }


def fit_booleans(df: DataFrame, columns: Sequence[str]) -> dict[str, Fill]:
    """The more frequent value; False if there is none or a tie."""
    if not columns:
        return {}
    row = df.agg(
        *(
            (F.count_if(quoted(c)) > F.count_if(~quoted(c))).alias(f"b{i}")
            for i, c in enumerate(columns)
        )
    ).first()
    return {c: Fill("boolean", bool(value)) for c, value in zip(columns, row)}


def fit_texts(df: DataFrame, columns: Sequence[str], sketch: bool = False) -> dict[str, Fill]:
    """The most frequent text, the smallest of equals; ``Unknown`` for an empty column.

    ``sketch`` finds the same by two scans that shuffle little, for columns with many different texts.
    """
    found = sketched_modes(df, {c: quoted(c) for c in columns}) if sketch and columns else modes(df, columns)
    return {c: Fill("text", found.get(c, UNKNOWN_TEXT)) for c in columns}


# ------------------------------------------------------------------- datetimes


def _distinct_moments(distinct: DataFrame) -> tuple[int, int, float | None]:
    """Values, different values, and the spread of the gaps between sorted values.

    The different values are sorted range by range: each task sorts its own range, and only
    the ends of the ranges (one row per task) meet in one place.
    """
    ranged = stage(
        distinct.repartitionByRange("micros").withColumn("range", F.spark_partition_id())
    )
    within = Window.partitionBy("range").orderBy("micros")
    gaps = ranged.select((F.col("micros") - F.lag("micros").over(within)).alias("gap"))
    ends = ranged.groupBy("range").agg(F.min("micros").alias("first"), F.max("micros").alias("last"))
    across = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("first"))).alias("gap"))
    gap = F.col("gap").cast("double")
    sums = (
        gaps.unionAll(across)
        .agg(F.sum(gap).alias("total"), F.sum(gap * gap).alias("squares"))
        .first()
    )
    n, different = ranged.agg(F.sum("copies"), F.count("micros")).first()
    if n < 3:
        return n, different, None
    # Repeated values add gaps of length zero: they count, but add nothing to the sums.
    count = n - 1
    mean = (sums.total or 0.0) / count
    variance = max(((sums.squares or 0.0) - count * mean * mean) / (count - 1), 0.0)
    return n, different, (variance**0.5 / mean if mean else None)


def fit_datetime(
    df: DataFrame, column: str, strategy: str = "median", accuracy: int | None = None
) -> Fill:
    """Median; with ``auto`` forward fill for regular spacing, the mode for many repeats."""
    dtype = df.schema[column].dataType
    micros = as_micros(quoted(column), dtype)
    if strategy == "auto":
        distinct = (
            df.select(micros.alias("micros"))
            .where("micros is not null")
            .groupBy("micros")
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        n, different, spread = _distinct_moments(distinct)
        if n > 2:
            if spread is not None and spread < REGULAR_SPACING:
                return Fill("forward")
            if 1 - different / n > REPEATED_SHARE:
                return Fill("datetime", modes(df, {column: micros})[column])
    return fit_datetime_medians(df, [column], accuracy)[column]


def fit_datetime_medians(
    df: DataFrame, columns: Sequence[str], accuracy: int | None = None
) -> dict[str, Fill]:
    """Median instants, the mean of the two middle ones if their number is even."""
    values = {c: as_micros(quoted(c), df.schema[c].dataType).cast("double") for c in columns}
    found = quantiles(
        df, {c: (0.5,) for c in columns}, columns=values, accuracy=accuracy
    )
    return {c: Fill("datetime", int(found[c][0.5]) if c in found else 0) for c in columns}


def forward_fill(df: DataFrame, columns: Sequence[str], order_key: str) -> DataFrame:
    """Repeat the last non-missing value in ``order_key`` order; leading gaps stay.

    Rows are cut into ranges of the key (rows of equal key into ranges of a row hash, which
    also makes their order stable). Each range is filled on its own; what a range hands to
    the next one is a table of one row per range.
    """
    hashable = [quoted(f.name) for f in df.schema.fields if not has_map(f.dataType)]
    keyed = df.withColumn("__tie", F.xxhash64(*hashable))
    position = [quoted(order_key), F.col("__tie")]
    ranged = stage(
        keyed.repartitionByRange(*position).withColumn("__range", F.spark_partition_id())
    )
    so_far = (
        Window.partitionBy("__range")
        .orderBy(*position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last_rows = ranged.groupBy("__range").agg(
        *(
            F.max_by(quoted(c), F.when(quoted(c).isNotNull(), F.struct(*position))).alias(
                f"__last{i}"
            )
            for i, c in enumerate(columns)
        )
    )
    # One row per range: this window and the broadcast are bounded by the number of tasks.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_rows.select(
        "__range",
        *(
            F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__carry{i}")
            for i in range(len(columns))
        ),
    )
    filled = {
        c: F.coalesce(F.last(quoted(c), ignorenulls=True).over(so_far), F.col(f"__carry{i}"))
        for i, c in enumerate(columns)
    }
    joined = ranged.join(F.broadcast(carried), "__range")
    return joined.select(*(filled[c].alias(c) if c in filled else quoted(c) for c in df.columns))


# ------------------------------------------------------------------- composite


def fit_fills(
    df: DataFrame,
    columns: Sequence[str],
    *,
    empty: Sequence[str] = (),
    numeric_strategy: str = "auto",
    datetime_strategy: str = "median",
    accuracy: int | None = None,
) -> dict[str, Fill]:
    """Fill value of every listed column. ``empty`` names columns without any value."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    fills: dict[str, Fill] = {}
    groups: dict[str, list[str]] = {"number": [], "datetime": [], "boolean": [], "text": []}
    for c in columns:
        kind = kind_of(dtypes[c])
        if kind is None:
            continue
        if c in empty:
            fills[c] = empty_fill(kind)
        else:
            groups[kind].append(c)
    if groups["number"]:
        fills.update(fit_numbers(df, groups["number"], numeric_strategy, accuracy))
    if datetime_strategy == "auto":
        for c in groups["datetime"]:
            fills[c] = fit_datetime(df, c, "auto", accuracy)
    elif groups["datetime"]:
        fills.update(fit_datetime_medians(df, groups["datetime"], accuracy))
    fills.update(fit_booleans(df, groups["boolean"]))
    fills.update(fit_texts(df, groups["text"]))
    return fills


def kind_of(dtype: T.DataType) -> str | None:
    """Fill rule of a type; None for nested and binary columns, which are left alone."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, _DATETIMES):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "text" if isinstance(dtype, T.StringType) else None


def empty_fill(kind: str) -> Fill:
    """Defaults for a column without a single value."""
    defaults = {"number": 0.0, "datetime": 0, "boolean": False, "text": UNKNOWN_TEXT}
    return Fill(kind, defaults[kind])


def apply_fills(
    df: DataFrame, fills: Mapping[str, Fill], order_key: str | None = None
) -> DataFrame:
    forward = [c for c, f in fills.items() if f.kind == "forward"]
    if forward:
        if not order_key:
            raise ValueError(f"order_key is required to forward fill {forward}")
        df = forward_fill(df, forward, order_key)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return replace_columns(
        df,
        {
            c: f.expression(quoted(c), dtypes[c])
            for c, f in fills.items()
            if f.kind != "forward"
        },
    )


def fill_missing_values(
    df: DataFrame,
    *,
    numeric_strategy: str = "auto",
    datetime_strategy: str = "median",
    order_key: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Fill every column that has missing cells by the rule of its type."""
    df = missing_as_null(df)
    rows, present = present_counts(df)
    gaps = [c for c, n in present.items() if n < rows]
    fills = fit_fills(
        df,
        gaps,
        empty=[c for c in gaps if present[c] == 0],
        numeric_strategy=numeric_strategy,
        datetime_strategy=datetime_strategy,
        accuracy=accuracy,
    )
    return apply_fills(df, fills, order_key)


def missing_total(df: DataFrame) -> int:
    rows, present = present_counts(df)
    return sum(rows - n for n in present.values())


def missing_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: missing cells before and after, and how many were filled."""
    first, second = missing_total(before), missing_total(after)
    return before.sparkSession.createDataFrame(
        [(first, second, first - second)],
        "missing_before bigint, missing_after bigint, missing_filled bigint",
    )
