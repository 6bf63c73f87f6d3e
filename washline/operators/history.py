"""Rollups over a run-history table: one row per cleaning run, with time and status.

All rollups are windowed aggregations with partial results per task. Percentiles are exact
and never hold a large window in one task (see ``statistics.grouped_quantile``).

``latency_sketches`` keeps a window as one row with a mergeable sketch of its durations. Rows of new
windows, or of more runs of old ones, are appended to a table; ``merged_sketches`` gives any wider window, and
``sketched_latency`` its percentiles, without reading a run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions.names import quoted
from washline.operators.statistics import grouped_quantile

HOUR = "1 hour"
#: Size of sketches of durations; ranks are off by less than 0.002 with a confidence of 99 percent.
SKETCH_K = 2_000


def _window_start(ts: str, width: str) -> Column:
    return F.window(quoted(ts), width).getField("start").alias("window_start")


def run_counts(df: DataFrame, ts: str, status: str, width: str = HOUR) -> DataFrame:
    """Runs per window and status, and the share per second."""
    seconds = F.unix_micros(F.window(quoted(ts), width).getField("end").cast("timestamp"))
    start = F.unix_micros(F.window(quoted(ts), width).getField("start").cast("timestamp"))
    length = F.max((seconds - start) / F.lit(1e6))
    return df.groupBy(_window_start(ts, width), quoted(status).alias("status")).agg(
        F.count(F.lit(1)).alias("runs"), (F.count(F.lit(1)) / length).alias("runs_per_second")
    )


def latency(
    df: DataFrame, ts: str, duration: str, width: str = HOUR, *, p: float = 0.95
) -> DataFrame:
    """Average and percentile of the duration per window."""
    rows = df.select(_window_start(ts, width), quoted(duration).alias("duration"))
    found = grouped_quantile(rows, ["window_start"], "duration", p)
    return found.select(
        "window_start",
        F.col("mean").alias("avg_duration"),
        F.col("quantile").alias(f"p{round(p * 100)}_duration"),
    )


def latency_sketches(df: DataFrame, ts: str, duration: str, width: str = HOUR, k: int = SKETCH_K) -> DataFrame:
    """Per window ``runs`` and ``total_duration`` of those with a duration, and a quantile sketch of it."""
    value = quoted(duration).cast("double")
    rows = df.select(_window_start(ts, width), F.when(~F.isnan(value), value).alias("duration"))
    return rows.groupBy("window_start").agg(
        F.count("duration").alias("runs"),
        F.sum("duration").alias("total_duration"),
        F.expr(f"kll_sketch_agg_double(duration, {int(k)})").alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, width: str) -> DataFrame:
    """Rows of ``latency_sketches`` merged to windows of ``width``; a window may have several rows."""
    return sketches.groupBy(_window_start("window_start", width)).agg(
        F.sum("runs").alias("runs"),
        F.sum("total_duration").alias("total_duration"),
        F.expr("kll_merge_agg_double(sketch)").alias("sketch"),
    )


def sketched_latency(sketches: DataFrame, *, p: float = 0.95) -> DataFrame:
    """``latency`` from sketches: the average exact, the percentile within the rank error of the sketch."""
    found = F.when(F.col("runs") > 0, F.expr(f"kll_sketch_get_quantile_double(sketch, double({float(p)!r}))"))
    return sketches.select(
        "window_start",
        "runs",
        (F.col("total_duration") / F.col("runs")).alias("avg_duration"),
        found.alias(f"p{round(p * 100)}_duration"),
    )


def sums(
    df: DataFrame, ts: str, measures: Sequence[str], width: str = HOUR
) -> DataFrame:
    """Totals of the measures per window."""
    return df.groupBy(_window_start(ts, width)).agg(
        *(F.sum(quoted(m)).alias(f"total_{m}") for m in measures)
    )


def totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Totals of the measures over the whole history."""
    return df.agg(*(F.sum(quoted(m)).alias(f"total_{m}") for m in measures))


def by_category(
    df: DataFrame, ts: str, category: str, measure: str, succeeded: Column, width: str = HOUR
) -> DataFrame:
    """Totals per window and category over the successful runs."""
    return (
        df.where(succeeded)
        .groupBy(_window_start(ts, width), quoted(category).alias("category"))
        .agg(F.sum(quoted(measure)).alias(f"total_{measure}"))
    )


def success_rate(df: DataFrame, ts: str, succeeded: Column, width: str = HOUR) -> DataFrame:
    """Share of successful runs per window, in percent."""
    return df.groupBy(_window_start(ts, width)).agg(
        F.count(F.lit(1)).alias("runs"),
        (100.0 * F.count_if(succeeded) / F.count(F.lit(1))).alias("success_pct"),
    )
