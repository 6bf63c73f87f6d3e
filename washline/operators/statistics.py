"""Whole-column statistics as distributed aggregations.

Three building blocks serve every operator that decides from data:

* ``moments``  - counts, range, mean, deviation and skewness of many columns in one pass;
* ``quantiles`` - exact linear-interpolated quantiles without sorting or shuffling rows;
* ``modes``    - the most frequent value per column.

Spark's own ``percentile``, ``median`` and ``mode`` keep every distinct value of a group in
one aggregation buffer. That is used here only where counts show the buffer to be small.
Otherwise a quantile is found by narrowing value intervals: each pass counts rows per
bucket of the interval that holds the wanted rank (a map-side combined ``groupBy`` of at
most ``_BUCKETS`` groups per interval) and keeps the one bucket that still holds it. Once a
bucket is as small as a buffer may be, its values are sorted and the rank is picked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from washline.functions.columns import as_double
from washline.functions.names import quoted
from washline.staging import stage

# A buffer may hold this many rows.
SMALL_ROWS = 20_000

_BUCKETS = 1024
_MAGNITUDE_STEPS = 16
#: Below this largest magnitude, what sample_skewness takes for zero is no rounding error.
_SMALL_PEAK = 1e-14


@dataclass(frozen=True)
class Moments:
    """Statistics of the non-missing values of one numeric column."""

    n: int
    low: float | None
    high: float | None
    mean: float | None
    std: float | None
    skew: float | None
    total: float | None

    @property
    def varies(self) -> bool:
        return self.n > 0 and self.low != self.high


def sample_skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness: NULL below three values, 0 for a constant.

    Values within 1e-30 of zero count as zero: the third power of their spread has no double.
    ``_with_small_skews`` measures columns again that have no larger ones beside them.
    """
    n = F.count(c).cast("double")
    c = F.when(F.abs(c) < 1e-30, F.lit(0.0)).otherwise(c)
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(adjusted, F.lit(0.0)))


def stacked(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows (column number, value) of all columns, without missing values.

    Statistics over many columns run on this form: the aggregation is written once in the
    plan, so compiled code stays small, and partial results combine per column.
    """
    names = list(columns)
    wide = df.select(*(columns[name].alias(f"v{i}") for i, name in enumerate(names)))
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(names)))
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as (col, v)").where("v is not null")


def _with_small_skews(
    df: DataFrame, columns: Mapping[str, Column], found: dict[str, Moments]
) -> dict[str, Moments]:
    """``found``, with the skewness of columns of tiny numbers taken from their shares of the largest magnitude."""
    peaks = {c: max(abs(m.low), abs(m.high)) for c, m in found.items() if m.n > 2 and m.varies}
    small = {c: columns[c] / F.lit(peak) for c, peak in peaks.items() if peak < _SMALL_PEAK}
    if not small:
        return found
    names, v = list(small), F.col("v")
    rows = stacked(df, small).groupBy("col").agg(sample_skewness(v)).collect()  # one row per column
    return found | {names[i]: replace(found[names[i]], skew=skew) for i, skew in rows}


def moments(
    df: DataFrame, columns: Mapping[str, Column] | Sequence[str]
) -> dict[str, Moments]:
    """Moments of all ``columns`` from a single pass, and another over columns of tiny numbers."""
    if not isinstance(columns, Mapping):
        columns = {name: as_double(quoted(name)) for name in columns}
    if not columns:
        return {}
    names = list(columns)
    v = F.col("v")
    found = stacked(df, columns).groupBy("col").agg(
        F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), sample_skewness(v), F.sum(v)
    )
    result = {name: Moments(0, None, None, None, None, None, None) for name in names}
    for row in found.collect():  # one row per column
        result[names[row[0]]] = Moments(*row[1:])
    return _with_small_skews(df, columns, result)


def column_facts(
    df: DataFrame, hashes: Mapping[str, Column], numbers: Mapping[str, Column]
) -> tuple[int, dict[str, int], dict[str, int], dict[str, Moments]]:
    """Rows, non-missing counts, estimates of different values and moments, from one pass (see ``moments``).

    ``hashes`` are longs that stand for the values of any column, ``numbers`` doubles of the
    numeric ones. Both are stacked side by side: (column, hash, number).
    """
    names = list(hashes)
    wide = df.select(
        *(hashes[c].alias(f"h{i}") for i, c in enumerate(names)),
        *((numbers[c] if c in numbers else F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(names)),
    )
    triples = ", ".join(f"{i}, h{i}, v{i}" for i in range(len(names)))
    v = F.col("v")
    found = (
        wide.selectExpr(f"stack({len(names)}, {triples}) as (col, h, v)")
        .groupBy("col")
        .agg(
            F.count(F.lit(1)), F.count("h"), F.approx_count_distinct("h"),
            F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), sample_skewness(v), F.sum(v),
        )
    )
    rows, present, estimates, stats = 0, dict.fromkeys(names, 0), dict.fromkeys(names, 0), {}
    for row in found.collect():  # one row per column
        name = names[row[0]]
        rows, present[name], estimates[name] = row[1], row[2], row[3]
        stats[name] = Moments(*row[4:])
    empty = Moments(0, None, None, None, None, None, None)
    stats = {c: stats.get(c, empty) for c in numbers}
    return rows, present, estimates, _with_small_skews(df, numbers, stats)


def distinct_estimates(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, int]:
    """Approximate number of different values per column."""
    if not columns:
        return {}
    names = list(columns)
    found = stacked(df, columns).groupBy("col").agg(F.approx_count_distinct("v"))
    return {**dict.fromkeys(names, 0), **{names[row[0]]: row[1] for row in found.collect()}}


# ------------------------------------------------------------------- quantiles


def _rank_parts(n: int, p: float) -> tuple[int, int, float]:
    """Zero-based ranks around the quantile and the weight of the upper one."""
    position = (n - 1) * p
    below = math.floor(position)
    return below, min(below + 1, n - 1), position - below


def _blend(low: float, high: float, weight: float) -> float:
    return low if low == high or weight == 0 else low + (high - low) * weight


def _magnitude_bucket(v: Column) -> Column:
    """Rises with ``v``: by sign, power of two and sixteenth of that power."""
    size = F.abs(v)
    power = F.floor(F.log2(size)).cast("double")
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1) * _MAGNITUDE_STEPS).cast("double")
    bucket = (power + 1100) * _MAGNITUDE_STEPS + step
    return (
        F.when(v == 0, F.lit(0.0))
        .when(size == float("inf"), F.signum(v) * 1e9)
        .otherwise(F.signum(v) * bucket)
    )


def _even_bucket(v: Column, low: Column, high: Column) -> Column:
    share = (v - low) / (high - low)
    return F.floor(share * _BUCKETS).cast("double")


def _narrow(
    values: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    materialize: Callable[[DataFrame], DataFrame],
    buffer_rows: int,
) -> DataFrame:
    """Shrink every interval of ``state`` until it holds a single value, or few enough to sort.

    ``values`` has the key columns and ``v``; ``state`` has the same keys and ``ranks``, the
    wanted zero-based ranks within the key. Returns key columns, ``rank`` and ``v``.
    Each interval is closed; intervals of a key never overlap, so a row meets at most one.
    """
    inside = F.col("v").between(F.col("low"), F.col("high"))
    per_interval = Window.partitionBy(*keys, "base").orderBy("bucket")

    def one_pass(rows: DataFrame, intervals: DataFrame, bucket: Column) -> DataFrame:
        # ``base``, the rows below an interval, tells the intervals of a key apart.
        counted = rows.groupBy(*keys, "base", bucket.alias("bucket")).agg(
            F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        placed = counted.withColumn("upto", F.sum("n").over(per_interval)).withColumn(
            "before", F.col("upto") - F.col("n")
        )
        wanted = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("upto")))
        return (
            placed.join(intervals.select(*keys, "base", "ranks"), [*keys, "base"])
            .withColumn("hits", wanted)
            .where(F.size("hits") > 0)
            .select(
                *keys,
                F.col("least").alias("low"),
                F.col("most").alias("high"),
                F.transform("hits", lambda r: r - F.col("before")).alias("ranks"),
                (F.col("base") + F.col("before")).alias("base"),
                "n",
            )
        )

    def last_pass(rows: DataFrame, intervals: DataFrame) -> DataFrame:
        """Pick the ranks from the sorted values of intervals that fit into a buffer."""
        held = rows.groupBy(*keys, "base").agg(F.sort_array(F.collect_list("v")).alias("held"))
        return (
            held.join(intervals.select(*keys, "base", "ranks"), [*keys, "base"])
            .select(*keys, "base", "held", F.explode("ranks").alias("r"))
            .select(*keys, (F.col("r") + F.col("base")).alias("rank"), F.get("held", F.col("r").cast("int")).alias("v"))
        )

    def within(intervals: DataFrame) -> DataFrame:
        # One row per key and open interval: Spark broadcasts it if its measured size
        # allows, so ``values`` are not shuffled row by row.
        return values.join(intervals.drop("ranks", "n"), list(keys)).where(inside)

    start = state.select(*keys, "ranks", F.lit(0).cast("long").alias("base"))
    rows = values.withColumn("base", F.lit(0).cast("long"))
    state = materialize(one_pass(rows, start, _magnitude_bucket(F.col("v"))))
    found = []
    while True:
        single = state.where("low = high")
        found.append(
            single.select(
                *keys, F.explode(F.transform("ranks", lambda r: r + F.col("base"))).alias("rank"), F.col("low").alias("v")
            )
        )
        small = state.where((F.col("low") < F.col("high")) & (F.col("n") <= buffer_rows))
        large = state.where((F.col("low") < F.col("high")) & (F.col("n") > buffer_rows))
        if not small.isEmpty():
            found.append(materialize(last_pass(within(small), small)))
        if large.isEmpty():
            break
        bucket = _even_bucket(F.col("v"), F.col("low"), F.col("high"))
        state = materialize(one_pass(within(large), large, bucket))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _local(spark: SparkSession, columns: Mapping[str, pa.Array]) -> DataFrame:
    # An Arrow table becomes a local relation, whose size Spark knows when it plans joins.
    return spark.createDataFrame(pa.table(dict(columns)))


def _collected(df: DataFrame) -> DataFrame:
    # Only for states without user keys: a few rows per column.
    table = df.toArrow()
    return _local(df.sparkSession, dict(zip(table.column_names, table.columns)))


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    *,
    columns: Mapping[str, Column] | None = None,
    known: Mapping[str, Moments] | None = None,
    small_rows: int = SMALL_ROWS,
    accuracy: int | None = None,
) -> dict[str, dict[float, float]]:
    """Quantiles ``{column: {p: value}}`` with linear interpolation, exact by default.

    ``known`` spares the counting pass. ``accuracy`` switches to ``percentile_approx``.
    ``small_rows`` is what a buffer may hold: shorter columns are sorted in one.
    """
    columns = dict(columns or {name: as_double(quoted(name)) for name in wanted})
    if known is None:
        known = moments(df, {name: columns[name] for name in wanted})
    wanted = {name: tuple(ps) for name, ps in wanted.items() if ps and known[name].n > 0}
    if not wanted:
        return {}
    names = list(wanted)
    if accuracy is not None:
        points = sorted({p for n in names for p in wanted[n]})
        found = (
            stacked(df, {n: columns[n] for n in names})
            .groupBy("col")
            .agg(F.percentile_approx("v", points, accuracy).alias("q"))
        )
        approximate = {names[row.col]: dict(zip(points, row.q)) for row in found.collect()}
        return {n: {p: approximate[n][p] for p in wanted[n]} for n in names}

    parts = {(n, p): _rank_parts(known[n].n, p) for n in names for p in wanted[n]}
    few = [n for n in names if known[n].n <= small_rows]
    many = [n for n in names if known[n].n > small_rows]

    result: dict[str, dict[float, float]] = {}
    if few:
        points = sorted({p for n in few for p in wanted[n]})
        found = (
            stacked(df, {n: columns[n] for n in few})
            .groupBy("col")
            .agg(F.percentile("v", F.array(*(F.lit(float(p)) for p in points))).alias("q"))
        )
        for row in found.collect():  # one row per column
            at = dict(zip(points, row.q))
            result[few[row.col]] = {p: at[p] for p in wanted[few[row.col]]}

    value: dict[tuple[str, int], float] = {}
    ranks = {n: sorted({r for p in wanted[n] for r in parts[n, p][:2]}) for n in many}
    if many:
        state = _local(
            df.sparkSession,
            {
                "col": pa.array(range(len(many)), pa.int32()),
                "ranks": pa.array([ranks[n] for n in many], pa.list_(pa.int64())),
            },
        )
        found = _narrow(stacked(df, {n: columns[n] for n in many}), state, ["col"], _collected, small_rows)
        value.update({(many[r.col], r.rank): r.v for r in found.collect()})
    for n in many:
        result[n] = {
            p: _blend(value[n, lo], value[n, hi], weight)
            for p in wanted[n]
            for lo, hi, weight in [parts[n, p]]
        }
    return result


def grouped_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, *, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Exact quantile and mean of ``value`` per key: columns ``keys``, ``quantile`` and ``mean``.

    Keys with few rows use Spark's ``percentile``. Keys beyond ``small_rows`` are narrowed
    interval by interval, so no task ever holds the values of a large key. A missing key is
    a key like any other. The source is read once: keys and values are staged.
    """
    # Inside, the keys are one struct: structs of missing values are equal, so joins meet them.
    source = stage(df.select(*keys, as_double(quoted(value)).alias("v")).where(F.col("v").isNotNull()))
    rows = source.select(F.struct(*keys).alias("key"), "v")
    found = _quantile_by_key(rows, p, small_rows)
    return found.select(*(F.col("key").getField(k).alias(k) for k in keys), "quantile", "mean")


def _quantile_by_key(rows: DataFrame, p: float, small_rows: int) -> DataFrame:
    keys = ["key"]
    sizes = stage(rows.groupBy(*keys).agg(F.count("v").alias("size"), F.avg("v").alias("mean")))
    if sizes.where(F.col("size") > small_rows).isEmpty():
        return rows.groupBy(*keys).agg(F.percentile("v", p).alias("quantile"), F.avg("v").alias("mean"))

    large = sizes.where(F.col("size") > small_rows)
    few = (
        rows.join(large.select(*keys), list(keys), "left_anti")
        .groupBy(*keys)
        .agg(F.percentile("v", p).alias("quantile"), F.avg("v").alias("mean"))
    )
    position = (F.col("size") - 1) * F.lit(float(p))
    lower = F.floor(position)
    ranked = large.withColumn("lower", lower).withColumn(
        "upper", F.least(lower + 1, F.col("size") - 1)
    )
    state = ranked.select(*keys, F.array_distinct(F.array("lower", "upper")).alias("ranks"))
    rows_of_large = rows.join(large.select(*keys), list(keys), "left_semi")
    found = _narrow(rows_of_large, state, list(keys), stage, small_rows)
    at = lambda rank: F.max(F.when(F.col("rank") == F.col(rank), F.col("v")))
    low, high = at("lower"), at("upper")
    weight = F.max(position) - F.max("lower")
    many = (
        found.join(ranked, list(keys))
        .groupBy(*keys)
        .agg(
            F.when(weight == 0, low).otherwise(low + (high - low) * weight).alias("quantile"),
            F.first("mean").alias("mean"),
        )
    )
    return few.unionByName(many)


# ----------------------------------------------------------------------- modes


def modes(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest among equally frequent ones.

    All columns must share one type. Counts are combined before the shuffle, and the
    winner per column is a plain minimum, so a value held by most rows is no hot spot.
    """
    if not isinstance(columns, Mapping):
        columns = {name: quoted(name) for name in columns}
    return counted_modes(df, columns)


def counted_modes(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, object]:
    """``modes`` by the counts of all different values."""
    if not columns:
        return {}
    names = list(columns)
    counted = stacked(df, columns).groupBy("col", "v").count()
    return {names[row.col]: row.best.v for row in best_counted(counted).collect()}


def best_counted(counted: DataFrame) -> DataFrame:
    """Per column number ``col`` the most frequent ``v`` (the smallest of equals) of (col, v, count): best.order, best.v."""
    return counted.groupBy("col").agg(
        F.min(F.struct((-F.col("count")).alias("order"), F.col("v"))).alias("best")
    )
