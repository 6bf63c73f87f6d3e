"""Statistics, caps and fills for each group of rows, many columns and all groups at once.

The model is a table, one row for each group and column, that is joined to the rows by the
group; nothing of it reaches the driver. Moments are combined in the tasks before they are
shuffled. Exact quantiles come from ranks: different values are counted (combined in the tasks),
sorted into ranges of (group, column, value), summed inside each range and carried on over the
ranges. A group that holds most rows spans as many ranges as it needs, so it is never one task's.
A group is any combination of the ``by`` columns; missing values make a group like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.errors import InvalidInputError
from washline.functions.columns import as_double, missing_as_null, numeric_columns
from washline.functions.names import quoted
from washline.operators.missing import SKEW_FOR_MEDIAN
from washline.operators.outliers import IQR_FACTOR, SKEW_FOR_IQR, STD_FACTOR
from washline.operators.statistics import sample_skewness
from washline.staging import stage

_QUARTILES = (0.25, 0.5, 0.75)


def _group(by: Sequence[str]) -> Column:
    """The ``by`` columns as one key; a struct is equal to another also where both have gaps."""
    return F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(by)])


def _checked(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    if not by or any(c not in df.columns for c in by):
        raise InvalidInputError(f"no such grouping columns: {list(by)}")
    numeric = numeric_columns(df)
    columns = [c for c in numeric if c not in by] if columns is None else list(columns)
    if not columns or any(c not in numeric or c in by for c in columns):
        raise InvalidInputError(f"not numeric columns beside the groups: {columns}")
    return columns


def _cells(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(k, col, v) of all non-missing cells."""
    wide = df.select(_group(by).alias("k"), *[as_double(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(columns)))
    return wide.selectExpr("k", f"stack({len(columns)}, {pairs}) as (col, v)").where("v is not null")


def _ranks(cells: DataFrame) -> DataFrame:
    """(k, col, v, n, upto, total): each different value, how often it occurs, and how many are not above it."""
    counts = cells.groupBy("k", "col", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(counts.repartitionByRange(parts, "k", "col", "v").withColumn("range", F.spark_partition_id()))
    group = Window.partitionBy("k", "col")
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("k", "col", "range").agg(F.sum("n").alias("n"))  # one row for each group in a range
    runs = runs.select(
        "k", "col", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(group).alias("total")
    )
    inside = Window.partitionBy("k", "col", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(runs, ["k", "col", "range"])
    return joined.select("k", "col", "v", "n", (F.col("ahead") + F.sum("n").over(inside)).alias("upto"), "total")


def _quantiles(cells: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(k, col, q0, q1, ...): linearly interpolated quantiles."""
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("v")))

    picked = []
    for i, x in enumerate(place):
        picked += [at(F.floor(x)).alias(f"a{i}"), at(F.ceil(x)).alias(f"b{i}"), F.max(x - F.floor(x)).alias(f"f{i}")]
    found = _ranks(cells).groupBy("k", "col").agg(*picked)
    return found.select(
        "k", "col", *[F.expr(f"a{i} + f{i} * (b{i} - a{i})").alias(f"q{i}") for i in range(len(place))]
    )


def _moments(cells: DataFrame) -> DataFrame:
    v = F.col("v")
    return cells.groupBy("k", "col").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), sample_skewness(v).alias("skew"),
    )


def _named(table: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The key as its columns, and the column's name in place of its number."""
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("col") + 1)
    rest = [c for c in table.columns if c not in ("k", "col")]
    return table.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(by)], name.alias("column"), *rest)


def _model(df: DataFrame, by: Sequence[str], columns: Sequence[str], auto_detect: bool) -> DataFrame:
    """Stage (k, col, statistics, method, lower, upper, fill)."""
    cells = _cells(df, by, columns)
    stats = _moments(cells).join(_quantiles(cells, _QUARTILES), ["k", "col"])
    skewed = F.coalesce(F.abs("skew") > SKEW_FOR_IQR, F.lit(False)) if auto_detect else F.lit(True)
    margin = F.when(skewed, IQR_FACTOR * (F.col("q2") - F.col("q0"))).otherwise(STD_FACTOR * F.col("std"))
    stated = (F.col("min") < F.col("max")) & (F.col("margin") > 0)
    low = F.when(skewed, F.col("q0")).otherwise(F.col("mean")) - F.col("margin")
    high = F.when(skewed, F.col("q2")).otherwise(F.col("mean")) + F.col("margin")
    return stage(
        stats.withColumn("margin", margin).select(
            "k", "col", "n", "mean", "std", "skew", "min", F.col("q0").alias("q1"), F.col("q1").alias("median"),
            F.col("q2").alias("q3"), "max",
            F.when(stated, F.when(skewed, F.lit("IQR")).otherwise(F.lit("Z-score"))).alias("method"),
            F.when(stated, low).alias("lower"),
            F.when(stated, high).alias("upper"),
            F.when(F.abs("skew") > SKEW_FOR_MEDIAN, F.col("q1")).otherwise(F.col("mean")).alias("fill"),
        )
    )


def fit_by(
    df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, *, auto_detect: bool = True
) -> DataFrame:
    """The model as a table: one row for each group and numeric column that has a value in it.

    Columns: the groups, ``column``, n, mean, std, skew, min, q1, median, q3, max, method, lower,
    upper (missing where the rule has nothing to say) and fill (median if strongly skewed, else mean).
    """
    df = missing_as_null(df)
    columns = _checked(df, by, columns)
    return _named(_model(df, by, columns, auto_detect), by, columns)


def _joined(df: DataFrame, model: DataFrame, by: Sequence[str], columns: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Rows with the facts of their group: ``_m.<fact><column number>``.

    The model has a row for each group; Spark broadcasts it if it is small, else it splits the rows of hot groups.
    """
    wide = model.groupBy(F.col("k").alias("_k")).agg(
        F.struct(*[F.max(F.when(F.col("col") == i, F.col(f))).alias(f"{f}{i}") for f in facts for i in range(len(columns))]).alias("_m")
    )
    return df.withColumn("_g", _group(by)).join(wide, F.col("_g") == F.col("_k"), "left")


def cap_by(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None, *, auto_detect: bool = True) -> DataFrame:
    """Limit each value to the bounds of its column in its group. Capped columns are doubles; missing stays missing."""
    df = missing_as_null(df)
    columns = _checked(df, by, columns)
    rows = _joined(df, _model(df, by, columns, auto_detect), by, columns, ("lower", "upper"))
    # greatest and least pass over missing bounds, so a missing value is kept apart.
    limited = {
        c: F.when(quoted(c).isNotNull(), F.least(F.greatest(quoted(c).cast("double"), F.col(f"_m.lower{i}")), F.col(f"_m.upper{i}")))
        for i, c in enumerate(columns)
    }
    return rows.select(*[limited[c].alias(c) if c in limited else quoted(c) for c in df.columns])


def fill_by(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Fill gaps with the mean, or the median if strongly skewed, of the group; 0 where the group has no value.

    Filled columns are doubles.
    """
    df = missing_as_null(df)
    columns = _checked(df, by, columns)
    rows = _joined(df, _model(df, by, columns, True), by, columns, ("fill",))
    filled = {
        c: F.coalesce(quoted(c).cast("double"), F.col(f"_m.fill{i}"), F.lit(0.0)) for i, c in enumerate(columns)
    }
    return rows.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])


def profile_by(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each group and numeric column: rows, missing, mean, std, min, q1, median, q3, max."""
    df = missing_as_null(df)
    columns = _checked(df, by, columns)
    sizes = df.groupBy(_group(by).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    every = sizes.select("k", "rows", F.explode(F.array(*[F.lit(i) for i in range(len(columns))])).alias("col"))
    facts = ("mean", "std", "min", "q1", "median", "q3", "max")
    full = every.join(_model(df, by, columns, True).select("k", "col", "n", *facts), ["k", "col"], "left")
    missing = (F.col("rows") - F.coalesce("n", F.lit(0))).alias("missing")
    return _named(full.select("k", "col", "rows", missing, *facts), by, columns)
