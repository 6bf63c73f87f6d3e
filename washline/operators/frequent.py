"""The most frequent value of columns with many different values: sketched candidates, counted exactly.

A first pass keeps a sketch of frequent items per column (``approx_top_k``) of fixed size in every task, so what is
shuffled does not grow with the number of different values. A second pass counts the values among the candidates. A value
that is no candidate has at most a known number of rows: where the best candidate has more, it is the mode. Only
columns that this leaves in doubt, such as those of nearly unique values, are counted in full.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.operators.statistics import best_counted, counted_modes, stacked

#: Values that a sketch tracks, and candidates that are taken from it, per column.
TRACKED, CANDIDATES = 4_096, 64
#: A sketch of n rows with room for m values misses at most 3.5 n / m rows of any value.
_ERROR = 3.5 / TRACKED
_TYPES = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def can_be_sketched(dtype: T.DataType) -> bool:
    """Types whose equal values have equal hashes."""
    return isinstance(dtype, _TYPES) or dtype == T.StringType()


def sketched_modes(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, object]:
    """Most frequent value per column, the smallest among equally frequent ones; exact.

    Columns share one type. Values are sketched by hash, so long texts cost no more than short ones; values
    with one hash are counted apart in the second pass.
    """
    names = list(columns)
    rows = stacked(df, columns)
    if not can_be_sketched(rows.schema["v"].dataType):
        return counted_modes(df, columns)
    hashed = rows.withColumn("hash", F.xxhash64("v"))
    sketches = hashed.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(hash, {CANDIDATES}, {TRACKED})").alias("top")
    )
    most, candidates = {}, []
    for col, n, top in sketches.collect():  # one row per column
        # Not among the candidates: below the last of them, or within the error and so perhaps left out.
        last = min(t["count"] for t in top) if len(top) == CANDIDATES else 0
        most[col] = max(last, 2 * _ERROR * n)
        candidates += [(col, t["item"]) for t in top]
    wanted = df.sparkSession.createDataFrame(candidates, "col int, hash bigint")  # at most CANDIDATES a column
    counts = hashed.join(F.broadcast(wanted), ["col", "hash"], "left_semi").groupBy("col", "v").count()
    found = {row.col: row.best.v for row in best_counted(counts).collect() if -row.best.order > most[row.col]}
    doubtful = {names[col]: columns[names[col]] for col in most if col not in found}
    return {names[col]: value for col, value in found.items()} | counted_modes(df, doubtful)
