"""Membership in long lists: the list is a table, what is not in it is found by an anti join.

The list is broadcast if its measured size allows it; the checked table is then not shuffled. Otherwise values
are counted before they are shuffled, so a value of most rows is one record a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.errors import ValidationError
from washline.functions.names import quoted
from washline.staging import stage

#: Longest list that is written into the plan as literals.
MAX_LITERALS = 200
#: Largest broadcast list: 16 bytes and the text of each value.
BROADCAST_BYTES = 16 << 20


def is_long(values: list | DataFrame) -> bool:
    return isinstance(values, DataFrame) or len(values) > MAX_LITERALS


def label(values: list | DataFrame) -> str:
    """The name of the check: short lists in full, long ones by their number of values, tables by their column."""
    if isinstance(values, DataFrame):
        return f"isin(table {values.columns[0]})"
    return f"isin({len(values)} values)" if is_long(values) else f"isin({list(values)})"


@dataclass(frozen=True)
class Listed:
    """Different allowed values as the column ``listed``."""

    values: DataFrame
    small: bool

    def unlisted(self, rows: DataFrame) -> DataFrame:
        """Rows whose column ``listed`` is present, but not in the list."""
        allowed = F.broadcast(self.values) if self.small else self.values
        return rows.where(F.col("listed").isNotNull()).join(allowed, "listed", "left_anti")

    def count_unlisted(self, rows: DataFrame, value: Column) -> int:
        """Number of rows whose ``value`` is present, but not in the list."""
        present = rows.select(value.alias("listed"))
        if self.small:
            return self.unlisted(present).count()
        counted = present.groupBy("listed").count()
        return self.unlisted(counted).agg(F.sum("count")).first()[0] or 0


def listed_values(
    spark: SparkSession, values: list | DataFrame, dtype: str, limit: int = BROADCAST_BYTES
) -> Listed:
    """The allowed values read as ``dtype``; a value that cannot be one is never met, nor is a missing one."""
    if isinstance(values, DataFrame):
        if len(values.columns) != 1:
            raise ValidationError(f"a table of allowed values has one column, not {values.columns}")
        given = values.select(quoted(values.columns[0]).alias("listed"))
    else:
        texts = pa.array([None if v is None else str(v) for v in values], pa.string())
        given = spark.createDataFrame(pa.table({"listed": texts}))
    # Staged: the list is measured and joined, and a long one is no part of either plan.
    typed = stage(given.select(F.col("listed").try_cast(dtype).alias("listed")).where("listed is not null").distinct())
    size = typed.agg(F.sum(F.octet_length(F.col("listed").cast("string")) + 16)).first()[0] or 0
    return Listed(typed, size <= limit)
