"""Duplicate removal.

Every variant is a ``groupBy`` whose first half runs before the shuffle, so a row or key
that fills a third of the table shrinks to one record per task. No window is used: a window
would gather all rows of such a key in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions.columns import has_map, missing_as_null, text_columns
from washline.functions.names import quoted
from washline.functions.text import strip

_COPIES = "__copies"
_CHUNK = 100_000  # copies emitted per record when removed copies are listed again


def _cols(names: Sequence[str]) -> list[Column]:
    return [quoted(n) for n in names]


def count_copies(df: DataFrame, copies: str = _COPIES) -> DataFrame:
    """Distinct rows with their number of copies. NULL equals NULL, -0.0 equals 0.0.

    Variants, which Spark cannot group, are equal if their JSON text is.
    """
    rows = missing_as_null(df)
    variants = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.VariantType)}
    plain = rows.select(*(F.to_json(quoted(c)).alias(c) if c in variants else quoted(c) for c in rows.columns))
    counted = plain.groupBy(*_cols(df.columns)).agg(F.count(F.lit(1)).alias(copies))
    if not variants:
        return counted
    return counted.select(
        *(F.parse_json(quoted(c)).alias(c) if c in variants else quoted(c) for c in df.columns), copies
    )


def _comparable(df: DataFrame) -> list[Column]:
    """Every column in a form that can be hashed and compared: maps and variants as JSON."""
    return [
        F.to_json(quoted(f.name)) if has_map(f.dataType) or isinstance(f.dataType, T.VariantType) else quoted(f.name)
        for f in df.schema.fields
    ]


def _folded(df: DataFrame) -> DataFrame:
    text = set(text_columns(df))
    return df.select(
        *(
            F.lower(strip(quoted(n))).alias(n) if n in text else quoted(n)
            for n in df.columns
        )
    )


def _kept(
    counted: DataFrame, subset: list[str], keep: str | bool, order_key: list[str]
) -> DataFrame:
    """One record per key: the kept row as struct ``row``."""
    columns = [c for c in counted.columns if c != _COPIES]
    if keep is False:
        # A key with a single row has nothing to choose from.
        picked = counted.groupBy(*_cols(subset)).agg(
            F.first(F.struct(*_cols(columns))).alias("row"), F.sum(_COPIES).alias("total")
        )
        return picked.where("total = 1")
    choose = F.min if keep == "first" else F.max
    dtypes = {f.name: f.dataType for f in counted.schema.fields}
    rest = [c for c in columns if c not in order_key and not has_map(dtypes[c])]
    # The remaining columns only settle ties of the order key, to make the choice stable.
    rank = F.struct(*_cols(order_key), *_cols(rest))
    if all(not has_map(dtypes[c]) for c in columns):
        picked = counted.groupBy(*_cols(subset)).agg(choose(rank).alias("row"))
        return picked
    by = F.min_by if keep == "first" else F.max_by
    return counted.groupBy(*_cols(subset)).agg(by(F.struct(*_cols(columns)), rank).alias("row"))


def _row_of(picked: DataFrame, columns: list[str]) -> DataFrame:
    return picked.select(*(F.col("row").getField(c).alias(c) for c in columns))


def _repeat(df: DataFrame, times: str, columns: list[str]) -> DataFrame:
    """Emit every row ``times`` times; a large number is spread over many tasks first."""
    chunks = df.withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / _CHUNK)))
    )
    spread = chunks.repartition(F.xxhash64(*_comparable(df.select(*_cols(columns)))), F.col("__chunk"))
    share = F.least(F.lit(_CHUNK), F.col(times) - F.col("__chunk") * _CHUNK).cast("int")
    return spread.select(
        *_cols(columns), F.explode(F.array_repeat(F.lit(1), share)).alias("__copy")
    ).drop("__copy")


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    *,
    order_key: str | Sequence[str] | None = None,
    normalize_text: bool = False,
    return_report: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Drop repeated rows; with ``return_report`` also return the removed rows.

    Args:
        subset: columns that identify a row (default: all of them).
        keep: ``"first"``, ``"last"`` or ``False`` (drop every row of a repeated key).
        order_key: column(s) that say which row is first; needed with ``subset`` unless
            ``keep`` is ``False``, since a distributed table has no row order of its own.
        normalize_text: compare stripped lower-case text; the output keeps that text.
    """
    if keep not in ("first", "last", False):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    columns = list(df.columns)
    unknown = [c for c in subset or () if c not in columns]
    if unknown:
        raise ValueError(f"subset names unknown columns: {unknown}")
    order = [order_key] if isinstance(order_key, str) else list(order_key or ())
    whole_row = not subset or set(subset) == set(columns)
    if not whole_row and keep is not False and not order:
        raise ValueError("order_key is required to keep the first or last row of a subset")

    rows = missing_as_null(_folded(df) if normalize_text else df)
    if whole_row:
        counted = count_copies(rows)
        cleaned = counted.where(f"{_COPIES} = 1") if keep is False else counted
        kept_rows = cleaned.select(*_cols(columns))
        if not return_report:
            return kept_rows
        surplus = F.when(F.col(_COPIES) > 1, F.col(_COPIES)) if keep is False else F.col(_COPIES) - 1
        removed = counted.withColumn("__times", surplus).where("__times > 0")
        return kept_rows, _repeat(removed, "__times", columns)

    if not return_report:
        return _row_of(_kept(rows.withColumn(_COPIES, F.lit(1)), list(subset), keep, order), columns)

    # Rows are joined on the whole row, so a hot key spreads over all its different rows.
    counted = count_copies(rows)
    kept = _row_of(_kept(counted, list(subset), keep, order), columns)
    left = counted.select("*", *(x.alias(f"__a{i}") for i, x in enumerate(_comparable(rows))))
    right = kept.select(F.lit(1).alias("__kept"), *(x.alias(f"__b{i}") for i, x in enumerate(_comparable(kept))))
    same = F.lit(True)
    for i in range(len(columns)):
        same = same & F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))
    marked = left.join(right, same, "left").select(
        *_cols(columns), (F.col(_COPIES) - F.coalesce(F.col("__kept"), F.lit(0))).alias("__times")
    )
    return kept, _repeat(marked.where("__times > 0"), "__times", columns)


def duplicate_counts(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows_before``, ``rows_after``, ``duplicates_removed``."""
    keys = list(subset or df.columns)
    counted = count_copies(df.select(*_cols(keys)))
    total = F.coalesce(F.sum(_COPIES), F.lit(0))
    return counted.agg(
        total.alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (total - F.count(F.lit(1))).alias("duplicates_removed"),
    )
