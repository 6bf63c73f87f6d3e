"""Text columns that are really timestamps or numbers: measure, decide, convert."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions import parsing
from washline.functions.columns import text_columns, typed_columns
from washline.functions.names import quoted
from washline.functions.text import has_non_ascii
from washline.operators.columns import replace_columns
from washline.staging import stage

# Shares of readable cells that must be exceeded, missing cells included.
HINTED_DATETIME_SHARE = 0.8
DATETIME_SHARE = 0.9
NUMBER_SHARE = 0.8


# Columns are parsed value by value, not cell by cell, and then looked up, if their readable values
# all together fit into broadcasts of this size. Whether they may is told by an estimate of the number of
# values; whether they do, by their measured size. The result is the same either way.
LOOKUP_BYTES = 16 * 1024 * 1024
# Bytes of a value's lookup besides its text.
_VALUE_BYTES = 48

# Whole numbers beyond this are not exact as doubles.
_EXACT = 1 << 53


@dataclass(frozen=True)
class TextSurvey:
    """A cheap first look at one text column."""

    rows: int = 0
    present: int = 0
    may_parse: bool = False
    non_ascii: int = 0
    distinct: int = 0
    mean_bytes: float = 0.0

    @property
    def value_bytes(self) -> float:
        """Estimated size of a lookup of all different values."""
        return self.distinct * (self.mean_bytes + _VALUE_BYTES)


@dataclass(frozen=True)
class TextStats:
    """What the parsers made of one text column."""

    rows: int = 0
    present: int = 0
    datetimes: int = 0
    numbers: int = 0
    integers: int = 0
    digits: bool = False
    whole: int = 0
    wide: int = 0
    beyond_double: int = 0


def _cells(df: DataFrame, columns: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Cells of the ``wanted`` columns as rows (column number, text)."""
    pairs = ", ".join(f"{columns.index(c)}, v{columns.index(c)}" for c in wanted)
    named = df.select(*(quoted(c).alias(f"v{columns.index(c)}") for c in wanted))
    return named.selectExpr(f"stack({len(wanted)}, {pairs}) as (col, v)")


def survey_text(
    df: DataFrame, columns: Sequence[str], present: Callable[[Column], Column] = lambda c: c
) -> dict[str, TextSurvey]:
    """One light pass over all text columns: which of them are worth parsing at all.

    ``present`` maps a cell to NULL where cleaning will make it missing.
    """
    if not columns:
        return {}
    columns = list(columns)
    v = F.col("v")
    found = (
        _cells(df, columns, columns)
        .groupBy("col")
        .agg(
            F.count(F.lit(1)),
            F.count(present(v)),
            F.coalesce(F.max(parsing.may_parse(v)), F.lit(False)),
            F.count_if(has_non_ascii(v)),
            F.approx_count_distinct(v),
            F.coalesce(F.avg(F.octet_length(v)), F.lit(0.0)),
        )
    )
    survey = {c: TextSurvey() for c in columns}
    for row in found.collect():  # one row per column
        survey[columns[row[0]]] = TextSurvey(*row[1:])
    return survey


@dataclass(frozen=True)
class ParsedText:
    """Parser results per column, and the parsed values of columns with few of them."""

    stats: Mapping[str, TextStats]
    values: Mapping[str, DataFrame]


def parse_text(
    df: DataFrame,
    columns: Sequence[str],
    survey: Mapping[str, TextSurvey],
    *,
    bare_digits: bool = True,
    ignore_code_case: bool = True,
) -> ParsedText:
    """Readable cells per text column, for all columns and both parsers together.

    Columns are stacked into (column number, cell) rows: the parsers appear once in the
    plan however many columns there are. In columns whose different values fit into a lookup each
    value is parsed once and kept, so that no cell is parsed when the column is converted.
    """
    columns = list(columns)
    if not columns:
        return ParsedText({}, {})
    few, left = [], 1.5 * LOOKUP_BYTES  # an estimate may be off, and some values are not readable
    for c in sorted(columns, key=lambda c: survey[c].value_bytes):
        if survey[c].value_bytes <= left:
            left -= survey[c].value_bytes
            few.append(c)
    many = [c for c in columns if c not in few]

    def parsed(cells: DataFrame) -> DataFrame:
        wide = cells.select(
            "*",
            parsing.parse_datetime("v", bare_digits=bare_digits).alias("dt"),
            parsing.bare_number_text("v", ignore_code_case=ignore_code_case).alias("bare"),
        )
        number = parsing.number_of(F.col("bare"))
        readable = F.col("dt").isNotNull() | number.isNotNull()
        return wide.select(
            "col",
            "n",
            F.col("v").isNotNull().alias("present"),
            F.coalesce(parsing.has_digit(F.col("v")), F.lit(False)).alias("digits"),
            F.coalesce(parsing.is_whole_text(F.col("bare")), F.lit(False)).alias("whole"),
            parsing.integer_of(F.col("bare")).alias("integer"),
            parsing.decimal_of(F.col("bare")).alias("wide"),
            "dt",
            number.alias("number"),
            F.when(readable, F.col("v")).alias("text"),
        )

    parts = []
    if few:
        counts = _cells(df, columns, few).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
        values = stage(parsed(counts))
        parts.append(values)
    if many:
        parts.append(parsed(_cells(df, columns, many).withColumn("n", F.lit(1).cast("bigint"))))
    cells = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counted = cells.groupBy("col").agg(
        total(F.lit(True)),
        total(F.col("present")),
        total(F.col("dt").isNotNull()),
        total(F.col("number").isNotNull()),
        total(F.col("integer").isNotNull()),
        F.max("digits"),
        total(F.col("whole")),
        total(F.col("wide").isNotNull()),
        total(F.col("whole") & (F.col("wide").isNull() | (F.abs("wide") > _EXACT))),
        F.sum(F.octet_length("text") + _VALUE_BYTES).alias("size"),
    )
    stats = {c: TextStats() for c in columns}
    lookups, room = {}, LOOKUP_BYTES
    found = counted.collect()  # one row per column
    for row in sorted(found, key=lambda r: (r.size or 0, r[0])):
        c = columns[row[0]]
        stats[c] = TextStats(*row[1:10])
        if c in few and row.size and row.size <= room:
            room -= row.size
            lookups[c] = values.where(F.col("col") == row[0]).where("text is not null")
    return ParsedText(stats, lookups)


def choose_target(label: str, stats: TextStats) -> str | None:
    """``timestamp_ntz``, ``double``, ``bigint``, ``decimal(38,0)`` or None (stays text).

    Whole numbers that a double would round keep every digit, also next to gaps.
    """
    if not stats.rows:
        return None
    name = label.lower()
    datetime_share = stats.datetimes / stats.rows
    hinted = any(hint in name for hint in parsing.DATETIME_HINTS)
    if datetime_share > DATETIME_SHARE or (hinted and datetime_share > HINTED_DATETIME_SHARE):
        return "timestamp_ntz"
    if not (stats.digits or any(hint in name for hint in parsing.NUMERIC_HINTS)):
        return None
    if stats.numbers / stats.rows > NUMBER_SHARE:
        if stats.integers == stats.rows or (stats.beyond_double and stats.integers == stats.numbers):
            return "bigint"
        if stats.beyond_double and stats.whole == stats.numbers:
            return "decimal(38,0)" if stats.wide == stats.whole else None
        return "double"
    return None


def apply_targets(
    df: DataFrame,
    targets: Mapping[str, str],
    *,
    bare_digits: bool = True,
    ignore_code_case: bool = True,
    values: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Convert the columns in ``targets``; cells that do not parse become missing.

    ``values`` are values parsed before, of bounded size: their columns are looked up, the
    others are parsed cell by cell.
    """

    def converted(name: str, target: str) -> Column:
        if target == "timestamp_ntz":
            return parsing.parse_datetime(name, bare_digits=bare_digits)
        if target == "bigint":
            return parsing.parse_integer(name, ignore_code_case=ignore_code_case)
        if target != "double":
            return parsing.decimal_of(parsing.bare_number_text(name, ignore_code_case=ignore_code_case))
        return parsing.parse_number(name, ignore_code_case=ignore_code_case)

    known = {c: v for c, v in (values or {}).items() if c in targets}
    df = replace_columns(df, {c: converted(c, t) for c, t in targets.items() if c not in known})
    for c, table in known.items():
        result = {"timestamp_ntz": "dt", "double": "number", "bigint": "integer"}.get(targets[c], "wide")
        lookup = table.select(
            F.col("text").alias("__text"), F.col(result).cast(targets[c]).alias("__value")
        )
        joined = df.join(F.broadcast(lookup), quoted(c) == F.col("__text"), "left")
        df = joined.select(
            *(F.col("__value").alias(x) if x == c else quoted(x) for x in df.columns)
        )
    return df


def fit_formats(
    df: DataFrame, *, bare_digits: bool = True, ignore_code_case: bool = True
) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """Target type of every text column that should change, and values parsed on the way."""
    columns = text_columns(df)
    survey = survey_text(df, columns)
    worth = [c for c in columns if survey[c].may_parse]
    parsed = parse_text(
        df, worth, survey, bare_digits=bare_digits, ignore_code_case=ignore_code_case
    )
    chosen = {c: choose_target(c, parsed.stats[c]) for c in worth}
    return {c: target for c, target in chosen.items() if target}, dict(parsed.values)


def standardize_formats(
    df: DataFrame, *, bare_digits: bool = True, ignore_code_case: bool = True
) -> DataFrame:
    """Turn text columns into timestamps or numbers where enough cells parse."""
    options = {"bare_digits": bare_digits, "ignore_code_case": ignore_code_case}
    targets, values = fit_formats(df, **options)
    return apply_targets(df, targets, values=values, **options)


def typed_column_count(df: DataFrame) -> int:
    """Columns that are numeric, boolean or datetime, whether converted or born so."""
    return len(typed_columns(df))


