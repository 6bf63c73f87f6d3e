"""Reading and writing tables: CSV and Parquet under any Hadoop path."""

from __future__ import annotations

import csv
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.errors import DataLoadError
from washline.functions.names import quoted, unique_names

FORMATS = ("csv", "parquet")

# Cells that count as missing in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))\s*$"
_BOOLEAN = r"^(?:True|TRUE|true|False|FALSE|false)$"

_SURPLUS = "__surplus"
_RECORD = "__record"
_QUOTED = '(^|,) *"[^"]*+(?:""[^"]*+)*+"'


def format_of(path: str, fmt: str | None = None) -> str:
    """Format by name or by file suffix; anything but CSV and Parquet is refused."""
    supported = ", ".join(f".{f}" for f in FORMATS)
    suffix = f".{fmt}" if fmt else PurePosixPath(path).suffix
    kind = suffix.lower().lstrip(".")
    if kind == "xls":
        raise DataLoadError(f"old Excel files (.xls) cannot be read; convert to {supported}")
    if kind not in FORMATS:
        raise DataLoadError(f"unknown file format {suffix or path}; known are {supported}")
    return kind


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.globStatus(target) is not None and len(files.globStatus(target)) > 0


def _header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).where(F.trim("value") != "").first()
    if line is None:
        raise DataLoadError(f"no header line in {path}")
    names = next(csv.reader([line.value.lstrip("﻿")]))
    named = [name if name else f"Unnamed: {i}" for i, name in enumerate(names)]
    return unique_names(named, joiner=".")


def _same_headers(spark: SparkSession, path: str) -> None:
    """Refuse files of one table whose first lines differ: cells are read by position.

    One light pass over the lines, and only if there are several files.
    """
    lines = spark.read.text(path)
    if len(lines.inputFiles()) < 2:
        return
    place = F.monotonically_increasing_id()
    first = (
        lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .where((F.col("block") == 0) & (F.trim("value") != ""))
        .withColumn("place", place)
        .groupBy("file")
        .agg(F.min_by("value", "place").alias("header"))
    )
    found = first.groupBy(F.regexp_replace("header", "^\ufeff", "").alias("header")).agg(F.min("file").alias("file"))
    seen: dict[tuple[str, ...], str] = {}
    for row in found.limit(20).collect():
        seen.setdefault(tuple(next(csv.reader([row.header]))), row.file)
    if len(seen) > 1:
        (a, x), (b, y) = sorted(seen.items(), key=lambda item: item[1])[:2]
        raise DataLoadError(f"files of {path} have different headers: {list(a)} in {x}, {list(b)} in {y}")


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def _inferred(
    present: int, whole: int, integers: int, wide: int, decimals: int, booleans: int
) -> str:
    """Whole numbers keep every digit: as 64 bits, as 38 digits, or as text."""
    if present and whole == present:
        return "bigint" if integers == present else "decimal(38,0)" if wide == present else "string"
    if present == 0 or decimals == present:
        return "double"
    return "boolean" if booleans == present else "string"


def _infer(raw: DataFrame, width: int, path: str) -> list[str]:
    """Column types from one pass; rows longer than the header are refused."""
    aggregates = [F.count_if(F.col(_SURPLUS).isNotNull())]
    for i in range(width):
        c = F.col(f"c{i}")
        aggregates += [
            F.count(c),
            F.count_if(c.rlike(_INTEGER)),
            F.count_if(c.rlike(_INTEGER) & F.trim(c).try_cast("bigint").isNotNull()),
            F.count_if(c.rlike(_INTEGER) & F.trim(c).try_cast("decimal(38,0)").isNotNull()),
            F.count_if(c.rlike(_DECIMAL)),
            F.count_if(c.rlike(_BOOLEAN)),
        ]
    row = raw.agg(*(a.alias(f"a{k}") for k, a in enumerate(aggregates))).first()
    if row[0]:
        raise DataLoadError(f"rows longer than the header in {path}")
    return [_inferred(*row[6 * i + 1 : 6 * i + 7]) for i in range(width)]


def _without_bad_records(
    spark: SparkSession, path: str, width: int, options: dict[str, object], quarantine: str
) -> DataFrame:
    """Cells of the good records; the others are written to ``quarantine`` as they stand in the files."""
    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    # Every record of another length than the header comes with its text. Spark must not skip columns here: it would
    # count the cells of those that it reads.
    raw = (
        spark.read.schema(T.StructType([*cells, T.StructField(_RECORD, T.StringType())]))
        .options(**options, columnNameOfCorruptRecord=_RECORD, columnPruning=False)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))
    )
    record = F.col(_RECORD)
    # Cells are counted in the text: quoted ones without their content, and empty ones at the end do not count.
    plain = F.regexp_replace(F.regexp_replace(record, _QUOTED, "$1q"), ",+$", "")
    open_quote = plain.rlike('(?:^|,) *"')
    # A record that is its own first cell is short. (Spark also refuses plans that read nothing but the record.)
    longer = ~record.eqNullSafe(F.col("c0")) & (F.length(F.regexp_replace(plain, "[^,]", "")) >= width)
    reason = F.when(open_quote, "quote not closed").when(longer, "longer than the header")
    judged = raw.withColumn("reason", F.when(record.isNotNull(), reason))
    bad = judged.where("reason is not null").select("file", "block_start", "reason", record.alias("record"))
    bad.write.parquet(quarantine)
    return judged.where("reason is null").select(*(c.name for c in cells), F.lit(None).cast("string").alias(_SURPLUS))


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    infer: bool = True,
    multi_line: bool = False,
    quarantine: str | None = None,
) -> DataFrame:
    """CSV with a header. Missing-value tokens become NULL, then types are inferred.

    Dates stay text. ``multi_line`` accepts line breaks inside quotes, at the price of one
    task per file. Rows shorter than the header are padded; longer ones are refused.

    ``quarantine`` names a new folder that takes records longer than the header, and shorter ones whose quote is not
    closed, in place of the refusal: a Parquet table of file, start of its block, reason and record. All others are
    loaded. It needs another pass over the lines and does not go with ``multi_line``.
    """
    if quarantine and multi_line:
        raise ValueError("quarantine goes by lines; it needs multi_line=False")
    names = _header(spark, path)
    _same_headers(spark, path)
    width = len(names)
    # One column more than the header shows rows that are too long.
    schema = T.StructType(
        [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
        + [T.StructField(_SURPLUS, T.StringType())]
    )
    options = {"header": True, "enforceSchema": True, "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE"}
    if quarantine:
        raw = _without_bad_records(spark, path, width, options, quarantine)
    else:
        raw = spark.read.schema(schema).options(**options).csv(path)
    cells = raw.select(*(na_to_null(F.col(f"c{i}")).alias(f"c{i}") for i in range(width)), _SURPLUS)
    types = _infer(cells, width, path) if infer else ["string"] * width
    typed = [
        F.col(f"c{i}") if t == "string" else F.trim(F.col(f"c{i}")).try_cast(t)
        for i, t in enumerate(types)
    ]
    return cells.select(*(c.alias(f"c{i}") for i, c in enumerate(typed))).toDF(*names)


def read_data(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    *,
    infer: bool = True,
    multi_line: bool = False,
    quarantine: str | None = None,
) -> DataFrame:
    """Load a table by its file suffix (or ``fmt``). ``quarantine`` takes bad records of CSV files (see ``read_csv``).

    Raises FileNotFoundError for a missing path and DataLoadError for anything unreadable.
    """
    path = str(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such path: {path}")
    kind = format_of(path, fmt)
    try:
        if kind == "csv":
            return read_csv(spark, path, infer=infer, multi_line=multi_line, quarantine=quarantine)
        return spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        raise DataLoadError(f"cannot read {path}: {error}") from error


def _csv_ready(df: DataFrame) -> DataFrame:
    """Cells that CSV can hold: nested values as JSON, times without idle digits."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    moments = (T.TimestampType, T.TimestampNTZType)

    def cell(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, nested):
            return F.to_json(c).alias(field.name)
        return c.cast("string").alias(field.name) if isinstance(field.dataType, moments) else c

    return df.select(*(cell(f) for f in df.schema.fields))


def write_data(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    *,
    mode: str = "overwrite",
    single_file: bool = False,
) -> None:
    """Write a table as a directory of files; one file only on request, for small results."""
    path = str(path)
    kind = format_of(path, fmt)
    out = df.coalesce(1) if single_file else df
    try:
        if kind == "parquet":
            out.write.mode(mode).parquet(path)
        else:
            (
                _csv_ready(out)
                .write.mode(mode)
                .option("header", True)
                .option("escape", '"')
                .csv(path)
            )
    except (PySparkException, Py4JJavaError) as error:
        raise DataLoadError(f"cannot write {path}: {error}") from error


def default_output(path: str) -> str:
    """``dir/name.ext`` becomes ``dir/name_cleaned.ext``."""
    head, slash, name = str(path).rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    return f"{head}{slash}{stem}_cleaned{dot}{suffix}" if dot else f"{head}{slash}{name}_cleaned"


def job_output(base: str, job_id: str, prefix: str = "", name: str = "cleaned.csv") -> str:
    """Object-store target of a job: the prefix comes once, then job and file name."""
    parts = [p.strip("/") for p in (prefix, job_id, name)]
    if parts[0] and parts[1].startswith(parts[0] + "/"):
        parts = parts[1:]
    return "/".join([base.rstrip("/"), *(p for p in parts if p)])
