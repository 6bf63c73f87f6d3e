"""File-to-file cleaning."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import SparkSession

from washline import staging
from washline.plans.cleaning import run_cleaning
from washline.plans.config import CleaningConfig, CleaningResult
from washline.sources.files import default_output, format_of, read_data, write_data


def clean_file(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    config: CleaningConfig | None = None,
    *,
    single_file: bool = False,
    **read_options: object,
) -> CleaningResult:
    """Read, clean, write. The output format follows the output suffix.

    Nothing is written if the input is missing, unreadable or empty.
    """
    output_path = output_path or default_output(input_path)
    format_of(output_path)
    table = read_data(spark, input_path, **read_options)
    with staging.stage_scope(spark):
        run = run_cleaning(table, config, complete=False)
        write_data(run.table, output_path, single_file=single_file)
    known = {f.name for f in fields(CleaningResult)}
    return CleaningResult(**{k: v for k, v in run.summary.items() if k in known})
