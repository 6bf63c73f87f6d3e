"""Cleaning streams with a model fitted on a batch table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from washline.functions.names import quoted
from washline.plans.model import CleaningModel


def read_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: object
) -> DataFrame:
    """Files arriving in a folder, as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def clean_stream(
    stream: DataFrame,
    model: CleaningModel,
    *,
    event_time: str | None = None,
    delay: str = "1 hour",
    subset: Sequence[str] | None = None,
) -> DataFrame:
    """Apply the model row by row.

    With ``event_time`` repeated rows (of ``subset``, default all columns) that arrive
    within ``delay`` are dropped; the watermark bounds the state.
    """
    if any(f.kind == "forward" for f in model.fills.values()):
        raise ValueError("forward fill needs the whole table and cannot run on a stream")
    if event_time:
        # Watermarks need an instant; a timestamp without zone is read in the session zone.
        keys = list(subset or stream.columns)
        timed = stream.withColumn("__event_time", quoted(event_time).cast("timestamp"))
        distinct = timed.withWatermark("__event_time", delay).dropDuplicatesWithinWatermark(keys)
        stream = distinct.drop("__event_time")
    return model.transform(stream)


def write_stream(
    cleaned: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False
) -> StreamingQuery:
    """Append cleaned rows to a folder; ``once`` handles what is there and stops."""
    writer = (
        cleaned.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
