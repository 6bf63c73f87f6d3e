"""Session settings this library is tested with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS: Mapping[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_TASK_BYTES = 256 * 1024 * 1024
_MOST_TASK_BYTES = 2 * 1024 * 1024 * 1024
_MOST_PARTITIONS = 50_000


def cluster_settings(input_bytes: int) -> dict[str, str]:
    """Settings for a table of this size: enough shuffle partitions for tasks to fit in memory.

    Partitions are of 256 MB up to 2,000 of them, then grow to 2 GB, and are at most 50,000:
    map status on the driver grows with partitions times tasks.

    Adaptive execution merges partitions that turn out small, but never splits large ones,
    so the number must be right for the largest shuffle: the whole rows of a table.
    """
    fine, coarse = -(-input_bytes // _TASK_BYTES), -(-input_bytes // _MOST_TASK_BYTES)
    partitions = min(_MOST_PARTITIONS, max(200, min(fine, max(2_000, coarse))))
    return {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions)}


def local_session(cores: int | str = 8, name: str = "washline", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
