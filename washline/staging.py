"""Staged tables: written once to shared storage, read back as columnar scans.

A staged table cuts lineage the way ``DataFrame.checkpoint`` does, but the next
passes read only the columns they need. It lives under ``spark.checkpoint.dir``,
so losing executors never loses it.

Every staged table belongs to a scope. ``stage_scope`` opens one for the block (and the
thread) it is in; a cleaning run has its own, which its result hands out. Scopes know
only their own tables, so runs side by side never delete each other's.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from washline.errors import CleanIOError

_SETTING = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables; a local session without one gets a temporary folder."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise CleanIOError(f"set {_SETTING} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="washline-"))
    return spark.sparkContext.getCheckpointDir()


class StageScope:
    """Owner of staged tables."""

    def __init__(self) -> None:
        self._paths: list[str] = []
        self._lock = threading.Lock()

    def paths(self) -> list[str]:
        """Paths of the tables not yet released, oldest first."""
        with self._lock:
            return list(self._paths)

    def stage(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{staging_root(spark).rstrip('/')}/washline/{uuid.uuid4().hex}"
        # Positional names keep blank, duplicate and case-colliding names out of the files.
        names = [f"f{i}" for i in range(len(df.columns))]
        with self._lock:
            self._paths.append(path)
        df.toDF(*names).write.parquet(path)
        schema = T.StructType(
            [T.StructField(n, f.dataType, True) for n, f in zip(names, df.schema.fields)]
        )
        return spark.read.schema(schema).parquet(path).toDF(*df.columns)

    def release(self, spark: SparkSession, paths: list[str] | None = None) -> None:
        """Delete tables (all of them by default). Frames built on them stop working."""
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths() if paths is None else paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            with self._lock:
                if path in self._paths:
                    self._paths.remove(path)


_default = StageScope()
_current: ContextVar[StageScope | None] = ContextVar("washline_stage_scope", default=None)


def default_scope() -> StageScope:
    return _default


def current_scope() -> StageScope:
    return _current.get() or _default


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the staging folder and return a scan of the written files."""
    return current_scope().stage(df)


def staged_paths() -> list[str]:
    """Paths staged in the scope of the caller and not yet released, oldest first."""
    return current_scope().paths()


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged tables of the caller's scope (all of them by default)."""
    current_scope().release(spark, paths)


@contextmanager
def use_scope(scope: StageScope) -> Iterator[StageScope]:
    """Stage into ``scope`` inside the block."""
    token = _current.set(scope)
    try:
        yield scope
    finally:
        _current.reset(token)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[StageScope]:
    """Delete on exit whatever was staged inside the block, by this thread."""
    with use_scope(StageScope()) as scope:
        try:
            yield scope
        finally:
            scope.release(spark)
