"""Shared helpers: staged tables, Arrow columns, blocked row ranges, bounded bitmaps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.staging import staging_root

#: The separators of the word rule ``[^\x20\x09-\x0D]+`` as a Java and RE2 class.
SEPARATORS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on, unless a single row is longer.
CHUNK_BYTES = 2_000_000


def shared_path(spark, name: str) -> str:
    """A new path in the folder that every executor reaches."""
    return f"{staging_root(spark).rstrip('/')}/washline-llm/{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("washline_llm_scope", default=None)


def _delete(spark, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging_scope(spark) -> Iterator[None]:
    """Delete on exit what operators staged inside the block; write their result before it ends."""
    token = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            _delete(spark, path)
        _scope.reset(token)


def shared_folder(spark, name: str) -> str:
    """A new path in the shared folder that belongs to the surrounding scope, if there is one."""
    path = shared_path(spark, name)
    if _scope.get() is not None:
        _scope.get().append(path)
    return path


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, such as the state of the round before."""
    _delete(staged.sparkSession, staged.staged_path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def located(docs: DataFrame, name: str) -> DataFrame:
    """Add the place of each row in its files; a frame that does not come from files is staged first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stage(docs, "documents")
    place = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))
    return docs.select("*", place.alias(name))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one longer row."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(rows, max(i + 1, j))
        yield i, j
        i = j


def batch_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of the text column of a batch."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    for i, j in row_ranges(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary cells from one buffer; ``offsets`` in bytes."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


_SEGMENT_BITS = 20


def bitmap_of(cells: DataFrame, bits: int) -> np.ndarray:
    """Bitmap (packed, ``2**bits`` bits) of the long column ``cell``, merged by segments on the executors.

    What reaches the driver is at most ``2**bits / 8`` bytes, whatever the number of rows.
    """
    seg_bits = min(bits, _SEGMENT_BITS)
    low = (1 << seg_bits) - 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            segment = cell >> seg_bits
            for s in np.unique(segment):
                maps.setdefault(int(s), np.zeros(1 << seg_bits, bool))[cell[segment == s] & low] = True
        for s, found in maps.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())],
                names=["segment", "bits"],
            )

    segments = max(1, (1 << bits) >> seg_bits)
    parts = (
        cells.select(F.col("cell").cast("long").alias("cell"))
        .repartition(min(segments, 4096), F.shiftright("cell", seg_bits))
        .mapInArrow(merge, "segment long, bits binary")
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << seg_bits) // 8
    for row in parts.toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def bit_set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the bits at ``cells`` are set."""
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
