"""Exact deduplication as a stream with disk-backed keyed state that never expires.

Documents arrive as files of a stream. The state keeps, for each digest of the normalised
text, the content locator and stable identifier of the row that stays, and a count. It lies in
RocksDB on the executors, its checkpoints in the shared folder, so memory does not grow with
the number of texts and a lost executor reloads its part. Rows of one digest are combined in each
task before they reach the state: a text in a third of all rows costs one update per task.

A digest that is met again is a hit. Hits are checked on their full text against the text at
the stored locator; rows whose text differs after all are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.llm.common import bit_set, bitmap_of, shared_folder, stage

#: Bits of the map that drops texts without a hit before they are shuffled.
FILTER_BITS = 26
#: Rows of a group that are compared in one go.
COMPARED = 256
#: Files are taken up in batches of about this size.
BATCH_BYTES = 64 << 30


def normalised(text: Column) -> Column:
    """The text without characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest_chars: int) -> DataFrame:
    # The names cannot clash with columns of the documents: only these are selected.
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"),
        normalised(text).alias("norm"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).withColumn("sha256", F.sha2(F.encode("norm", "UTF-8"), 256)).withColumn("digest", F.left("sha256", F.lit(digest_chars)))


def _first_of() -> Column:
    """Order in which rows of one text stay: most characters, smallest id (null last), place in the input."""
    return F.struct((-F.col("chars")).alias("fewer"), F.col("id").isNull().alias("missing"), "id", "file", "row")


def digest_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest_chars: int, batch_bytes: int) -> DataFrame:
    """Run the stream over the Parquet files at ``path`` and return its state: digest, keep, n."""
    schema = spark.read.parquet(path).schema
    session = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        # Many small stores would reserve more disk than they fill.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }.items():
        session.conf.set(key, value)
    # A pattern takes a single file as well as a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    arriving = session.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern)
    state = (
        _keyed(arriving, id_col, text_col, digest_chars)
        .groupBy("digest")
        .agg(F.min(_first_of()).alias("keep"), F.count("*").alias("n"))
    )
    checkpoint = shared_folder(spark, "dedup-state")
    run = (
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    if not run.recentProgress or run.lastProgress is None or not run.lastProgress["stateOperators"]:
        empty = session.read.schema(schema).parquet(path).limit(0)
        return empty.select(
            F.lit("").alias("digest"), F.struct(F.lit(0).alias("fewer"), F.lit(False).alias("missing"), F.col(id_col).alias("id"), F.lit("").alias("file"), F.lit(0).cast("long").alias("row")).alias("keep"), F.lit(0).cast("long").alias("n"),
        )
    stored = spark.read.format("statestore").load(checkpoint)
    keep, n = stored.schema["value"].dataType.names
    return stored.select("key.digest", F.col(f"value.{keep}").alias("keep"), F.col(f"value.{n}").alias("n"))


def exact_duplicates(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_chars: int = 64,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row for each row of the Parquet table at ``path``: id, keep_id, group_size, kept, text_sha256, file, row.

    Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]``; null is empty. Of equal
    texts the row with the most code points stays, then the smallest id (null last), then the
    first in the input, so of repeated rows exactly one stays. ``digest_chars`` shortens the
    digest in the state (for tests of colliding digests).
    """
    state = stage(digest_state(spark, path, id_col, text_col, digest_chars, batch_bytes), "digests")
    docs = _keyed(spark.read.parquet(path), id_col, text_col, digest_chars)
    narrow = docs.select("id", "chars", "sha256", "digest", "file", "row")
    members = stage(narrow.join(state, "digest"), "members")

    # Full texts of hits only.
    low = (1 << FILTER_BITS) - 1
    hits = state.where("n > 1")
    bits = spark.sparkContext.broadcast(
        bitmap_of(hits.select(F.xxhash64("digest").bitwiseAND(F.lit(low)).alias("cell")), FILTER_BITS)
    )

    def with_hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bit_set(bits.value, batch.column(0).to_numpy().astype(np.int64))))

    texts = docs.select(
        F.xxhash64("digest").bitwiseAND(F.lit(low)).alias("cell"), "id", "chars", "digest", "norm", "file", "row"
    )
    kind = docs.schema["id"].dataType.simpleString()
    texts = texts.mapInArrow(with_hit, f"cell long, id {kind}, chars int, digest string, norm string, file string, row long")
    part = F.pmod(F.xxhash64("file", "row"), F.ceil(F.col("n") / COMPARED))
    met = texts.join(hits, "digest").withColumn("part", part)
    return _settle(spark, met, members, id_col)


def _settle(spark: SparkSession, met: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    met = stage(met.drop("cell"), "hits")
    is_keeper = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    stored = met.where(is_keeper).select(
        F.col("digest").alias("d2"),
        F.col("norm").alias("stored"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / COMPARED).cast("long") - 1)).alias("p2"),
    )
    differ = stage(
        met.join(stored, (F.col("digest") == F.col("d2")) & (F.col("part") == F.col("p2")))
        .where("norm <> stored")
        .select("id", "chars", "digest", "norm", "file", "row"),
        "differ",
    )
    result = members
    if differ.limit(1).count():  # different texts with one digest
        own = differ.groupBy("digest", "norm").agg(F.min(_first_of()).alias("own_keep"), F.count("*").alias("own_n"))
        moved = differ.join(own, ["digest", "norm"]).select("file", "row", "own_keep", "own_n")
        left = differ.groupBy("digest").agg(F.count("*").alias("gone"))
        result = (
            members.join(moved, ["file", "row"], "left")
            .join(left, "digest", "left")
            .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))))
            .withColumn("keep", F.coalesce("own_keep", "keep"))
        )
    return result.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "file",
        "row",
    )
