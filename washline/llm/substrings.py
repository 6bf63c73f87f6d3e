"""Removal of passages that an earlier document already has, with a count-min prefilter.

A window is ``width`` consecutive words. Every window has an anchor, the smallest hash of its
``ANCHOR`` consecutive words: equal windows have equal anchors, and neighbouring windows mostly
share theirs, so a document has few anchors.

1. Each task counts its documents' anchors (once for each document) in count-min rows. The
   sketches are merged by segments; a cell of at least two documents is a set bit. A
   window's count is never above that of its anchor, nor that above its cells, so a
   repeated window is never lost. A second bit marks cells of very many documents.
2. A second pass takes only windows whose anchor has all its bits set. Within a task every
   occurrence but the one in the smallest document is marked at once; the remaining ones go to
   the task of their anchor, which groups them exactly and marks those with a smaller
   document elsewhere. So a passage in a third of all documents sends one row from each task.
   Windows of an anchor of very many documents are dealt by their own hash instead: near
   copies share anchors, but differ in windows.
3. A last pass removes the words that marked windows cover.

Windows are told apart by anchor and a second hash, both of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import batch_chunks, bit_set, shared_path
from washline.llm.textarrays import U64, mix, window_hashes, window_rows, word_hashes, words

#: Words of an anchor, count-min rows, and cells of a row as a power of two (bits that every task holds: ROWS << BITS).
ANCHOR, ROWS, BITS = 10, 2, 25
_SEGMENT = 20
#: Documents from which an anchor is dealt by windows, and into how many parts.
HOT, HOT_PARTS = 48, 64
_LAST = np.iinfo(np.int64).max


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchored_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of all windows: row, position in the row, anchor and hash; then the word bounds of the rows."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    at, row = window_rows(first, width)
    if not len(at):
        empty = np.empty(0, U64)
        return row, at, empty, empty, first
    part = min(ANCHOR, width)
    anchors = _sliding_min(mix(window_hashes(hashes, part)), width - part + 1)
    return row, at - first[:-1][row], anchors[at], window_hashes(hashes, width)[at], first


def _cell(anchor: np.ndarray, row: int) -> np.ndarray:
    return (mix(anchor * U64(2 * row + 3)) >> U64(64 - BITS)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Bitmaps [kind, row] of the cells that at least two, and that ``HOT`` documents hit; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        size = 0
        for batch in batches:
            for _, _, data, offsets in batch_chunks(batch, "text"):
                row, _, anchor, _, _ = anchored_windows(data, offsets, width)
                fresh = np.ones(len(anchor), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                row, anchor = row[fresh], anchor[fresh]
                order = np.lexsort((anchor, row))  # an anchor counts once for each document
                row, anchor = row[order], anchor[order]
                fresh = np.ones(len(anchor), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                for r in range(ROWS):
                    held[r].append(_cell(anchor[fresh], r))
                size += int(fresh.sum())
                if size > 4_000_000:
                    yield from partial(held)
                    held, size = [[] for _ in range(ROWS)], 0
        yield from partial(held)

    def partial(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for r, parts in enumerate(held):
            cells, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64),) * 2
            segment = cells >> _SEGMENT
            for s in np.unique(segment):
                mine = segment == s
                inside = (cells[mine] & ((1 << _SEGMENT) - 1)).astype(np.uint32)
                inside |= np.minimum(n[mine], HOT).astype(np.uint32) << np.uint32(_SEGMENT)  # more than HOT tells nothing more
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(r << (BITS - _SEGMENT)) + int(s)], pa.int64()), pa.array([inside.tobytes()], pa.binary())],
                    names=["segment", "cells"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = np.frombuffer(cells.as_buffer(), np.uint32)
                at = cells & np.uint32((1 << _SEGMENT) - 1)
                total = counts.setdefault(s, np.zeros(1 << _SEGMENT, np.uint8))
                total[at] = np.minimum(total[at] + (cells >> np.uint32(_SEGMENT)).astype(np.uint8), HOT)
        for s, total in counts.items():
            for kind, least in enumerate((2, HOT)):
                bits = np.packbits(total >= least, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind * segments + s], pa.int64()), pa.array([bits], pa.binary())], names=["segment", "bits"]
                )

    segments = ROWS << (BITS - _SEGMENT)
    merged = (
        docs.select("text").mapInArrow(count, "segment long, cells binary").repartition(segments, "segment").mapInArrow(
            merge, "segment long, bits binary"
        )
    )
    size = (1 << _SEGMENT) // 8
    out = np.zeros(2 * (ROWS << BITS) // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(2, ROWS, -1)


def _in_all(bitmaps: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether the cells of the anchors are set in all rows."""
    found = np.ones(len(anchors), bool)
    for r in range(ROWS):
        found[found] = bit_set(bitmaps[r], _cell(anchors[found], r))
    return found


def _spans(positions: np.ndarray, width: int) -> np.ndarray:
    """Word ranges (start, end, start, end ...) that windows at these sorted positions cover."""
    cut = np.flatnonzero(np.diff(positions) > width)
    lo = positions[np.concatenate([[0], cut + 1])]
    hi = positions[np.concatenate([cut, [len(positions) - 1]])] + width
    return np.stack([lo, hi], 1).ravel()


def _grouped(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and document, and in that order whether the key has a smaller document."""
    order = np.lexsort((doc, *key.T))
    key, doc = key[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, doc > least


def marked_windows(docs: DataFrame, width: int, repeated: np.ndarray) -> DataFrame:
    """(key, spans) of documents: word ranges covered by windows that a smaller document has."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    partitions = docs.sparkSession.sparkContext.defaultParallelism

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            keys = batch.column(1).to_numpy()
            ids = batch.column(0).fill_null(_LAST).to_numpy()
            for i, j, data, offsets in batch_chunks(batch, "text"):
                row, position, anchor, window, _ = anchored_windows(data, offsets, width)
                maybe = _in_all(shared.value[0], anchor)
                row = row[maybe] + i
                held.append((ids[row], keys[row], position[maybe].astype(np.int32), anchor[maybe], window[maybe]))
                size += len(row)
                if size > 3_000_000:
                    yield from resolve(held)
                    held, size = [], 0
        yield from resolve(held)

    def resolve(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not sum(len(x[0]) for x in held):
            return
        ids, keys, position, anchor, window = (np.concatenate(x) for x in zip(*held))
        order, known = _grouped(np.stack([anchor, window], 1), ids)
        # Settled here: by document, as spans.
        settled = order[known]
        if len(settled):
            yield spans_table(ids[settled], keys[settled], position[settled])
        # Open: runs of windows of one document with one anchor, and for hot anchors one part of the hashes.
        mask = np.zeros(len(ids), bool)
        mask[order[~known]] = True
        ids, keys, position, anchor, window = (x[mask] for x in (ids, keys, position, anchor, window))
        part = np.where(_in_all(shared.value[1], anchor), window % U64(HOT_PARTS), U64(0))
        order = np.lexsort((position, part, anchor, keys, ids))
        ids, keys, position, anchor, window, part = (x[order] for x in (ids, keys, position, anchor, window, part))
        deal = mix(anchor + part)
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        bounds = np.append(at, len(ids)).astype(np.int32)
        for lo in range(0, len(at), 20_000):
            hi = min(len(at), lo + 20_000)
            a, b = bounds[lo], bounds[hi]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at[lo:hi]]), pa.array(keys[at[lo:hi]]), pa.array(anchor[at[lo:hi]].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds[lo : hi + 1] - a), pa.array(position[a:b])),
                    pa.ListArray.from_arrays(pa.array(bounds[lo : hi + 1] - a), pa.array(window[a:b].view(np.int64))),
                    pa.array(deal[at[lo:hi]].view(np.int64)),
                ],
                schema=_OPEN,
            )

    def spans_table(ids: np.ndarray, keys: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((position, keys, ids))
        ids, keys, position = ids[order], keys[order], position[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(new)
        spans = [_spans(p, width) for p in np.split(position, at[1:])]
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[at]), pa.array(keys[at]), pa.array(np.zeros(n, np.int64)),
                pa.array([x.astype(np.int32) for x in spans], pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
                pa.array(keys[at]),
            ],
            schema=_OPEN,
        )

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = batch.column(4).is_null()
            yield pa.RecordBatch.from_arrays([batch.filter(settled).column(k) for k in (0, 1, 3)], schema=_MARKED)
            batch = batch.filter(pa.compute.invert(settled))
            n = np.diff(batch.column(3).offsets.to_numpy())
            held.append(
                (
                    np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n),
                    batch.column(3).flatten().to_numpy(), np.repeat(batch.column(2).to_numpy(), n),
                    batch.column(4).flatten().to_numpy(),
                )
            )
        if not sum(len(x[0]) for x in held):
            return
        ids, keys, position, anchor, window = (np.concatenate(x) for x in zip(*held))
        order, known = _grouped(np.stack([anchor, window], 1), ids)
        marked = order[known]
        if len(marked):
            found = spans_table(ids[marked], keys[marked], position[marked])
            yield pa.RecordBatch.from_arrays([found.column(k) for k in (0, 1, 3)], schema=_MARKED)

    opened = docs.mapInArrow(first_pass, "id long, key long, anchor long, at array<int>, windows array<long>, deal long")
    parts = max(partitions, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return opened.repartition(parts, "deal").mapInArrow(second_pass, "id long, key long, spans array<int>")


_OPEN = pa.schema(
    [
        ("id", pa.int64()), ("key", pa.int64()), ("anchor", pa.int64()), ("at", pa.list_(pa.int32())),
        ("windows", pa.list_(pa.int64())), ("deal", pa.int64()),
    ]
)
_MARKED = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.int32()))])


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, keep_text: bool = False
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) for every row of ``docs``.

    A word goes if a window of ``width`` words that covers it also starts in a row with a smaller
    id. Ids are whole numbers. A null id counts as larger than all others; rows with equal ids do
    not remove each other's words. A null or blank text has no words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    marks = marked_windows(rows, width, sketch(rows, width))
    path = shared_path(docs.sparkSession, "spans")
    marks.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")).write.parquet(path)
    spans = docs.sparkSession.read.schema("key long, spans array<int>").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in batch_chunks(batch, "text"):
                starts, ends, first = words(data, offsets)
                cut = batch.column(2).slice(i, j - i)
                total, removed, digest, kept_texts = np.diff(first), np.zeros(j - i, np.int64), [], []
                for r in range(j - i):
                    a, n = first[r], int(total[r])
                    keep = np.ones(n, bool)
                    if cut[r].is_valid:
                        ranges = np.array(cut[r].values, np.int64).reshape(-1, 2)
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, ranges[:, 0], 1)
                        np.add.at(step, ranges[:, 1], -1)
                        keep = np.cumsum(step[:-1]) == 0
                        removed[r] = n - np.count_nonzero(keep)
                    kept = _joined(data, starts[a : a + n][keep], ends[a : a + n][keep])
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        kept_texts.append(kept.decode())
                columns = [batch.column(0).slice(i, j - i), pa.array(total.astype(np.int64)), pa.array(removed), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.string())] * keep_text, names=names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.withColumn("_id", F.col("id").cast(kind)).join(spans.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    return joined.select("_id", "text", "spans").mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    )


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words with one space between them."""
    if not len(starts):
        return b""
    length = ends - starts + 1
    bounds = np.cumsum(length)
    at = np.arange(int(bounds[-1])) + np.repeat(starts - (bounds - length), length)
    out = data[np.minimum(at, len(data) - 1)]
    out[bounds - 1] = 0x20
    return out[:-1].tobytes()
