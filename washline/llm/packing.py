"""Mixture-controlled packing of documents into fixed windows of token ids.

Every source is a queue of token ids. Deficit round-robin fills each window: a source earns
its share of the window, takes as many whole ids as it has earned, and what it earned but
did not get is carried on, so at any window boundary no source is more than an id away from
its entitlement. The service of a queue up to window ``w`` depends on ``w``, the weights and
the queue lengths alone. Tasks therefore compute the state at any boundary directly instead
of receiving it from the task before: deficits carry across windows and partitions exactly,
and no pass over the windows is sequential. When a queue runs dry, the others share on.

Ids are computed once and staged. Only one row for each task and source is shuffled; these rows
are broadcast if they are few enough, and the ids stay where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washline.llm.common import row_ranges, shared_folder, stage, text_buffer

#: Different pieces of text whose ids a worker remembers: so many met lately, and as many met before them.
REMEMBERED = 300_000
#: Bytes of text that are split and looked up together.
CHUNK_BYTES = 4_000_000
#: Sources a window can hold proportions of; more raise an error instead of a large driver table.
MAX_SOURCES = 10_000
_BLOCK = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def piece_bounds(data: np.ndarray, offsets: np.ndarray, literals: tuple[tuple[bytes, bool], ...] = ()) -> np.ndarray:
    """Byte positions where the text may be cut without changing its ids.

    The pre-tokenizer never joins a non-space with a space after it, nor an ASCII letter with
    an ASCII character after it that is no letter. Characters with a lead byte that also begins
    Unicode spaces are never cut behind. ``literals`` of added tokens are never cut, nor cut off from
    what is beside them if the token looks there (the flag).
    """
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    before, after = data[:-1], data[1:]
    plain = (before > 0x20) & (before < 0x7F)
    # A continuation byte ends a character; look at its lead byte if that is next to it.
    latin = np.zeros(n - 1, bool)
    latin[1:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (before[1:] >= 0x80)
    cut = (plain | latin) & _SPACE[after]
    cut |= _LETTER[before] & (after < 0x80) & ~_LETTER[after]
    mask = np.zeros(n + 1, bool)
    mask[1:n] = cut
    raw = data.tobytes() if literals else b""
    for literal, beside in literals:
        at = raw.find(literal)
        while at >= 0:
            mask[at + (not beside) : at + len(literal) + beside] = False
            at = raw.find(literal, at + 1)
    mask[offsets] = True
    return np.flatnonzero(mask)


class Encoder:
    """Ids of many texts at once; equal pieces of text are looked up, new ones go to the tokenizer.

    With ``special`` the literal of a special token gets the token's id, as the tokenizer does by
    default; without it is text like any other.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.literals = tuple(
            (t.content.encode(), t.lstrip or t.rstrip or t.single_word)
            for t in self.tokenizer.get_added_tokens_decoder().values()
            if t.content and (special or not t.special)
        )
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.uint32 if self.wide else np.uint16
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the bounds of the rows in it."""
        cuts = piece_bounds(data, offsets, self.literals)
        if len(cuts) < 2:
            return np.empty(0, self.dtype), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(
            pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        different = pieces.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for x in different:
            if x not in known:
                if x in older:
                    known[x] = older[x]
                else:
                    new.append(x)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            for text, ids in zip(part, found):
                known[text] = np.array(ids.ids, self.dtype).tobytes()
        cells = [known[x] for x in different]
        size = np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(cells), self.dtype)
        length = np.array([len(c) for c in cells], np.int64) // size
        begin = np.cumsum(length) - length
        which = pieces.indices.to_numpy()
        n = length[which]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(begin[which] - (ends - n), n)
        bounds = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        return flat[at], bounds


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, special=True)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Stage (task, id, source, n, begin, ids): the ids of each row, and its place among its task's rows of the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        taken: dict[str | None, int] = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            sources = batch.column(1).to_pylist()
            for i, j in row_ranges(offsets, CHUNK_BYTES):
                ids, bounds = encode.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(j - i + 1)
                n = np.diff(bounds)
                begin = np.empty(j - i, np.int64)
                for r in range(j - i):
                    source = sources[i + r]
                    begin[r] = taken.get(source, 0)
                    taken[source] = int(begin[r] + n[r])
                cells = pa.Array.from_buffers(
                    pa.large_binary(), j - i, [None, pa.py_buffer(bounds * ids.itemsize), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(j - i, task, np.int64)), batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i), pa.array(n), pa.array(begin), pc.cast(cells, pa.binary()),
                    ],
                    names=["task", "id", "source", "n", "begin", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"task long, id {kind}, source string, n long, begin long, ids binary"
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")
    )
    path = shared_folder(docs.sparkSession, "ids")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


#: Rows (one for each task and source) up to which the counts before a task are broadcast: some 20 MB.
AHEAD_ROWS = 250_000


class RoundRobin:
    """Ids that each queue has given when window ``w`` begins.

    A queue's next id is due when its share has grown to half an id past what it gave. ``served``
    takes all ids due before the moment at which the window is full; of the queues that tie at
    that moment the first in order go first. Counts never fall from one window to the next and
    always sum to ``w`` windows.
    """

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, size: int):
        self.lengths, self.size = lengths.astype(np.int64), size
        self.weights = np.maximum(weights.astype(np.float64), 1e-300)
        self.total = int(self.lengths.sum())
        self.end = float((self.lengths / self.weights).max()) + 1 if len(lengths) else 1.0

    def due(self, moment: np.ndarray) -> np.ndarray:
        return np.minimum(self.lengths, np.floor(moment[:, None] * self.weights + 0.5).astype(np.int64))

    def served(self, windows: np.ndarray) -> np.ndarray:
        want = np.minimum(windows.astype(np.int64) * self.size, self.total)
        low, high = np.zeros(len(want)), np.full(len(want), self.end)
        # Halve down to neighbouring floats, in the order of their bits.
        a, b = low.view(np.int64).copy(), high.view(np.int64).copy()
        while np.any(b - a > 1):
            mid = a + (b - a) // 2
            enough = self.due(mid.view(np.float64)).sum(1) > want
            a, b = np.where(enough, a, mid), np.where(enough, mid, b)
        base = self.due(a.view(np.float64))
        spare = self.due(b.view(np.float64)) - base
        rest = (want - base.sum(1))[:, None]
        return base + np.clip(rest - (np.cumsum(spare, 1) - spare), 0, spare)


class Schedule:
    """Blocks of window boundaries, computed when asked for."""

    def __init__(self, robin: RoundRobin):
        self.robin = robin
        self.windows = -(-robin.total // robin.size)
        self._block = lru_cache(maxsize=64)(self._compute)

    def _compute(self, block: int) -> np.ndarray:
        first = block * _BLOCK
        return self.robin.served(np.arange(first, min(first + _BLOCK, self.windows) + 1))

    def block(self, block: int) -> np.ndarray:
        return self._block(block)

    def find(self, source: int, position: int) -> int:
        """Block of windows in which the queue gives its id at ``position``."""
        lo, hi = 0, (self.windows - 1) // _BLOCK
        guess = int(position / max(int(self.robin.lengths[source]), 1) * (hi + 1))
        for near in (guess, guess - 1, guess + 1):
            if 0 <= near <= hi and self.block(near)[0, source] <= position < self.block(near)[-1, source]:
                return near
        while lo < hi:
            mid = (lo + hi) // 2
            if self.block(mid)[-1, source] <= position:
                lo = mid + 1
            else:
                hi = mid
        return lo


def last_sequences(rest: int) -> list[int]:
    """Lengths of the sequences for ids that fill no window: powers of two, which need no padding."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it is in the document and in the sequences.

    ``weights`` are the proportions of the sources in a window; by default each source's share of
    all ids, so that all queues end together. A null text is empty and gives its end id alone; a
    null source is a queue of its own (the last); repeated rows are packed each. Without rows, no
    pieces. Ids are those the tokenizer gives the whole text by default: the literal of an added token
    is that token. ``keep_ids`` adds the ids of the piece as an array.
    """
    spark = docs.sparkSession
    rows = tokenize(docs, tokenizer, end_id, id_col, text_col, source_col)
    by_task = rows.groupBy("task", "source").agg(F.sum("n").alias("n"))
    # One row for each source, bounded by MAX_SOURCES.
    sources = by_task.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before packing")
    sources = sorted(sources, key=lambda r: (r["source"] is None, r["source"] or ""))
    order = {r["source"]: k for k, r in enumerate(sources)}
    lengths = np.array([r["n"] for r in sources], np.int64)
    share = lengths if weights is None else np.array([weights.get(r["source"], 1e-9) for r in sources])
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_task.select(
        F.col("task").alias("_task"), F.col("source").alias("_source"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    ahead = stage(ahead, "ahead")
    if ahead.count() <= AHEAD_ROWS:  # beyond that a plain join, whose skewed keys Spark splits
        ahead = F.broadcast(ahead)
    placed = rows.join(ahead, (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "source", "n", (F.col("begin") + F.col("ahead")).alias("begin"), "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(RoundRobin(lengths, share, size))
        full, rest = divmod(schedule.robin.total, size)
        tail = np.cumsum([0, *last_sequences(rest)])
        for batch in batches:
            n_of, begin_of = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            source_of = [order[s] for s in batch.column(1).to_pylist()]
            ids_of = batch.column(4)
            row, start, length, window, offset = [], [], [], [], []
            for r in range(batch.num_rows):
                s, at, end = source_of[r], int(begin_of[r]), int(begin_of[r] + n_of[r])
                first, block = at, schedule.find(source_of[r], int(begin_of[r]))
                while at < end:
                    table = schedule.block(block)
                    edge = table[:, s]
                    w0 = int(np.searchsorted(edge, at, side="right")) - 1
                    w1 = int(np.searchsorted(edge, min(end, edge[-1]), side="left"))
                    lo = np.maximum(edge[w0:w1], at)
                    hi = np.minimum(edge[w0 + 1 : w1 + 1], end)
                    ahead_in = (table[w0 + 1 : w1 + 1, :s] - table[w0:w1, :s]).sum(1)
                    took = np.flatnonzero(hi > lo)
                    row.append(np.full(len(took), r))
                    start.append(lo[took] - first)
                    length.append((hi - lo)[took])
                    window.append(took + w0 + block * _BLOCK)
                    offset.append((ahead_in + lo - edge[w0:w1])[took])
                    at = max(at, int(min(end, edge[-1])))
                    block += 1
            if not row:
                continue
            row, start, length, window, offset = (np.concatenate(x) for x in (row, start, length, window, offset))
            if rest and (last := window == full).any():
                cut = [np.concatenate(x) for x in zip(*(_split(*x, tail) for x in zip(row[last], start[last], length[last], offset[last])))]
                row, start, length, offset, window = (
                    np.concatenate([x[~last], y])
                    for x, y in zip((row, start, length, offset, window), (*cut[:4], cut[4] + full))
                )
            width = len(ids_of[0].as_buffer()) // int(n_of[0])
            kind = np.uint16 if width == 2 else np.uint32
            cells = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in ids_of]
            parts = [cells[r][a : a + k] for r, a, k in zip(row.tolist(), start.tolist(), length.tolist())]
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(n_of[row]),
                pa.array(window.astype(np.int64)), pa.array(offset),
            ]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if not sources:
        return spark.createDataFrame([], schema + (", ids array<long>" if keep_ids else ""))
    return placed.mapInArrow(run, schema + (", ids array<long>" if keep_ids else ""))


def _split(row: int, start: int, length: int, offset: int, tail: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut a piece of the last window at the bounds of its sequences."""
    edges = np.unique(np.concatenate([[offset, offset + length], tail[(tail > offset) & (tail < offset + length)]]))
    lo, n = edges[:-1], np.diff(edges)
    sequence = np.searchsorted(tail, lo, side="right") - 1
    return np.full(len(lo), row), start + lo - offset, n, lo - tail[sequence], sequence
