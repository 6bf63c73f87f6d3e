"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed on the executors from the whole text of every document, over
the UTF-8 buffer of many rows at once. Trees are grown level by level from gradient
histograms of quantile bins, on at most ``max_rows`` labelled rows (those with the smallest
keyed hash of their id, so reruns agree), and flattened into arrays; scoring walks all rows
of a batch down one tree at a time by array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import batch_chunks
from washline.llm.textarrays import word_hashes, words

STATISTICS = (
    "log_words", "word_bytes", "longest_word", "upper", "digits", "symbols", "sentence_marks", "other_marks",
    "beyond_ascii", "lines_per_word", "different_words", "most_frequent_word", "repeats_previous",
    "repeats_one_before", "repeated_pairs", "repeated_lines", "upper_words", "words_without_letters",
    "words_ending_in_marks", "short_words", "letter_pairs",
)

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _MARK, _WIDE, _NEWLINE = range(8)
_KIND = np.full(256, 8, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x41:0x5B] = _UPPER
_KIND[0x61:0x7B] = _LOWER
_KIND[0x30:0x3A] = _DIGIT
for _c in b"#*$%&|<>":
    _KIND[_c] = _SYMBOL
for _c in b".,;:!?":
    _KIND[_c] = _STOP
_KIND[0x80:] = _WIDE
_KIND[0x0A] = _NEWLINE


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per document; all zero for a text without words."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    count = np.diff(first).astype(np.float64)
    n = np.maximum(count, 1)
    kind = _KIND[data]
    of_kind = [_per_row(kind == k, offsets) for k in range(8)]
    size = np.maximum(np.diff(offsets).astype(np.float64), 1)
    length = ends - starts
    out = np.zeros((rows, len(STATISTICS)))
    hashes = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))

    def same_as(step: int) -> np.ndarray:
        hit = np.zeros(len(hashes), bool)
        hit[step:] = (hashes[step:] == hashes[:-step]) & (row[step:] == row[:-step])
        return _per_row(hit, first)

    total = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)]) for k in (_UPPER, _LOWER, _WIDE)]
    upper, lower, wide = (t[ends] - t[starts] for t in total)
    last = kind[ends - 1] if len(ends) else np.empty(0, np.uint8)
    different, top, pairs, lines = (np.zeros(rows) for _ in range(4))
    pair = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) > 1 else np.empty(0, np.uint64)
    breaks = np.flatnonzero(data == 0x0A)
    at = np.searchsorted(breaks, offsets)
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b == a:
            continue
        own = np.sort(hashes[a:b])
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        different[r], top[r] = len(edge) - 1, np.diff(edge).max()
        if b - a > 1:
            two = np.sort(pair[a : b - 1])
            pairs[r] = np.count_nonzero(two[1:] == two[:-1])
        if at[r + 1] > at[r]:
            cut = np.concatenate([[0], np.searchsorted(starts[a:b], breaks[at[r] : at[r + 1]]), [b - a]])
            spans = [hashes[a + i : a + j].tobytes() for i, j in zip(cut[:-1], cut[1:]) if j > i]
            lines[r] = 1 - len(set(spans)) / max(len(spans), 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = _per_row(length, first) / n
    if len(starts):
        full = count > 0
        out[full, 2] = np.log1p(np.maximum.reduceat(length, first[:-1][full]))
    for k, column in ((_UPPER, 3), (_DIGIT, 4), (_SYMBOL, 5), (_STOP, 6), (_MARK, 7), (_WIDE, 8)):
        out[:, column] = of_kind[k] / size
    out[:, 9] = of_kind[_NEWLINE] / n
    out[:, 10] = different / n
    out[:, 11] = top / n
    out[:, 12] = same_as(1) / n
    out[:, 13] = same_as(2) / n
    out[:, 14] = pairs / n
    out[:, 15] = lines
    out[:, 16] = _per_row((upper > 1) & (lower == 0), first) / n
    out[:, 17] = _per_row(upper + lower + wide == 0, first) / n
    out[:, 18] = _per_row((last == _STOP) | (last == _SYMBOL), first) / n
    out[:, 19] = _per_row(length <= 3, first) / n
    letters = kind == _LOWER
    follows = np.zeros(len(data), bool)
    follows[1:] = letters[1:] & letters[:-1]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    out[:, 20] = _per_row(follows, offsets) / size
    out[count == 0] = 0
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: at each node a statistic, a threshold and the left child (right is the next).

    A leaf has itself as both children; walking ``depth`` steps reaches one from the root.
    """

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for tree in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                goes_left = x[row, self.feature[tree][node]] <= self.threshold[tree][node]
                node = np.where(goes_left, self.left[tree][node], self.right[tree][node])
            total += self.value[tree][node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    l2: float = 1.0,
    least_weight: float = 1.0,
) -> Forest:
    """Logistic boosting; a level's splits come from one gradient histogram per statistic.

    Without rows, or with one label only, the forest is a constant.
    """
    rows, features = x.shape
    if rows == 0:
        return Forest(0.0, 0, *(np.zeros((0, 1)) for _ in range(5)))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(features)], axis=1)
    margin = np.full(rows, base)
    slots = 2 ** (depth + 1) - 1
    grown = []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, curvature = chance - y, np.maximum(chance * (1 - chance), 1e-12)
        feature, threshold = np.zeros(slots, np.int64), np.full(slots, np.inf)
        child, value = np.tile(np.arange(slots), (2, 1)), np.zeros(slots)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            head, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            choice = np.full((width, 2), -1)
            at = node - head
            inside = (at >= 0) & (at < width)
            for f in range(features):
                key = at[inside] * bins + binned[inside, f]
                g = np.bincount(key, gradient[inside], width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(key, curvature[inside], width * bins).reshape(width, bins).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
                gain[(h < least_weight) | (h_all - h < least_weight)] = 0
                gain[:, len(edges[f]) :] = 0
                cut = gain.argmax(1)
                found = gain[np.arange(width), cut]
                better = found > best
                best[better] = found[better]
                choice[better] = np.stack([np.full(width, f), cut], 1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                slot = head + k
                feature[slot], threshold[slot] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
                child[:, slot] = 2 * slot + 1, 2 * slot + 2
                mine = node == slot
                node[mine] = np.where(x[mine, feature[slot]] <= threshold[slot], child[0, slot], child[1, slot])
        value = -rate * np.bincount(node, gradient, slots) / (np.bincount(node, curvature, slots) + l2)
        margin += value[node]
        grown.append((feature, threshold, child[0], child[1], value))
    return Forest(base, depth, *(np.stack(part) for part in zip(*grown)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics array) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in batch_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(list(statistics(data, offsets)), pa.list_(pa.float64()))],
                    names=["id", "statistics"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, statistics array<double>"
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 12_000,
    **options,
) -> Forest:
    """Fit on at most ``max_rows`` documents with a label of 0 or 1.

    Documents with conflicting labels, without id or without label teach nothing.
    """
    wanted = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_label"))
        .where("_low = _label")
        .orderBy(F.xxhash64(F.lit("sample"), F.col("_label_id")), "_label_id")
        .limit(max_rows)
    )
    # At most max_rows rows of (id, label): bounded, whatever the corpus.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(wanted), F.col("_id") == F.col("_label_id")
    )
    # Texts become statistics in all tasks; only those short rows are ordered and limited.
    place = F.struct(
        F.col("_label").alias("label"), F.xxhash64("_id").alias("first"), F.col("_id").alias("then"), F.xxhash64("_text").alias("last")
    )
    short = document_statistics(rows.select(place.alias("_place"), "_text"), "_place", "_text")
    short = short.orderBy("id.first", "id.then", "id.last").limit(max_rows)
    taught = short.select(F.col("id.label").alias("label"), "statistics").toArrow()
    y = taught.column("label").to_numpy().astype(np.float64)
    flat = taught.column("statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(y), len(STATISTICS))
    order = np.lexsort((*x.T, y))  # tasks may answer in any order
    return fit_forest(x[order], y[order], **options)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the chance of label 1, null and empty texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in batch_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(forest.score(statistics(data, offsets)))],
                    names=[id_col, "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, score double"
    )


def accepted(docs: DataFrame, forest: Forest, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for i, j, data, offsets in batch_chunks(texts, "text"):
                yield batch.slice(i, j - i).filter(pa.array(forest.score(statistics(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
