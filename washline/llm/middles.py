"""Fill-in-the-middle: texts cut at line ends and put into another order, with marks.

A text is laid out in fixed blocks of bytes. A Fenwick tree over the blocks stores how many
units (lines) end in each and how many code points begin in it. The end of the k-th unit is
found by descending the tree in steps of halved powers of two, which gives the block, and by
looking for the unit's end inside that block only. Trees and descents are computed for all
texts of a chunk at once: each text has blocks of its own, and one tree over the chunk's
blocks serves all of them, as a text starts at known totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import batch_chunks

#: Bytes of a block.
BLOCK = 1024
#: Marks that stand before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_NEWLINE = 10


def fenwick(counts: np.ndarray) -> np.ndarray:
    """Fenwick tree of ``counts``: entry i (from 1) is the sum of the counts that node i covers."""
    tree = np.concatenate([[0], counts.astype(np.int64)])
    n, step = len(counts), 1
    while step <= n:
        # Nodes at odd multiples of ``step`` are complete; each hands its sum to its parent.
        at = np.arange(step, n + 1, 2 * step)
        at = at[at + step <= n]
        tree[at + step] += tree[at]
        step *= 2
    return tree


def totals(tree: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sums of the first ``upto`` counts."""
    at, out = upto.astype(np.int64).copy(), np.zeros(len(upto), np.int64)
    while at.any():
        out += tree[at]
        at &= at - 1
    return out


def descend(tree: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry (from 0) that holds the element of each rank (from 1), and the sum of all before it."""
    n = len(tree) - 1
    at, before = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        ahead = at + step
        inside = ahead <= n
        gain = tree[np.where(inside, ahead, 0)]
        go = inside & (before + gain < ranks)
        at[go], before[go] = ahead[go], (before + gain)[go]
        step >>= 1
    return at, before


class BlockTree:
    """The texts of one chunk in blocks, with trees over units and code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.offsets, length = data, offsets, np.diff(offsets)
        blocks = -(-length // block)
        self.first = np.concatenate([[0], np.cumsum(blocks)])  # first block of each text
        own = np.arange(self.first[-1]) - np.repeat(self.first[:-1], blocks)
        self.start = np.repeat(offsets[:-1], blocks) + own * block
        if len(self.start):
            units = np.add.reduceat(data == _NEWLINE, self.start, dtype=np.int64)
            points = np.add.reduceat((data & 0xC0) != 0x80, self.start, dtype=np.int64)
        else:
            units = points = np.zeros(0, np.int64)
        full = np.flatnonzero(length)
        # A last line without a line end is a unit too; it ends with the text.
        self.open_end = np.zeros(len(length), bool)
        self.open_end[full] = data[offsets[full + 1] - 1] != _NEWLINE
        units[self.first[1:][self.open_end] - 1] += 1
        self.units, self.points = fenwick(units), fenwick(points)
        self.units_before = totals(self.units, self.first)
        self.points_before = totals(self.points, self.first)

    def n_units(self) -> np.ndarray:
        return np.diff(self.units_before)

    def cut(self, row: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets in the text, and code points before them, of the ends of the first ``units`` units of each row."""
        at, points = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        wanted = np.flatnonzero(units > 0)
        block, before = descend(self.units, self.units_before[row[wanted]] + units[wanted])
        rank = self.units_before[row[wanted]] + units[wanted] - before
        ahead = totals(self.points, block) - self.points_before[row[wanted]]
        for k, (r, b, nth, passed) in enumerate(zip(row[wanted], block, rank, ahead)):
            lo = self.start[b]
            hi = self.start[b + 1] if b + 1 < self.first[r + 1] else self.offsets[r + 1]
            part = self.data[lo:hi]
            ends = np.flatnonzero(part == _NEWLINE)
            stop = int(ends[nth - 1]) + 1 if nth <= len(ends) else len(part)
            at[wanted[k]] = lo - self.offsets[r] + stop
            points[wanted[k]] = passed + np.count_nonzero((part[:stop] & 0xC0) != 0x80)
        return at, points


def _draws(seed: int, identifier: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if identifier is None else identifier}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    marks: tuple[str, str, str] = MARKS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    ``n`` is the number of lines. Four draws from the SHA-256 of seed and id decide: two cuts at
    line ends, whether the text is transformed (in ``rate`` of 100 cases), and whether suffix
    (``spm`` of 100) or prefix comes first. Empty texts and texts that hold a mark stay as they
    are, form ``plain``, with null counts. A null text is empty; a null id draws like an empty
    one; equal rows give equal rows. Other columns are not read. A text of any length is cut
    whole, in memory in proportion to its own length.
    """
    codes = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in batch_chunks(batch, "text"):
                tree = BlockTree(data, offsets, block)
                n = tree.n_units()
                draws = np.array([_draws(seed, x) for x in batch.column(0).slice(i, j - i).to_pylist()], np.int64)
                picks = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                plain = np.array([not t or any(c in t for c in codes) for t in texts], bool) | (draws[:, 2] % 100 >= rate)
                last = draws[:, 3] % 100 < spm
                row = np.flatnonzero(~plain)
                cuts = [tree.cut(row, picks[row, k]) for k in (0, 1)]
                output = list(texts)
                for k, r in enumerate(row):
                    a, b = cuts[0][0][k], cuts[1][0][k]
                    prefix, middle, suffix = texts[r][:a], texts[r][a:b], texts[r][b:]
                    head = (codes[1], suffix, codes[0], prefix) if last[r] else (codes[0], prefix, codes[1], suffix)
                    output[r] = b"".join((*head, codes[2], middle))
                counts = np.zeros((2, len(n)), np.int64)
                counts[0, row], counts[1, row] = cuts[0][1], cuts[1][1] - cuts[0][1]
                form = np.where(plain, "plain", np.where(last, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                        pa.array(counts[0], mask=plain), pa.array(counts[1], mask=plain),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    ).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` got, from its output and form alone.

    A transformed text holds no mark of its own, and marks cannot overlap, so each occurs once.
    """
    any_mark = "|".join("\\Q" + m + "\\E" for m in marks)
    parts = F.split(output, any_mark)
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
    )
