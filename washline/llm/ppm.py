"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` bytes deep is counted over all
training documents: tasks count the longest grams, Spark adds them up, and the counts of
shorter contexts are the marginals of those. A node stays in the tree if it has at least
``1 / nodes`` of the language's bytes, so no order of a tree has more than ``nodes`` nodes
whatever the corpus. With frozen counts, a byte costs its escapes down to the longest context
that predicts it (escape method C) plus its own code there; this depends on the last
``order + 1`` bytes only, so the costs of all kept grams are tabulated for all languages at
once and other grams are costed by the same rule when met. The language with the shortest
code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import CHUNK_BYTES, batch_chunks, stage

UNDETERMINED = "und"
#: Trees of all languages are held by every task; more languages raise an error.
MAX_LANGUAGES = 1_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the code of it and the ``order`` bytes before it in its row (zero before the start)."""
    wide = data.astype(np.uint64)
    code = wide.copy()
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    within = np.arange(len(data)) - row_start
    for k in range(1, order + 1):
        code[k:] |= np.where(within[k:] >= k, wide[:-k], np.uint64(0)) << np.uint64(8 * k)
    return code


def count_grams(docs: DataFrame, lang_col: str, text_col: str, order: int) -> DataFrame:
    """(lang, gram, n) over all rows with a language and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            code = np.concatenate([c for c, _ in parts])
            n = np.concatenate([n for _, n in parts])
            codes, at = np.unique(code, return_inverse=True)
            return codes, np.bincount(at, n, len(codes)).astype(np.int64)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for i, j, data, offsets in batch_chunks(batch, "text"):
                code = grams(data, offsets, order)
                for lang in set(langs[i:j]):
                    mine = np.repeat(langs[i:j] == lang, np.diff(offsets))
                    held.setdefault(lang, []).append(np.unique(code[mine], return_counts=True))
                    size += len(held[lang][-1][0])
                if size > 2_000_000:  # what a task holds: merge, and pass on if it is still large
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > 1_000_000:
                        yield from table(held)
                        held, size = {}, 0
        yield from table({lang: [merged(parts)] for lang, parts in held.items()})

    def table(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for codes, n in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("text")
    )
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class ContextTrees:
    """Frozen trees of all languages.

    ``nodes[k]`` are the sorted codes of grams of ``k + 1`` bytes kept in any language; for each,
    ``own[k]`` has the bits of its last byte in its context (inf where that language lacks the
    node) and ``contexts[k]``, ``escape[k]`` the bits of leaving a context of ``k`` bytes (0 where
    the language lacks the context). ``table`` holds the full costs of the longest grams by hash slot.
    """

    langs: tuple[str, ...]
    order: int
    nodes: tuple[np.ndarray, ...]
    own: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escape: tuple[np.ndarray, ...]

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram in each language, by escaping down the tree."""
        total = np.zeros((len(code), len(self.langs)), np.float32)
        open_ = np.ones(total.shape, bool)
        for k in range(self.order, -1, -1):
            gram = code & np.uint64((1 << 8 * (k + 1)) - 1)
            own = _rows(self.nodes[k], self.own[k], gram, np.inf)
            hit = open_ & np.isfinite(own)
            total[hit] += own[hit]
            open_ &= ~hit
            left = _rows(self.contexts[k], self.escape[k], gram >> np.uint64(8), 0.0)
            total[open_] += left[open_]
        total[open_] += 8.0  # a byte that no tree has: all bytes alike
        return total

    def slots(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Hash table over the longest grams: code and costs by slot; on a clash the first stays."""
        codes = self.nodes[self.order]
        width = max(10, int(np.ceil(np.log2(max(len(codes), 1) * 4))))
        slot = _slot(codes, width)
        keys = np.full(1 << width, np.uint64(0xFFFFFFFFFFFFFFFF))
        costs = np.zeros((1 << width, len(self.langs)), np.float32)
        slot, at = np.unique(slot, return_index=True)
        keys[slot] = codes[at]
        costs[slot] = self.bits(codes[at])
        return keys, costs, width


def _slot(codes: np.ndarray, width: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - width)).astype(np.int64)


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), otherwise, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = values[at]
    found[keys[at] != wanted] = otherwise
    return found


def fit(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = 4, nodes: int = 1 << 17
) -> ContextTrees:
    """Count all rows with a language and a text; rows without either teach nothing."""
    counts = stage(count_grams(docs, lang_col, text_col, order), "grams")
    depth = F.explode(F.array(*[F.lit(k) for k in range(order + 1)]))
    by_depth = (
        counts.select("lang", "gram", "n", depth.alias("k"))
        .withColumn(
            "gram", F.when(F.col("k") == 7, F.col("gram")).otherwise(
                F.col("gram").bitwiseAND(F.expr("shiftleft(1L, least(8 * (k + 1), 62)) - 1"))
            )
        )
        .groupBy("lang", "k", "gram")
        .agg(F.sum("n").alias("n"))
    )
    found = counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    sizes = {r["lang"]: r["n"] for r in found}
    langs = tuple(sorted(sizes))
    least = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(max(1, -(-sizes[lang] // nodes))))])
    # At most `nodes` rows for each language and order.
    kept = by_depth.where(F.col("n") >= least[F.col("lang")]).toArrow() if langs else None
    return _trees(langs, order, kept)


def _trees(langs: tuple[str, ...], order: int, kept: pa.Table | None) -> ContextTrees:
    nodes, own, contexts, escape = [], [], [], []
    if kept is not None:
        lang_of = np.array([langs.index(x) for x in kept.column("lang").combine_chunks().to_pylist()], np.int64)
        k_of = kept.column("k").to_numpy()
        gram_of = kept.column("gram").to_numpy().astype(np.uint64)
        n_of = kept.column("n").to_numpy()
    for k in range(order + 1):
        if kept is None:
            codes, parents = np.empty(0, np.uint64), np.empty(0, np.uint64)
            table, leave = np.empty((0, 0), np.float32), np.empty((0, 0), np.float32)
        else:
            mine = k_of == k
            codes, at = np.unique(gram_of[mine], return_inverse=True)
            count = np.zeros((len(codes), len(langs)))
            count[at, lang_of[mine]] = n_of[mine]
            parents, of = np.unique(codes >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(parents), len(langs))), np.zeros((len(parents), len(langs)))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                table = np.log2((total + kinds)[of] / count)
                leave = np.log2((total + kinds) / kinds)
            table[~np.isfinite(table)] = np.inf
            leave[~np.isfinite(leave)] = 0
        nodes.append(codes)
        own.append(table.astype(np.float32))
        contexts.append(parents)
        escape.append(leave.astype(np.float32))
    return ContextTrees(langs, order, tuple(nodes), tuple(own), tuple(contexts), tuple(escape))


def code_lengths(trees: ContextTrees, table: tuple, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row in each language."""
    keys, costs, width = table
    out = np.zeros((len(offsets) - 1, len(trees.langs)))
    for lo in range(0, len(data), CHUNK_BYTES):
        hi = min(len(data), lo + CHUNK_BYTES)
        back = max(0, lo - 2 * trees.order)  # bytes that only serve as contexts
        inside = np.clip(offsets, back, hi) - back
        code = grams(data[back:hi], inside, trees.order)[lo - back :]
        slot = _slot(code, width)
        cost = costs[slot]
        rare = np.flatnonzero(keys[slot] != code)
        if len(rare):
            codes, at = np.unique(code[rare], return_inverse=True)
            cost[rare] = trees.bits(codes)[at]
        bounds = np.clip(offsets, lo, hi) - lo
        for lang in range(len(trees.langs)):
            total = np.concatenate([[0.0], np.cumsum(cost[:, lang], dtype=np.float64)])
            out[:, lang] += total[bounds[1:]] - total[bounds[:-1]]
    return out


def predict(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, by its text alone.

    ``score`` is the chance of the language among those learned, all alike beforehand. A null
    text, one without a letter, and any text when no language was learned: ``und`` with score 0.
    Equal code lengths go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((trees, trees.slots() if trees.langs else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, table = shared.value
        langs = np.array([*trees.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in batch_chunks(batch, "text"):
                choice, score = np.full(j - i, len(trees.langs)), np.zeros(j - i)
                if table:
                    bits = code_lengths(trees, table, data, offsets)
                    gap = (bits - bits.min(1, keepdims=True)) * np.log(2)
                    told = letters[i:j]
                    choice[told] = bits.argmin(1)[told]
                    score[told] = (1 / np.exp(-np.minimum(gap, 700)).sum(1))[told]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(langs[choice], pa.string()), pa.array(score)],
                    names=[id_col, "lang_pred", "score"],
                )

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col),
        F.lower(text).alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
