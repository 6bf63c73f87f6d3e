"""Similarity join of documents by the Jaccard coefficient of word shingles, with a MinHash LSH forest.

1. Each document becomes the set of its shingle hashes; documents with equal sets are copies
   and go on as one.
2. A signature of ``trees * depth`` minhashes, a byte each, makes one label of ``depth`` bytes for
   each tree. The labels of a tree form a prefix trie: a node is a prefix and the sets below it.
3. Every set matches at the full depth first and shortens its prefix until its own target recall is reached:
   a set of few shingles can only have partners of certain similarities (six shingles: 5/6 or more, three:
   none but copies), so it leaves the tries at a longer prefix than the threshold alone would ask for. Two
   sets meet at the longer of their two prefixes. Nodes link their members to the smallest only, and the
   components of those links are the groups that need verification.
4. Groups are cut into blocks of up to 2,048 sets. Each pair of blocks is verified exactly in one task
   by incidence products over shingles (rare shingles by their pairs, frequent ones by matrices). It
   yields one row for each linked set: how many links it has there, and the smallest set that it hangs
   together with. Components of those rows are the classes.

Shingles are compared as 64-bit hashes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm.common import batch_chunks, binary_array, bit_set, bitmap_of, stage
from washline.llm.components import components
from washline.llm.textarrays import U64, mix, shingle_sets

#: Bits of the map that drops documents without any candidate before their shingles are shuffled.
FILTER_BITS = 26
#: Sets in a block of a group, and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 2_000_000
#: Sets of more shingles than this leave the tries where the threshold asks for.
FEW_SHINGLES = 64
#: A shingle is frequent if it is in more than one of this many pairs of sets.
FREQUENT = 200
#: Pairs of sets, or columns of a matrix, in one vectorised step.
_PAIRS, _WIDTH = 1 << 22, 2048


def prefix_length(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair of this similarity meets in some tree with this probability."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def least_similarity(size: int, threshold: Fraction) -> Fraction | None:
    """The smallest coefficient from the threshold on that a set of ``size`` has with a different set, if any."""
    found = []
    for common in range(1, size + 1):
        union = int(common / threshold)  # the largest that still reaches the threshold
        if union >= size and (common, union) != (size, size):
            found.append(Fraction(common, union))
    return min(found, default=None)


def prefix_lengths(threshold: Fraction, trees: int, depth: int, recall: float) -> list[list[int]]:
    """For each number of shingles up to ``FEW_SHINGLES``: the prefixes at which such a set is in the tries.

    The last is where its own recall is reached; longer ones meet partners that leave the tries there.
    """
    own = []
    for size in range(1, int(FEW_SHINGLES / threshold) + 1):
        least = least_similarity(size, threshold) if size <= FEW_SHINGLES else threshold
        own.append(prefix_length(float(least), trees, depth, recall) if least else 0)
    out = []
    for size in range(1, FEW_SHINGLES + 1):
        low, high = -int(-(size * threshold) // 1), int(size / threshold)
        partners = {max(own[size - 1], own[n - 1]) for n in range(max(1, low), high + 1) if own[n - 1]}
        out.append(sorted(partners | {own[size - 1]}, reverse=True) if own[size - 1] else [])
    return out


def labels(values: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """``trees`` labels for each nonempty set; a label has a byte of each of ``depth`` minhashes."""
    rows = len(bounds) - 1
    keys = np.arange(1, trees * depth + 1, dtype=U64)
    keys = mix(keys * U64(0x9E3779B97F4A7C15)) | U64(1)
    best = np.full((trees * depth, rows), U64(0xFFFFFFFFFFFFFFFF))
    step = 1 << 15  # shingles that stay in cache
    full = np.flatnonzero(np.diff(bounds) > 0)
    for lo in range(0, len(values), step):
        hi = min(len(values), lo + step)
        part = values[lo:hi]
        mine = full[(bounds[full] < hi) & (bounds[full + 1] > lo)]
        at = np.maximum(bounds[mine], lo) - lo
        for k, key in enumerate(keys):
            found = np.minimum.reduceat(part * key, at)
            best[k, mine] = np.minimum(best[k, mine], found)
    short = (mix(best.ravel()) >> U64(56)).reshape(trees, depth, rows)
    out = np.zeros((rows, trees), U64)
    for d in range(depth):
        out = (out << U64(8)) | short[:, d].T
    return out


def signatures(docs: DataFrame, shingle: int, trees: int, depth: int) -> DataFrame:
    """(id, key, set, size, labels) for each row of (id, key, text); ``set`` is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in batch_chunks(batch, "text"):
                values, bounds = shingle_sets(data, offsets, shingle)
                size = np.diff(bounds)
                total = [np.concatenate([[U64(0)], np.cumsum(x, dtype=U64)]) for x in (values, mix(values ^ U64(0x5851F42D4C957F2D)))]
                name = np.stack([mix(t[bounds[1:]] - t[bounds[:-1]] + size.astype(U64)) for t in total], 1)
                own = labels(values, bounds, trees, depth)
                name = binary_array(name.view(np.uint8).ravel(), np.arange(j - i + 1) * 16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                        pa.array([x if n else None for x, n in zip(name.to_pylist(), size)], pa.binary()), pa.array(size),
                        pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * trees, pa.int32()), pa.array(own.view(np.int64).ravel())),
                    ],
                    names=["id", "key", "set", "size", "labels"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key long, set binary, size long, labels array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``; sets are sorted and without repeats."""
    entries = []
    for sets in (left, right):
        member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        entries.append((values[order], member[order]))
    names = [np.unique(v, return_index=True, return_counts=True) for v, _ in entries]
    _, at_left, at_right = np.intersect1d(names[0][0], names[1][0], assume_unique=True, return_indices=True)
    first = [names[0][1][at_left], names[1][1][at_right]]
    count = [names[0][2][at_left], names[1][2][at_right]]
    pairs = count[0] * count[1]
    shape = (len(left), len(right))
    common = np.zeros(shape[0] * shape[1], np.int64)
    frequent = pairs * FREQUENT > len(common)
    rare = np.flatnonzero(~frequent)
    upto = np.concatenate([[0], np.cumsum(pairs[rare])])
    lo = 0
    while lo < len(rare):  # every pair that shares a rare value
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PAIRS, side="right")) - 1)
        own = rare[lo:hi]
        value = np.repeat(own, pairs[own])
        within = np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], pairs[own])
        a = entries[0][1][first[0][value] + within // count[1][value]]
        b = entries[1][1][first[1][value] + within % count[1][value]]
        common += np.bincount(a * shape[1] + b, minlength=len(common))
        lo = hi
    common = common.reshape(shape)
    often = np.flatnonzero(frequent)
    for lo in range(0, len(often), _WIDTH):
        own = often[lo : lo + _WIDTH]
        parts = []
        for side, rows in enumerate(shape):
            m = np.zeros((rows, len(own)), np.float32)
            n = count[side][own]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            m[entries[side][1][np.repeat(first[side][own], n) + within], np.repeat(np.arange(len(own)), n)] = 1
            parts.append(m)
        common += (parts[0] @ parts[1].T).astype(np.int64)
    return common


def spanning(linked: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name that each linked row and column of a matrix of links hangs together with."""
    root = tuple(x.copy() for x in names)
    open_rows, open_columns = linked.any(1), linked.any(0)
    for r in range(len(linked)):
        if not open_rows[r]:
            continue
        rows, columns = np.array([r]), np.zeros(0, np.int64)
        found = [[], []]
        while len(rows):
            open_rows[rows] = False
            found[0].append(rows)
            columns = np.flatnonzero(linked[rows].any(0) & open_columns)
            open_columns[columns] = False
            found[1].append(columns)
            rows = np.flatnonzero(linked[:, columns].any(1) & open_rows)
        mine = [np.concatenate(x) for x in found]
        least = min(names[0][mine[0]].min(), names[1][mine[1]].min())
        root[0][mine[0]], root[1][mine[1]] = least, least
    return root


def verify(group: pd.DataFrame, first: int, second: int, threshold: Fraction) -> pd.DataFrame:
    """Links among the sets of two blocks (or inside one): one row for each linked set."""
    block = group["block"].to_numpy()
    sides = [np.flatnonzero(block == first), np.flatnonzero(block == second)]
    sets = [[np.frombuffer(group["shingles"].iat[i], U64) for i in side] for side in sides]
    common = common_counts(*sets)
    size = [np.array([len(x) for x in side], np.int64) for side in sets]
    union = size[0][:, None] + size[1][None, :] - common
    linked = common * threshold.denominator >= union * threshold.numerator
    if first == second:
        np.fill_diagonal(linked, False)
    docs = group["n_docs"].to_numpy()
    root = spanning(linked, tuple(sides))
    # Inside one block the links of a set are those of its row; between two, rows and columns are different sets.
    out = [(sides[0], root[0] if first != second else np.minimum(*root), linked.sum(1), linked @ docs[sides[1]])]
    if first != second:
        out.append((sides[1], root[1], linked.sum(0), docs[sides[0]] @ linked))
    at, least, texts, copies = (np.concatenate(x) for x in zip(*out))
    hit = texts > 0
    names = group["set"].to_numpy()
    return pd.DataFrame(
        {"set": names[at[hit]], "root": names[least[hit]], "n_text_links": texts[hit], "n_links": copies[hit]}
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    trees: int = 20,
    depth: int = 8,
    recall: float = 0.999,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, n_links and n_text_links.

    Classes are the components of the links between documents with similarity of at least
    ``threshold``; ``class_id`` is the smallest id in the class. ``n_links`` counts the other rows
    a row is linked to, ``n_text_links`` the different shingle sets among them other than its own.
    A text with fewer words than a shingle is one shingle. A null, empty or blank text has no
    links and is its own class. Repeated rows are copies. A null id sorts after all others.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    signed = stage(signatures(rows, shingle, trees, depth), "signatures")
    sets = stage(
        signed.where("set is not null")
        .groupBy("set")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "key")).alias("least"),
            F.count("*").alias("n_docs"),
            F.first("size").alias("size"),
            F.first("labels").alias("labels"),
        ),
        "sets",
    )
    share = Fraction(str(threshold))
    few = F.lit(";".join(",".join(map(str, x)) for x in prefix_lengths(share, trees, depth, recall)))
    lengths = F.when(
        F.col("size") <= FEW_SHINGLES,
        F.filter(F.split(F.element_at(F.split(few, ";"), F.least("size", F.lit(FEW_SHINGLES)).cast("int")), ","), lambda x: x != ""),
    ).otherwise(F.array(F.lit(str(prefix_length(threshold, trees, depth, recall)))))
    node = ["length", "tree", "prefix"]
    nodes = (
        sets.select("set", "labels", F.explode(lengths.cast("array<int>")).alias("length"))
        .select("set", "length", F.posexplode("labels").alias("tree", "label"))
        .withColumn("prefix", F.expr(f"shiftrightunsigned(label, 8 * ({depth} - length))"))
        .drop("label")
    )
    shared = nodes.groupBy(node).agg(F.min("set").alias("b"), F.count("*").alias("n")).where("n > 1")
    links = nodes.join(shared, node).select(F.col("set").alias("a"), "b")
    groups = components(links)
    sized = groups.join(sets.select(F.col("set").alias("node"), "size", "n_docs", "least.key"), "node")
    # Staged, so that the joins below are plain and a large group among their rows can be split.
    blocks = stage(
        sized.groupBy("root").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        ),
        "blocks",
    )
    active = stage(
        sized.join(blocks, "root").select(
            F.col("node").alias("set"), "root", "n_docs", F.col("key").alias("set_key"), "blocks",
            F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        ),
        "active",
    )

    # Shingles of one document of each set in a group. The map drops most others early.
    low = (1 << FILTER_BITS) - 1
    bits = spark.sparkContext.broadcast(
        bitmap_of(active.select(F.col("set_key").bitwiseAND(F.lit(low)).alias("cell")), FILTER_BITS)
    )

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            wanted = bit_set(bits.value, keys & low)
            for r in np.flatnonzero(wanted):  # a repeated row once
                wanted[r] = keys[r] not in seen
                seen.add(int(keys[r]))
            batch = batch.filter(pa.array(wanted))
            for i, j, data, offsets in batch_chunks(batch, "text"):
                values, bounds = shingle_sets(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), binary_array(values.view(np.uint8), bounds * 8)], names=["key", "shingles"]
                )

    contents = rows.select("key", "text").mapInArrow(shingles, "key long, shingles binary")
    held = active.join(contents, active["set_key"] == contents["key"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = held.select("set", "root", "n_docs", "block", "shingles", other).select(
        "set", "n_docs", "block", "shingles", "root",
        F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
    )

    def check(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("set").sort_values("set", ignore_index=True)
        return verify(group, int(key[1]), int(key[2]), share)

    verified = stage(
        paired.groupBy("root", "first", "second").applyInPandas(
            check, "set binary, root binary, n_text_links long, n_links long"
        ),
        "verified",
    )
    counts = verified.groupBy("set").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("n_links").alias("n_links"))
    roots = components(verified.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")))
    classed = sets.select("set", "least", "n_docs").join(roots.toDF("set", "root"), "set", "left").withColumn(
        "root", F.coalesce("root", "set")
    )
    of_class = stage(
        classed.groupBy("root").agg(F.min("least").alias("least"), F.sum("n_docs").alias("class_size")), "class-sizes"
    )
    known = (
        classed.select("set", "root", "n_docs")
        .join(of_class, "root")
        .join(counts, "set", "left")
        .select(
            F.col("set").alias("_set"),
            F.col("least.id").alias("class_id"),
            "class_size",
            (F.coalesce("n_links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
            F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        )
    )
    known = stage(known, "classes")
    return signed.join(known, signed["set"] == known["_set"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("_set").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
    )
