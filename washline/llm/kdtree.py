"""Shards of near equal bytes by a k-d tree over document metadata.

Documents with equal texts are one point, so copies stay in one shard; a text whose copies weigh
more than a small part of a shard is several points. A point has a coordinate for each metadata
column (the place of its value among all values in order) and for the logarithm of its size.
The tree splits all nodes of a level at once: each along the dimension in which it is widest,
relative to the whole table, at the weighted median of bytes. Points with equal coordinates are
told apart by a hash, so a median also falls inside a source that fills a shard.

A median is found by narrowing, without sorting or shuffling points: a pass sums bytes by
interval of the dimension (256 of them for each node, combined in the tasks), and the next looks
into the interval that holds the median only. What is left undecided is one interval of at most a
thousandth of a shard, which goes to the nearer side as a whole.

Only DataFrame functions are used; points, intervals and cuts stay tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.llm.common import stage
from washline.llm.perspectives import numbered

#: Intervals that a node's dimension is divided into by one pass.
BINS = 256
#: Parts of a shard: what copies of one text may weigh and stay together, and what a cut may be off by.
GROUP_SHARE, CUT_SHARE = 1 / 256, 1 / 1024
#: Bits of the hash that tells points with equal coordinates apart.
_TIE_BITS = 31
_TEXT = ["h", "text_crc32", "size"]


def sized_rows(docs: DataFrame, id_col: str, text_col: str, columns: tuple[str, ...]) -> DataFrame:
    """Stage (id, size, text_crc32, h, v0, v1, ...): the one pass over texts; ``v`` are the metadata columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            *[F.col(c).cast("string").alias(f"v{k}") for k, c in enumerate(columns)],
        ),
        "sizes",
    )


def ranked(rows: DataFrame, value: str) -> DataFrame:
    """(value, rank) of the different values of a column in code point order, null last; numbered by ranges."""
    different = rows.select(F.col(value).isNull().alias("late"), F.col(value).alias("value")).distinct()
    return numbered(different, [], ["late", "value"]).select("value", "rank")


def _points(rows: DataFrame, n_values: int, limit: float, leaves: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their piece, and the staged points (text, piece, weight, c0, c1, ..., tie, first, leaves), all in the root.

    A text's coordinates are those of its row with the smallest id. Heavy texts are at most as many as
    the limit goes into all bytes.
    """
    values = [f"v{k}" for k in range(n_values)]
    groups = stage(
        rows.groupBy(*_TEXT).agg(
            F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("late"), "id", *values)).alias("least")
        ),
        "groups",
    )
    weight = F.col("n") * F.col("size")
    heavy = groups.where(weight > limit).select(*_TEXT, F.least("n", F.ceil(weight / limit)).alias("pieces"), "least")
    heavy = stage(heavy, "heavy")
    # Rows without an id are dealt by their place.
    draw = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id())))
    placed = rows.join(heavy.drop("least"), _TEXT, "left").withColumn(
        "piece", F.coalesce(F.pmod(draw, "pieces"), F.lit(0)).cast("long")
    )
    placed = stage(placed.select("id", *_TEXT, "piece", F.col("pieces").isNotNull().alias("split")), "pieces")
    split = placed.where("split").groupBy(*_TEXT, "piece").agg(F.count("*").alias("n"))
    points = (
        groups.where(weight <= limit).select(*_TEXT, F.lit(0).cast("long").alias("piece"), "n", "least")
        .unionByName(split.join(heavy.drop("pieces"), _TEXT))
        .select(*_TEXT, "piece", weight.alias("weight"), *[F.col(f"least.{v}").alias(v) for v in values])
    )
    for k, v in enumerate(values):
        order = ranked(rows, v).select(F.col("value").alias(f"_{v}"), F.col("rank").cast("long").alias(f"c{k}"))
        points = points.join(order, F.col(v).eqNullSafe(F.col(f"_{v}"))).drop(v, f"_{v}")
    size = F.floor(64 * F.log2("size")).cast("long")
    tie = F.shiftrightunsigned(F.xxhash64(*_TEXT, "piece"), 64 - _TIE_BITS)
    root = {"first": F.lit(0), "leaves": F.lit(leaves)}
    return placed, stage(points.withColumns({f"c{n_values}": size, "tie": tie, **root}), "points")


def _chosen(dim: Column, columns: list[Column]) -> Column:
    return reduce(lambda rest, k: F.when(dim == k, columns[k]).otherwise(rest), range(len(columns) - 1), columns[-1])


def split_nodes(points: DataFrame, n_dims: int, widths: list[int], undecided: float) -> DataFrame:
    """One more level: ``points`` with ``first`` and ``leaves`` of their node at its half; nodes of one leaf stay."""
    inner = points.where("leaves > 1")
    c = [F.col(f"c{k}") for k in range(n_dims)]
    scale = 1 << _TIE_BITS
    ends = inner.groupBy("first", "leaves").agg(
        F.sum("weight").alias("node_weight"), *[F.min(x).alias(f"l{k}") for k, x in enumerate(c)], *[F.max(x).alias(f"h{k}") for k, x in enumerate(c)]
    )
    wide = [(F.col(f"h{k}") - F.col(f"l{k}")) / max(1, widths[k]) for k in range(n_dims)]
    most = F.greatest(*wide) if n_dims > 1 else wide[0]
    dim = reduce(lambda rest, k: F.when(wide[k] == most, k).otherwise(rest), reversed(range(n_dims)), F.lit(0))
    low, high = (_chosen(F.col("dim"), [F.col(f"{e}{k}") for k in range(n_dims)]) for e in "lh")
    state = stage(
        ends.withColumn("dim", dim).select(
            F.col("first").alias("node"),
            "dim",
            (low * scale).alias("low"),
            ((high + 1) * scale).alias("high"),
            (F.col("node_weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("want"),
            F.lit(0).cast("long").alias("before"),
            F.col("node_weight").alias("inside"),
            F.lit(True).alias("open"),
        ),
        "cuts",
    )
    key = _chosen(F.col("dim"), [x * scale + F.col("tie") for x in c])
    while state.where("open").limit(1).count():
        at = inner.join(state.where("open"), F.col("first") == F.col("node")).withColumn("key", key)
        step = F.expr(f"(high - low + {BINS - 1}) div {BINS}")
        sums = (
            at.where("key >= low AND key < high")
            .withColumn("step", step)
            .groupBy("node", F.expr("(key - low) div step").alias("bin"))
            .agg(F.sum("weight").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"), F.first("want").alias("goal"), F.first("before").alias("ahead"))
        )
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        hit = (
            sums.withColumn("upto", F.col("ahead") + upto)
            .where("upto >= goal")
            .groupBy("node")
            .agg(F.min(F.struct("bin", "w", "upto", "least", "most")).alias("hit"))
            .select(F.col("node").alias("hit_node"), "hit")
        )
        met = state.join(hit, F.col("node") == F.col("hit_node"), "left")
        found = F.col("hit").isNotNull()
        state = stage(
            met.select(
                "node",
                "dim",
                F.when(found, F.col("hit.least")).otherwise(F.col("low")).alias("low"),
                F.when(found, F.col("hit.most") + 1).otherwise(F.col("high")).alias("high"),
                "want",
                F.when(found, F.col("hit.upto") - F.col("hit.w")).otherwise(F.col("before")).alias("before"),
                F.when(found, F.col("hit.w")).otherwise(F.col("inside")).alias("inside"),
                (found & (F.col("hit.most") > F.col("hit.least")) & (F.col("hit.w") > undecided)).alias("open"),
            ),
            "cuts",
        )
    # The interval in which the median lies goes to the side that leaves the smaller difference.
    left = F.col("want") - F.col("before") > F.col("before") + F.col("inside") - F.col("want")
    cut = state.select("node", "dim", F.when(left, F.col("high")).otherwise(F.col("low")).alias("cut"))
    half = F.floor(F.col("leaves") / 2).cast("int")
    right = key >= F.col("cut")
    joined = points.join(cut, (F.col("first") == F.col("node")) & (F.col("leaves") > 1), "left")
    return stage(
        joined.withColumns(
            {
                "first": F.when(F.col("leaves") == 1, F.col("first")).when(right, F.col("first") + half).otherwise(F.col("first")),
                "leaves": F.when(F.col("leaves") == 1, 1).when(right, F.col("leaves") - half).otherwise(half),
            }
        ).select(*points.columns),
        "points",
    )


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, ...] = ("source", "lang"),
    group_share: float = GROUP_SHARE,
    cut_share: float = CUT_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Leaves are split until they reach
    ``target_bytes``, or there are ``shards`` of them. Shards are near equal in bytes: a cut is off by at most
    half of the larger of a single document, ``group_share`` and ``cut_share`` of a shard. Equal texts share
    a shard unless their copies weigh more than ``group_share`` of one; then they are dealt by id.
    ``slot`` numbers the rows of a shard from 0 in the order of ids (null last). Null metadata is a value
    of its own, after all others; rows that repeat an id and a text stay together. No rows give none.
    """
    rows = sized_rows(docs, id_col, text_col, columns)
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = max(1, round(total / target_bytes)) if target_bytes else shards
    placed, points = _points(rows, len(columns), max(1.0, group_share * total / leaves), leaves)
    n_dims = len(columns) + 1
    spans = points.agg(*[(F.max(f"c{k}") - F.min(f"c{k}")) for k in range(n_dims)]).first()
    for _ in range((leaves - 1).bit_length()):
        points = split_nodes(points, n_dims, [s or 0 for s in spans], cut_share * total / leaves)
    found = placed.drop("split").join(points.select(*_TEXT, "piece", F.col("first").alias("shard")), [*_TEXT, "piece"])
    order = found.select("id", "size", "text_crc32", "h", "shard", F.col("id").isNull().alias("late"))
    return numbered(order, ["shard"], ["late", "id", "h"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot")
    )
