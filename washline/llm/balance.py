"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often it is taken on average, between 0 and ``most``. Among
all rates that meet the token constraint of each source, those closest to taking each
document once (in relative entropy on that interval) are an exponential tilt of its size:
``rate = most * sigmoid(log(1 / (most - 1)) + lambda * size)``. The multipliers maximise the concave
dual, which Newton steps solve; a step outside the bracket of the root halves the bracket.

A rate depends on source and size only, so documents are counted by (source, size) once and
each Newton step is an aggregation over that small table. Rates are rounded into whole copies
of each (source, size) by running sums from large to small sizes, and what a source then lacks or
has too much is settled with the sizes that fit: these sums are as long as there are different
sizes, whatever the number of documents. The copies of a (source, size) are shared out among parts of
its documents in proportion, and within a part by a hash. No step uses Python on rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.llm.common import WORD, discard, stage

#: Rows of equal source and size that are ordered together.
PART_ROWS = 16_384


def _queue(source: Column) -> Column:
    """A source as a key that is never null; null sorts last."""
    return F.concat(F.when(source.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(source.cast("string"), F.lit("")))


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, deal_by: tuple[str, ...]) -> DataFrame:
    """Stage (id, queue, source, size, key): the number of words of every row; null has none.

    ``key`` is a hash of the columns ``deal_by``, by default of id and text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return stage(
        docs.select(
            F.col(id_col).alias("id"),
            _queue(F.col(source_col)).alias("queue"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(*([F.col(c) for c in deal_by] or [F.col(id_col), text])).alias("key"),
        ),
        "sizes",
    )


def capped_targets(sources: DataFrame, weights: Column, share: float, most: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by ``weights``, at most ``most`` times the source's own.

    What a source cannot take is shared among the others by weight until none is above. One row
    for each source; the window over them is as long as there are sources.
    """
    sources = sources.withColumn("weight", weights.cast("double"))
    full = F.col("source_size") * most / F.col("weight")
    every = Window.partitionBy()
    before = Window.orderBy(full, "queue").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) * share - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sources.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= full, F.col("level"))).over(every))
        .withColumn(
            "target",
            F.least(F.col("source_size") * most, F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * most)),
        )
        .drop("level", "weight")
    )


def _rate(most: float) -> Column:
    """Tilted rate of a document; ``-log(most - 1)`` is the log odds at which it is 1."""
    tilt = F.col("lambda") * F.col("size") / F.col("scale") - math.log(most - 1.0)
    return F.when(F.col("target") >= F.col("source_size") * most, F.lit(most)).otherwise(most / (1 + F.exp(-tilt)))


def solve(cells: DataFrame, targets: DataFrame, most: float, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """Multiplier of each source: (queue, source_size, target, scale, lambda).

    ``cells`` has queue, size and n. The scale makes the tilt of a source's average token 1.
    """
    scale = cells.groupBy("queue").agg(
        F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("scale")
    )
    state = stage(
        targets.join(scale, "queue")
        .withColumn("scale", F.coalesce("scale", F.lit(1.0)))
        .withColumn("lambda", F.lit(0.0))
        .withColumn("low", -60.0 * F.col("scale"))
        .withColumn("high", 60.0 * F.col("scale")),
        "multipliers",
    )
    rate = _rate(most)
    x = F.col("size") / F.col("scale")
    for _ in range(max_steps):
        at = cells.join(state.drop("open"), "queue").withColumn("rate", rate)
        sums = at.groupBy("queue").agg(
            F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("taken"),
            F.sum(F.col("n") * F.col("size") * x * F.col("rate") * (1 - F.col("rate") / most)).alias("slope"),
        )
        over = F.col("taken") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("lambda"))
        high = F.when(over, F.col("lambda")).otherwise(F.col("high"))
        met = state.drop("open").join(sums, "queue").withColumns(
            {"low": low, "high": high, "gap": F.abs(F.col("taken") - F.col("target")) / F.greatest("target", F.lit(1.0))}
        )
        newton = F.col("lambda") - F.try_divide(F.col("taken") - F.col("target"), F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        settled = (F.col("gap") <= tolerance) | (F.col("target") >= F.col("source_size") * most) | (F.col("target") <= 0)
        before, state = state, stage(
            met.withColumn("open", ~settled)
            .withColumn(
                "lambda",
                F.when(settled, F.col("lambda")).otherwise(F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)),
            )
            .select("queue", "source_size", "target", "scale", "lambda", "low", "high", "open"),
            "multipliers",
        )
        discard(before)
        if not state.where("open").limit(1).count():
            return state.select("queue", "source_size", "target", "scale", "lambda")
    raise RuntimeError(f"multipliers did not settle in {max_steps} steps")


def _copies(cells: DataFrame, most: int, passes: int = 6) -> DataFrame:
    """Whole copies of each cell (queue, size, n, rate, target).

    Rates are summed from large to small sizes and the sums rounded, so a source is off by a
    part of its larger documents; then the largest sizes that fit the difference take or
    give copies.
    """
    queue = Window.partitionBy("queue")
    running = queue.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(running)
    own = F.col("n") * F.col("rate")
    cells = cells.withColumn("upto", upto).withColumn(
        "copies",
        F.greatest(
            F.lit(0),
            F.least(F.col("n") * most, (F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - own + 0.5)).cast("long")),
        ),
    )
    for _ in range(passes):
        cells = cells.withColumn("lack", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(queue))
        room = F.when(F.col("lack") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = F.least(F.floor(F.abs("lack") / F.greatest("size", F.lit(1))).cast("long"), room)
        cells = cells.withColumn("fits", F.when(F.col("size") > 0, fits).otherwise(F.lit(0)))
        choice = F.max(F.when(F.col("fits") > 0, F.col("size"))).over(queue)
        cells = cells.withColumn("choice", choice).withColumn(
            "copies",
            F.when(
                F.col("choice") == F.col("size"),
                F.col("copies") + F.when(F.col("lack") > 0, F.col("fits")).otherwise(-F.col("fits")),
            ).otherwise(F.col("copies")),
        )
    return cells.select("queue", "size", "n", "copies")


def _shared_out(parts: DataFrame, decided: DataFrame) -> DataFrame:
    """Copies of each part (queue, size, part, rows): the part's share of its cell's copies, by rounded running sums."""
    cell = Window.partitionBy("queue", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("rows").over(cell)
    # copies = whole * n + rest, so no product is larger than n squared; whole copies go to every row.
    joined = parts.join(decided, ["queue", "size"]).withColumn("upto", upto)
    rest = F.pmod("copies", "n")

    def share(at: Column) -> Column:
        return F.floor((at.cast("decimal(20,0)") * rest.cast("decimal(18,0)")) / F.col("n")).cast("long")

    return joined.select(
        "queue", "size", "part", F.floor(F.col("copies") / F.col("n")).cast("long").alias("whole"),
        (share(F.col("upto")) - share(F.col("upto") - F.col("rows"))).alias("extra"),
    )


def mix_sources(
    docs: DataFrame,
    targets,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    deal_by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies, taken.

    ``targets`` gets (queue, source, source_size), one row per source, and adds ``target`` in
    words. A null source is a source; its queue sorts last. Documents without words have a
    rate of 1 and cost nothing. Who gets a copy more is decided by a hash of ``deal_by`` (default: id and
    text), and by the id among equal hashes, so reruns agree.
    A target above ``most`` times the source is met by ``most`` copies of everything.
    """
    sized = sized_documents(docs, id_col, text_col, source_col, deal_by)
    cells = stage(sized.groupBy("queue", "source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("queue").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = solve(cells, targets(sources).select("queue", "source_size", "target"), float(most))
    rated = cells.join(solved, "queue").select(
        "queue", "size", "n", "source_size", "target", _rate(float(most)).alias("rate")
    )
    decided = stage(_copies(rated, most), "copies")
    # Equal hashes meet in one part and are ordered by id there.
    n_parts = F.ceil(F.col("n") / PART_ROWS)
    placed = stage(
        sized.join(rated, ["queue", "size"]).select(
            "id", "source", "key", "queue", "size", "source_size", "target", "rate",
            F.pmod(F.xxhash64(F.lit("part"), "key"), n_parts).alias("part"),
        ),
        "placed",
    )
    parts = placed.groupBy("queue", "size", "part").agg(F.count("*").alias("rows"))
    shares = stage(_shared_out(parts, decided), "shares")
    turn = F.row_number().over(Window.partitionBy("queue", "size", "part").orderBy("key", "id"))
    joined = placed.join(shares, ["queue", "size", "part"]).withColumn("turn", turn)
    own = F.col("whole") + (F.col("turn") <= F.col("extra")).cast("long")
    return joined.withColumn("own", own).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "rate",
        F.col("own").alias("copies"),
        (F.col("own") * F.col("size")).alias("taken"),
    )


def cycled_targets(cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2):
    """Targets by weights that repeat over the sources in code point order, null last."""

    def targets(sources: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.orderBy("queue")) - 1
        weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int"))
        return capped_targets(sources.withColumn("w", weight), F.col("w"), share, float(most)).drop("w")

    return targets
