"""Perspective rotation of dialogues with several parties.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users. The loss mask covers what the assistant says and
the mark that ends it.

A dialogue is rendered in parts of consecutive turns, by one rule for every length: a part holds its own
turns, of which those of the assistant are learned, and before them a context that is not: the system messages
among the first turns of the conversation, then the turns right before the part. A conversation of up to a part's
length is one part without context. Rows are bounded by the two lengths, and what the longest conversation
makes grows with its turns: a part is rendered for those who speak in it.

Conversations of one part are gathered by one shuffle. The turns of others are numbered by a range
partitioning, in which a conversation may span any number of tasks, and gathered by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline.llm.common import stage

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Turns in a part, and turns of the context right before it.
MAX_TURNS, OVERLAP = 256, 32


def _key(column: Column) -> Column:
    """Never null; null sorts last."""
    return F.concat(F.when(column.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(column.cast("string"), F.lit("")))


def _plain(text: Column) -> Column:
    """Text that cannot pass for a mark of the format."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def numbered(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``rank``, the place of each row among those with its ``keys`` in ``order``, from 0.

    Equal rows are spread by their place in the input; which of them comes first makes no difference.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = turns.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ties.repartitionByRange(parts, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    placed = stage(
        ranged.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered"
    )
    runs = placed.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(runs, [*keys, "_task"])
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_task", "_at", "_first", "_ahead")


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    order_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: tuple[str, ...] = ("system",),
    max_turns: int = MAX_TURNS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per conversation, part and speaker of the part: id, perspective, part, n_turns, n_context, n_own, text, spans.

    Turns follow ``order_col`` (null last), then speaker and text, so ties have one order; repeated
    rows are repeated turns. Every turn is one of the ``n_turns`` own turns of one part of at most ``max_turns``. The
    ``n_context`` turns before them are the system messages among the first ``max_turns`` turns of the conversation
    and the last ``overlap`` turns before the part, each once; the assistant's are not learned there.
    Turns of ``system`` speakers are system messages in every perspective and have none of their own. Who says nothing
    in a part has nothing to learn in it and no row for it. A null speaker is ``unknown``, a null text is
    empty, a null id is a conversation of its own. ``spans`` are character ranges of ``text`` that are learned.
    """
    if max_turns < 1 or not 0 <= overlap <= max_turns:
        raise ValueError("max_turns must be at least 1, overlap between 0 and max_turns")
    rows = turns.select(
        _key(F.col(conv_col)).alias("conv"),
        F.col(conv_col).alias("id"),
        F.col(order_col).isNull().alias("late"),
        F.col(order_col).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    counts = rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > max_turns)
    long = stage(counts, "long")
    turn = F.struct("late", "turn", "speaker", "text", F.lit(False).alias("context"))
    gathered = (
        rows.join(long, "conv", "left_anti")
        .groupBy("conv")
        .agg(F.first("id").alias("id"), F.sort_array(F.collect_list(turn)).alias("messages"))
        .select("id", F.lit(0).cast("long").alias("part"), _shown_turns("messages"))
    )
    both = gathered.unionByName(_long_parts(rows.join(long.select("conv"), "conv", "left_semi"), long, system, max_turns, overlap))
    own = F.filter("messages", lambda m: ~m["context"])
    people = F.array_distinct(F.filter(F.transform(own, lambda m: m["speaker"]), lambda s: ~s.isin(*system)))
    n_turns = F.size(own).cast("long")
    return (
        both.withColumns({"n_turns": n_turns, "n_context": F.size("messages").cast("long") - n_turns})
        .withColumn("perspective", F.explode(people))
        .select(
            F.col("id").alias(conv_col), "perspective", "part", "n_turns", "n_context",
            _rendered(F.col("messages"), F.col("perspective"), system).alias("rendered"),
        )
        .select(conv_col, "perspective", "part", "n_turns", "n_context", "rendered.n_own", "rendered.text", "rendered.spans")
    )


def _shown_turns(messages: str) -> Column:
    """What rendering needs of each turn."""
    return F.transform(messages, lambda m: F.struct(m["speaker"], m["text"], m["context"])).alias("messages")


def _long_parts(
    rows: DataFrame, counts: DataFrame, system: tuple[str, ...], max_turns: int, overlap: int
) -> DataFrame:
    """(id, part, messages) of conversations that make several parts; ``counts`` has their numbers of turns ``n``."""
    ranked = stage(numbered(rows, ["conv"], ["late", "turn", "speaker", "text"]), "turns")
    place = ranked.withColumn("part", F.floor(F.col("rank") / max_turns))
    of_system, first = F.col("speaker").isin(*system), F.col("part") == 0
    needed = ("conv", "id", "part", "rank", "speaker", "text", "context")
    own = place.withColumn("context", F.lit(False)).select(*needed)
    joined = place.where(first & of_system).join(counts, "conv")
    last = F.floor((F.col("n") - 1) / max_turns)
    heads = joined.withColumns({"context": F.lit(True), "part": F.explode(F.sequence(F.lit(1).cast("long"), last))}).select(*needed)
    ends = place.where((F.col("rank") % max_turns >= max_turns - overlap) & ~(first & of_system))
    before = ends.withColumns({"context": F.lit(True), "part": F.col("part") + 1}).select(*needed)
    turn = F.struct("rank", "speaker", "text", "context")
    return (
        own.unionByName(heads)
        .unionByName(before)
        .groupBy("conv", "part")
        .agg(F.first("id").alias("id"), F.sort_array(F.collect_list(turn)).alias("messages"))
        .select("id", "part", _shown_turns("messages"))
    )


def _rendered(messages: Column, perspective: Column, system: tuple[str, ...]) -> Column:
    name = lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}_.-]+", "_")

    def shown(m: Column) -> Column:
        own = m["speaker"] == perspective
        role = (
            F.when(own, F.lit("assistant"))
            .when(m["speaker"].isin(*system), F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), name(m["speaker"])))
        )
        return F.struct(
            (own & ~m["context"]).alias("own"),
            F.concat(F.lit(BEGIN), role, F.lit("\n")).alias("head"),
            F.concat(_plain(m["text"]), F.lit(END)).alias("body"),
        )

    def bound(value: Column, body) -> Column:
        """``body`` of ``value``, computed once: the list of one element binds it."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def assembled(shown_messages: Column) -> Column:
        # Where each message begins, and where the last ends.
        begins = F.aggregate(
            shown_messages,
            F.array(F.lit(0)),
            lambda at, m: F.concat(at, F.array(F.element_at(at, -1) + F.length(m["head"]) + F.length(m["body"]) + 1)),
        )
        return bound(begins, lambda at: with_spans(shown_messages, at))

    def with_spans(shown_messages: Column, begins: Column) -> Column:
        spans = F.filter(
            F.transform(
                shown_messages,
                lambda m, i: F.when(
                    m["own"],
                    F.struct(
                        (F.get(begins, i) + F.length(m["head"])).alias("start"),
                        (F.get(begins, i) + F.length(m["head"]) + F.length(m["body"])).alias("end"),
                    ),
                ),
            ),
            lambda s: s.isNotNull(),
        )
        text = F.array_join(F.transform(shown_messages, lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "")
        return bound(spans, lambda s: F.struct(F.size(s).cast("long").alias("n_own"), text.alias("text"), s.alias("spans")))

    return bound(F.transform(messages, shown), assembled)
