"""Audit of filters that run one after the other: what each order removes, step by step.

Every row of the corpus gets an identity once. For each filter, the identities of the rows that
fail it are stored as a relation of their own, and all that is asked is answered by joins of
such relations on the identity:

* survivors of a prefix of filters: all rows, less (left anti) those that fail one of the prefix;
* removed by the next filter: its failing rows, less those that fail one of the prefix;
* redundant there: its failing rows that also (left semi) fail one of the prefix.

What a prefix leaves does not depend on its order, so there are 2^k prefixes for k filters, and
they are rows of one relation (identity, prefix), not joins of their own: three joins answer all
orders. All of them meet on the identity, so each relation is shuffled once. Label flags ride on
the identities, and sums over the joined rows give the label losses.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import WORD, shared_folder, stage

#: Filters of the audit as conditions of failure over the measures of ``measured``.
FILTERS: Mapping[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Stage (row, id, part, digest, n_words, n_distinct, n_capitals, n_chars, has_symbol): the one pass over texts.

    ``row`` is made once and read from then on, so it stays the same when tasks are run again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return stage(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "part",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.size("words").alias("n_words"),
            F.size(F.array_distinct("words")).alias("n_distinct"),
            (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_capitals"),
            F.length("text").alias("n_chars"),
            F.col("text").rlike(r"[#$%&*|]").alias("has_symbol"),
        ),
        "measures",
    )


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a row with a smaller id has; a null id is larger than all others.

    Smallest ids are combined before the shuffle. Only texts that occur twice are joined back, and
    a text of very many rows is the larger side of a plain inner join, which Spark may split.
    """
    least = rows.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    joined = rows.select("row", "id", "digest").join(least, F.col("digest") == F.col("d"))
    later = joined.where("least < id OR (id IS NULL AND least IS NOT NULL)")
    return stage(later.select("row"), "copies")


def failing(rows: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Stage one relation of failing rows for each filter: a folder ``filter=k`` of (row)."""
    own = {k: c for k, c in enumerate(filters.values()) if "is_copy" not in c}
    hit = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in own.items()]))
    table = rows.select("row", F.explode(hit).alias("filter"))
    for k, c in enumerate(filters.values()):
        if k not in own:
            if c != "is_copy":
                raise ValueError("is_copy stands alone in a filter")
            table = table.unionByName(later_copies(rows).withColumn("filter", F.lit(k)))
    path = shared_folder(rows.sparkSession, "failing")
    table.write.partitionBy("filter").parquet(path)
    return rows.sparkSession.read.schema("row long, filter int").parquet(path)


def labelled(rows: DataFrame, labels: DataFrame, id_col: str, flags: Mapping[str, Column]) -> DataFrame:
    """Stage (row, part, one flag 0/1 for each label): 1 if any label of the row's id has it."""
    marks = labels.groupBy(F.col(id_col).alias("label_id")).agg(
        *[F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in flags.items()]
    )
    joined = rows.select("row", "id", "part").join(marks, F.col("id") == F.col("label_id"), "left")
    return stage(joined.select("row", "part", *[F.coalesce(n, F.lit(0)).alias(n) for n in flags]), "labelled")


def _among(filter_col: str, prefix: Column) -> Column:
    """Whether the filter is in the prefix, a set of bits."""
    return F.expr(f"shiftleft(1, {filter_col})").bitwiseAND(prefix) != 0


def prefix_counts(rows: DataFrame, fails: DataFrame, n_filters: int, flags: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Counts of every prefix: (part, prefix, kept) and (part, filter, prefix, removed, redundant, label losses)."""
    prefixes = F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)))
    other = fails.select(F.col("row").alias("other_row"), F.col("filter").alias("other"))

    def in_prefix(frame: DataFrame) -> Column:
        return (frame["row"] == F.col("other_row")) & _among("other", F.col("prefix"))

    each = rows.select("row", "part", prefixes.alias("prefix"))
    kept = each.join(other, in_prefix(each), "left_anti").groupBy("part", "prefix").agg(F.count("*").alias("kept"))

    failed = fails.join(rows, "row").select("row", "part", "filter", *flags, prefixes.alias("prefix"))
    failed = failed.where(~_among("filter", F.col("prefix")))
    key = ["part", "filter", "prefix"]
    removed = failed.join(other, in_prefix(failed), "left_anti").groupBy(key).agg(
        F.count("*").alias("removed"), *[F.sum(f).alias(f) for f in flags]
    )
    redundant = failed.join(other, in_prefix(failed), "left_semi").groupBy(key).agg(F.count("*").alias("redundant"))
    return kept, removed.join(redundant, key, "full")


def _grid(parts: DataFrame, orders: str, names: str) -> DataFrame:
    """(part, filter_order, step, filter, prefix, after): the prefix before each step of each order and after it."""
    before = F.expr("substr(filter_order, 1, step - 1)")
    bits = sum((F.when(F.contains(before, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))
    return (
        parts.select("part", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
        .select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
        .withColumn("filter", F.expr(f"instr('{names}', substr(filter_order, step, 1)) - 1"))
        .withColumn("prefix", bits)
        .withColumn("after", F.col("prefix") + F.expr("shiftleft(1, filter)"))
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, str] = FILTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row per part, order of all filters, and step: what the step keeps, removes, repeats and costs.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley;
    all long but the first three. A null text is empty, a null part is ``''``, a null id comes after
    all others and has no label. Repeated rows count as often as they occur; of equal rows none
    is a copy of the other, as their ids are equal. An empty table gives no rows. Filters are
    one letter each; the number of orders limits them to seven or so.
    """
    names = "".join(filters)
    if not re.fullmatch("[A-Za-z]+", names) or len(names) != len(filters):
        raise ValueError("a filter's name is one letter")
    k = len(names)
    flags = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    measures = measured(docs, id_col, text_col, part_col)
    fails = failing(measures, filters)
    kept, steps = prefix_counts(labelled(measures, labels, id_col, flags), fails, k, tuple(flags))
    kept, steps = stage(kept, "kept"), stage(steps, "steps")

    # In how many orders a prefix of s filters stands right before a filter: s! (k - 1 - s)!
    size = F.bit_count("prefix")
    of_filter = steps.groupBy("part", "filter").agg(
        F.sum(F.coalesce("removed", F.lit(0)) * F.factorial(size) * F.factorial(F.lit(k - 1) - size)).alias("shapley"),
        F.sum(F.when(size == k - 1, F.col("removed"))).alias("unique_fails"),
    )

    orders = ",".join("".join(p) for p in permutations(names))
    grid = _grid(kept.select("part").distinct(), orders, names)
    after = kept.select("part", F.col("prefix").alias("after"), "kept")
    full = (
        grid.join(after, ["part", "after"], "left")
        .join(steps, ["part", "filter", "prefix"], "left")
        .join(of_filter, ["part", "filter"], "left")
    )
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return full.select("part", "filter_order", "step", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
