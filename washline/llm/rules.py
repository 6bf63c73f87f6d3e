"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import SEPARATORS

#: Frequent function words of the languages the rules are used on (fixed values).
STOP_WORDS = (
    "the be to of and that have with in is was for on it as by this from or an at are not you he his "
    "la le les un une des et est en que qui pour dans sur pas avec par du au "
    "der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch "
    "el los las del una es por con para como su se lo más al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``over * top`` is outside ``low`` to ``high`` times ``below`` (whole numbers)."""

    name: str
    top: str
    below: str
    low: int | None = None
    high: int | None = None
    scale: int = 1000


RULES = (
    Rule("length", "n_words", "one", low=20, scale=1),
    Rule("word_length", "word_chars", "n_words", low=2, high=25, scale=1),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "n_words", low=10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """Words covered by ``width``-word windows that occur twice or more in the array.

    Linear in the words if no window is repeated; otherwise windows are sorted once.
    """

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        )

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

        def same(pairs: Column) -> Column:
            hit = F.transform(
                pairs,
                lambda p, k: F.when(
                    (p["v"] == F.get(pairs, k - 1)["v"]) | (p["v"] == F.get(pairs, k + 1)["v"]), p["i"]
                ),
            )
            return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(ordered, same), total)

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= width, let(hashed, lambda h: let(windows(h), count))).otherwise(0).cast("long")


def _deleted(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules are made of, for every row; all 0 for a null or blank text.

    A very long text costs memory in proportion to its words, in its own task only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.filter(F.split(text, SEPARATORS + "+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    return split.select(
        F.col("_id").alias(id_col),
        F.size("_words").cast("long").alias("n_words"),
        F.length(_deleted(F.col("_text"), " \n\t\r\x0b\x0c")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_deleted(F.col("_text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def passes(rule: Rule) -> Column:
    one = F.lit(1).cast("long")
    top = one if rule.top == "one" else F.col(rule.top)
    below = one if rule.below == "one" else F.col(rule.below)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (top * rule.scale >= below * rule.low)
    if rule.high is not None:
        ok = ok & (top * rule.scale <= below * rule.high)
    return ok


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row.

    ``base_failed``: fewer than 20 words, or more than 30 percent of them in repeated 8-word
    windows. ``kept``: not so, and within all thresholds of the table.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    return measures(docs, id_col, text_col).select("*", base.alias("base_failed"), (~base & verdict).alias("kept"))


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rules in SQL over ``documents``."""
    conditions = []
    for r in rules:
        top, below = ("1" if x == "one" else x for x in (r.top, r.below))
        if r.low is not None:
            conditions.append(f"{top} * {r.scale} >= {below} * {r.low}")
        if r.high is not None:
            conditions.append(f"{top} * {r.scale} <= {below} * {r.high}")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS g
  FROM base, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
repeated AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
spans AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM repeated),
covered AS (SELECT r, sum(n) AS n FROM spans GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM base LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND {' AND '.join(conditions)} AS kept FROM judged
"""
