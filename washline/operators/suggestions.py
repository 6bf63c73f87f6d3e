"""Model answers about data quality, normalised from raw JSON text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions.names import quoted
from washline.functions.text import strip

# Fixed values.
CATEGORIES = (
    "schema", "quality", "missing", "duplicates", "outliers", "formatting", "business_rules",
)
SEVERITIES = ("info", "warning", "critical")
MOST_PER_ANSWER = 12

_LIST = "array<variant>"


def strip_code_fence(c: Column) -> Column:
    """Answer without the code-fence lines around it."""
    text = strip(c)
    opened = F.regexp_replace(text, r"\A```[^\r\n]*(?:\r?\n|\z)", "")
    inner = F.regexp_replace(opened, r"(?:\A|\r?\n)[ \t]*```[^\r\n]*\z", "")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def _items(answer: Column) -> Column:
    """The suggestions of an answer: under their key, or the answer itself if it is a list."""
    return F.coalesce(
        F.try_variant_get(answer, "$.suggestions", _LIST), F.try_variant_get(answer, "$", _LIST)
    )


def parse_suggestions(df: DataFrame, answer: str, keys: list[str]) -> DataFrame:
    """Rows (keys, position, category, severity, message, column, evidence).

    An answer that is no valid JSON has no rows. Only the first twelve entries of an answer
    count, and of these only objects with a message.
    """
    parsed = df.select(
        *(quoted(k) for k in keys),
        F.try_parse_json(strip_code_fence(quoted(answer))).alias("__answer"),
    )
    entries = parsed.select(
        *(quoted(k) for k in keys),
        F.posexplode(F.slice(_items(F.col("__answer")), 1, MOST_PER_ANSWER)).alias(
            "position", "__item"
        ),
    ).where(F.schema_of_variant("__item").startswith("OBJECT"))

    def text(field: str) -> Column:
        return F.try_variant_get(F.col("__item"), f"$.{field}", "string")

    def one_of(field: str, allowed: tuple[str, ...], default: str) -> Column:
        value = F.lower(text(field))
        return F.when(value.isin(*allowed), value).otherwise(F.lit(default))

    # A message that is present but null reads "None", as it would printed as text.
    message = F.try_variant_get(F.col("__item"), "$.message", "variant")
    message_text = F.when(F.is_variant_null(message), F.lit("None")).otherwise(text("message"))
    column = text("column")
    evidence = F.try_variant_get(F.col("__item"), "$.evidence", "variant")
    return entries.select(
        *(quoted(k) for k in keys),
        "position",
        one_of("category", CATEGORIES, "quality").alias("category"),
        one_of("severity", SEVERITIES, "info").alias("severity"),
        strip(message_text).alias("message"),
        F.when(strip(column) != "", column).alias("column"),
        F.when(F.schema_of_variant(evidence).startswith("OBJECT"), F.to_json(evidence)).alias(
            "evidence"
        ),
    ).where("message != ''")


def suggestions_by_category(suggestions: DataFrame) -> DataFrame:
    """Number of suggestions per category."""
    return suggestions.groupBy("category").agg(F.count(F.lit(1)).alias("suggestions"))
