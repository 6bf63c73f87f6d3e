"""A fitted cleaning model: decisions frozen as plain data, applied as column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from washline.functions.columns import missing_as_null
from washline.operators.columns import clean_text_columns, normalize_categorical_text
from washline.operators.dedup import count_copies
from washline.operators.formats import apply_targets
from washline.operators.missing import Fill, apply_fills
from washline.operators.outliers import Bounds, apply_caps, apply_ranges


@dataclass(frozen=True)
class CleaningModel:
    """Per-column decisions of a cleaning run, by position (``c0``, ``c1``, ...).

    ``transform`` works row by row with built-in expressions, so it serves batch tables and
    streams alike, and it never looks at the data again.
    """

    source_names: tuple[str, ...]
    output_names: tuple[str, ...]
    clean_text: bool
    tokens_after_strip: bool
    bare_digit_dates: bool
    ignore_currency_code_case: bool
    nfkc: tuple[str, ...]
    mapping: Mapping[str, Mapping[str, str | None]]
    targets: Mapping[str, str]
    ranges: Mapping[str, Bounds]
    caps: Mapping[str, Bounds]
    fills: Mapping[str, Fill]

    def positional(self, df: DataFrame) -> DataFrame:
        """Input under internal names, so odd or clashing names never matter."""
        if list(df.columns) != list(self.source_names):
            raise ValueError(f"expected the columns {list(self.source_names)}, got {df.columns}")
        return missing_as_null(df.toDF(*(f"c{i}" for i in range(len(df.columns)))))

    def with_clean_text(self, rows: DataFrame) -> DataFrame:
        if not self.clean_text:
            return rows
        cleaned = clean_text_columns(
            rows, tokens_after_strip=self.tokens_after_strip, unicode=self.nfkc
        )
        return normalize_categorical_text(cleaned, self.mapping)

    def with_types(
        self, rows: DataFrame, values: Mapping[str, DataFrame] | None = None
    ) -> DataFrame:
        """Typed columns; ``values`` may bring values parsed before."""
        return apply_targets(
            rows,
            self.targets,
            bare_digits=self.bare_digit_dates,
            ignore_code_case=self.ignore_currency_code_case,
            values=values,
        )

    def with_values(self, rows: DataFrame) -> DataFrame:
        """Outlier and missing-value rules on typed rows."""
        return apply_fills(apply_caps(apply_ranges(rows, self.ranges), self.caps), self.fills)

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(f"c{i}" for i in range(len(self.output_names)))).toDF(
            *self.output_names
        )

    def transform(self, df: DataFrame, *, deduplicate: bool = False) -> DataFrame:
        """Clean a table with the same columns; repeated rows go only on request."""
        rows = self.positional(df)
        if deduplicate:
            rows = count_copies(rows).drop("__copies")
        return self.named(self.with_values(self.with_types(self.with_clean_text(rows))))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CleaningModel:
        data = json.loads(text)
        for name in ("source_names", "output_names", "nfkc"):
            data[name] = tuple(data[name])
        for name in ("ranges", "caps"):
            data[name] = {c: Bounds(**b) for c, b in data[name].items()}
        data["fills"] = {c: Fill(**f) for c, f in data["fills"].items()}
        return cls(**data)
