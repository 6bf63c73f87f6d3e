"""The cleaning run: duplicates, names, text, formats, outliers, missing values.

Jobs of one run, whatever the number of columns:

1. stage the distinct rows (the only shuffle of whole rows);
2. a light pass over the text columns, and one that parses those worth it;
3. stage the typed table, only if a column changed its type;
4. one pass for the moments of all numeric and datetime columns;
5. quartiles and medians together;
6. one pass for the moments of capped columns that also have gaps;
7. one count per value for text columns with gaps.

Only small rows of statistics reach the driver. The cleaned table itself stays lazy.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline import staging
from washline.errors import InvalidInputError
from washline.functions import text as text_rules
from washline.functions.columns import (
    as_double,
    as_micros,
    boolean_columns,
    datetime_columns,
    numeric_columns,
    text_columns,
    typed_columns,
)
from washline.functions.names import normalize_name, quoted, unique_names
from washline.operators import formats, missing, outliers
from washline.operators.columns import preview_rows
from washline.operators.dedup import count_copies
from washline.operators.statistics import Moments, modes, moments, quantiles
from washline.plans.config import CleaningConfig
from washline.plans.model import CleaningModel

_COPIES = "__copies"

STEPS = (
    "remove_duplicates",
    "normalize_columns",
    "clean_text",
    "standardize_formats",
    "handle_outliers",
    "fill_missing",
)


@dataclass
class StepLog:
    """What each step did, and how long its jobs took."""

    entries: list[tuple] = field(default_factory=list)
    milliseconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def timed(self, step: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        self.milliseconds[step] = (time.perf_counter() - start) * 1000.0

    def add(self, step: str, before: int, after: int, skipped: bool = False, **counts: int) -> None:
        self.entries.append((step, before, after, "skipped" if skipped else "done", counts))

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.entries,
            "step string, rows_before bigint, rows_after bigint, status string,"
            " counts map<string,bigint>",
        )


@dataclass
class CleaningRun:
    """Everything a run produced: the model, the lazy cleaned table and the records."""

    model: CleaningModel
    table: DataFrame
    summary: dict[str, object]
    log: StepLog
    scope: staging.StageScope
    staged: list[str]

    def release(self) -> None:
        """Delete what the run staged; the lazy table stops working."""
        self.scope.release(self.table.sparkSession, [p for p in self.staged if p in self.scope.paths()])


def readable_duration(seconds: float) -> str:
    """``4.20s``, ``2m 5s`` or ``1h 2m 5s``."""
    if seconds < 60:
        return f"{seconds:.2f}s"
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    return f"{hours}h {minutes}m {rest:.0f}s" if hours else f"{minutes}m {rest:.0f}s"


def dataset_kind(name: str | None) -> str | None:
    """Kind of a dataset by its file suffix; None without a name."""
    if not name:
        return None
    kinds = {"csv": "csv", "parquet": "parquet", "xlsx": "excel", "xlsm": "excel"}
    return kinds.get(name.lower().rpartition(".")[2], "unknown")


def _output_names(columns: Sequence[str], config: CleaningConfig) -> list[str]:
    if config.normalize_cols:
        return unique_names(normalize_name(c) for c in columns)
    # Spark resolves names without case; clashing ones would make the output unusable.
    return unique_names(columns, fold=str.lower)


def blank_model(columns: Sequence[str], config: CleaningConfig) -> CleaningModel:
    """A model that has learned nothing yet: names and the rules that the configuration fixes."""
    model = CleaningModel(
        source_names=tuple(columns),
        output_names=tuple(_output_names(columns, config)),
        clean_text=config.clean_text,
        tokens_after_strip=config.tokens_after_strip,
        bare_digit_dates=config.bare_digit_dates,
        ignore_currency_code_case=config.ignore_currency_code_case,
        nfkc=(),
        mapping={},
        targets={},
        ranges={},
        caps={},
        fills={},
    )
    if not (config.clean_text and config.categorical_mapping):
        return model
    internal = internal_names(model)
    mapping = {internal[c]: dict(v) for c, v in config.categorical_mapping.items() if c in internal}
    return replace(model, mapping=mapping)


def internal_names(model: CleaningModel) -> dict[str, str]:
    """Output name to internal name (``c0``, ``c1``, ...)."""
    return {label: f"c{i}" for i, label in enumerate(model.output_names)}


def survey_of(rows: DataFrame, model: CleaningModel) -> dict[str, formats.TextSurvey]:
    def present(c: Column) -> Column:
        if not model.clean_text:
            return c
        return text_rules.without_null_tokens(c, model.tokens_after_strip)

    return formats.survey_text(rows, text_columns(rows), present)


def _parse_text(
    rows: DataFrame, survey: Mapping[str, formats.TextSurvey], model: CleaningModel
) -> formats.ParsedText:
    """Parser results for the columns worth it; the others are known to stay text."""
    worth = [c for c, s in survey.items() if s.may_parse or s.non_ascii or c in model.mapping]
    parsed = formats.parse_text(
        model.with_clean_text(rows),
        worth,
        survey,
        bare_digits=model.bare_digit_dates,
        ignore_code_case=model.ignore_currency_code_case,
    )
    unread = {c: formats.TextStats(s.rows, s.present) for c, s in survey.items()}
    return formats.ParsedText({**unread, **parsed.stats}, parsed.values)


def _value_columns(rows: DataFrame) -> dict[str, Column]:
    """Numeric and datetime columns as doubles."""
    dtypes = {f.name: f.dataType for f in rows.schema.fields}
    values = {c: as_double(quoted(c)) for c in numeric_columns(rows) if c != _COPIES}
    values.update(
        {c: as_micros(quoted(c), dtypes[c]).cast("double") for c in datetime_columns(rows)}
    )
    return values


@dataclass
class _Profile:
    """One pass over typed rows: row counts, gaps and moments."""

    rows: int
    copies: int
    present: dict[str, int]
    moments: dict[str, Moments]

    def gaps(self) -> list[str]:
        return [c for c, n in self.present.items() if n < self.rows]


def _profile(rows: DataFrame, text_present: Mapping[str, int] | None) -> _Profile:
    """``text_present`` carries counts already known, sparing a look at text columns."""
    columns = _value_columns(rows)
    columns.update({c: quoted(c).cast("double") for c in boolean_columns(rows)})
    texts = text_columns(rows)
    uncounted = [c for c in texts if text_present is None or c not in text_present]
    columns.update({c: F.when(quoted(c).isNotNull(), F.lit(1.0)) for c in uncounted})
    columns[_COPIES] = quoted(_COPIES).cast("double")
    found = moments(rows, columns)
    counts = found.pop(_COPIES)
    known = text_present or {}
    present = {
        f.name: known[f.name] if f.name in known and f.name in texts else found[f.name].n
        for f in rows.schema.fields
        if f.name in found or f.name in texts
    }
    return _Profile(counts.n, int(counts.total or 0), present, found)


@dataclass
class _Values:
    """Limits and fills; ``*_here`` are those that change the table they were fitted on."""

    ranges: dict[str, outliers.Bounds]
    caps: dict[str, outliers.Bounds]
    fills: dict[str, missing.Fill]
    ranges_here: list[str]
    caps_here: list[str]
    fills_here: list[str]


def whole_bounds(bounds: outliers.Bounds) -> outliers.Bounds:
    """The widest whole-number bounds inside these, so that a whole-number column stays one."""
    low, high = math.ceil(bounds.low), math.floor(bounds.high)
    return replace(bounds, low=float(low), high=float(high)) if low <= high else bounds


def _fit_values(
    rows: DataFrame, profile: _Profile, config: CleaningConfig, complete: bool
) -> tuple[_Values, DataFrame, _Profile]:
    """Limits, fills, and the remaining rows with their profile.

    ``complete`` also learns limits and fills of columns that need none here, for other rows.
    They never change the type of a column.
    """
    numbers = [c for c in numeric_columns(rows) if c != _COPIES]
    ranges: dict[str, outliers.Bounds] = {}
    ranges_here: list[str] = []
    if config.outliers == "remove":
        measured = {c: profile.moments[c] for c in numbers}
        ranges, ranges_here = outliers.fit_all_ranges(
            rows.select(*numbers),
            auto_detect=config.auto_outlier_detect,
            accuracy=config.quantile_accuracy,
            known=measured,
        )
        if ranges_here:
            rows = outliers.apply_ranges(rows, {c: ranges[c] for c in ranges_here})
            profile = _profile(rows, None)

    capping = config.outliers == "cap"
    gaps = set(profile.gaps())
    filled = list(profile.present) if complete else profile.gaps()
    values = _value_columns(rows)
    wanted: dict[str, tuple[float, ...]] = {}
    for c in values:
        stats = profile.moments[c]
        quartiles = (
            capping and c in numbers and outliers.needs_quartiles(stats, config.auto_outlier_detect)
        )
        # The skew that decides over the median is known only after the cap, so a column
        # with gaps asks for its median now. A cap never moves the middle values.
        wanted[c] = ((0.25, 0.75) if quartiles else ()) + ((0.5,) if c in filled else ())
    points = quantiles(
        rows, wanted, columns=values, known=profile.moments, accuracy=config.quantile_accuracy
    )

    dtypes = {f.name: f.dataType for f in rows.schema.fields}
    caps: dict[str, outliers.Bounds] = {}
    caps_here: list[str] = []
    if capping:
        for c in numbers:
            stats = profile.moments[c]
            bounds = outliers.bounds_of(stats, points.get(c), config.auto_outlier_detect)
            if outliers.has_outliers(stats, bounds):
                caps[c] = bounds
                caps_here.append(c)
            elif bounds is not None and complete:
                whole = isinstance(dtypes[c], T.IntegralType)
                caps[c] = whole_bounds(bounds) if whole else bounds

    after_cap = dict(profile.moments)
    changed = [c for c in caps_here if c in filled]
    if changed:
        capped = {
            c: as_double(outliers.cap_expression(quoted(c), dtypes[c], caps[c])) for c in changed
        }
        after_cap.update(moments(rows, capped))

    kinds = {f.name: missing.kind_of(f.dataType) for f in rows.schema.fields}
    fills: dict[str, missing.Fill] = {}
    for c in filled:
        kind, median = kinds[c], points.get(c, {}).get(0.5)
        if not profile.present[c]:
            fills[c] = missing.empty_fill(kind)
        elif kind == "number":
            value = missing.choose_number(after_cap[c], median)
            # A column without gaps keeps its type.
            whole = c not in gaps and isinstance(dtypes[c], T.IntegralType) and c not in caps_here
            fills[c] = missing.Fill("whole", round(value)) if whole else missing.Fill(kind, value)
        elif kind == "datetime":
            fills[c] = missing.Fill(kind, int(median))
        elif kind == "boolean":
            fills[c] = missing.Fill(kind, profile.moments[c].mean > 0.5)
    texts = [c for c in filled if kinds[c] == "text" and c not in fills]
    fills.update({c: missing.Fill("text", v) for c, v in modes(rows, texts).items()})
    here = [c for c in fills if c in gaps]
    return _Values(ranges, caps, fills, ranges_here, caps_here, here), rows, profile


def run_cleaning(
    df: DataFrame, config: CleaningConfig | None = None, *, complete: bool = True
) -> CleaningRun:
    """Fit on ``df`` and clean it. Staged tables live until the run is released.

    The model serves other rows too. ``complete=False`` spares the statistics that only other
    rows would need; the model then serves this table alone.
    """
    scope = staging.current_scope()
    if scope is staging.default_scope():
        scope = staging.StageScope()
    with staging.use_scope(scope):
        return _run_cleaning(df, config or CleaningConfig(), complete, scope)


def _run_cleaning(
    df: DataFrame, config: CleaningConfig, complete: bool, scope: staging.StageScope
) -> CleaningRun:
    if config.outliers not in outliers.METHODS:
        raise InvalidInputError(
            f"unknown outlier method {config.outliers!r}; choose from {outliers.METHODS}"
        )
    config.validate()
    if df is None or not df.columns:
        raise InvalidInputError("Input dataframe is empty.")
    started = time.perf_counter()
    log = StepLog()
    width = len(df.columns)
    model = blank_model(df.columns, config)
    internal = internal_names(model)

    with log.timed("remove_duplicates"):
        outlived = len(scope.paths())
        rows = staging.stage(count_copies(model.positional(df)))
    log.milliseconds["normalize_columns"] = 0.0

    with log.timed("clean_text"):
        texts = text_columns(rows)
        survey = survey_of(rows, model)
        if model.clean_text:
            model = replace(model, nfkc=tuple(c for c in texts if survey[c].non_ascii))
        # Other rows may have such characters anywhere.
        nfkc_all = tuple(texts) if model.clean_text else ()
    with log.timed("standardize_formats"):
        parsed = _parse_text(rows, survey, model)
        stats = parsed.stats
        labels = dict(zip(internal.values(), internal))
        targets = {c: formats.choose_target(labels[c], stats[c]) for c in texts}
        model = replace(model, targets={c: t for c, t in targets.items() if t})
        rows = model.with_types(model.with_clean_text(rows), parsed.values)
        if model.targets:
            # Parsing is worth doing once: the passes below read plain numbers.
            earlier = scope.paths()[outlived:]
            rows = staging.stage(rows)
            scope.release(df.sparkSession, earlier)
        profile = _profile(rows, {c: s.present for c, s in stats.items()})
    if profile.rows == 0:
        raise InvalidInputError("Input dataframe is empty.")
    before_values = profile

    with log.timed("handle_outliers"):
        fitted, _, profile = _fit_values(rows, profile, config, complete)
        here = replace(
            model,
            ranges={c: fitted.ranges[c] for c in fitted.ranges_here},
            caps={c: fitted.caps[c] for c in fitted.caps_here},
            fills={c: fitted.fills[c] for c in fitted.fills_here},
        )
        model = here
        if complete:
            model = replace(here, nfkc=nfkc_all, ranges=fitted.ranges, caps=fitted.caps, fills=fitted.fills)
    with log.timed("fill_missing"):
        table = model.named(model.with_values(rows))

    filled = sum(profile.rows - profile.present[c] for c in here.fills)
    removed = before_values.rows - profile.rows
    standardized = len([c for c in typed_columns(rows) if c != _COPIES])
    unread = sum(
        stats[c].present - (stats[c].datetimes if t == "timestamp_ntz" else stats[c].numbers)
        for c, t in model.targets.items()
    )
    n, m = before_values.copies, before_values.rows
    log.add("remove_duplicates", n, m, duplicates_removed=n - m)
    log.add(
        "normalize_columns",
        m,
        m,
        skipped=not config.normalize_cols,
        columns_before=width,
        columns_after=width,
    )
    log.add("clean_text", m, m, skipped=not config.clean_text, text_columns=len(texts))
    log.add(
        "standardize_formats", m, m, columns_standardized=standardized, cells_unread=unread
    )
    log.add(
        "handle_outliers",
        m,
        profile.rows,
        skipped=not config.outliers,
        outliers_handled=removed,
        columns_limited=len(here.ranges) + len(here.caps),
    )
    log.add("fill_missing", profile.rows, profile.rows, missing_filled=filled)
    for step, skipped in (
        ("clean_text", not config.clean_text),
        ("handle_outliers", not config.outliers),
    ):
        if skipped:
            log.milliseconds[step] = 0.0

    elapsed = time.perf_counter() - started
    summary: dict[str, object] = {
        "duplicates_removed": n - m,
        "outliers_handled": removed,
        "missing_filled": filled,
        "columns_standardized": standardized,
        "text_unconverted": len(texts) if config.clean_text else 0,
        "rows": profile.rows,
        "columns": width,
        "duration": readable_duration(elapsed),
    }
    if config.profile:
        summary["profiling"] = {
            "total_ms": elapsed * 1000.0,
            "steps": {step: log.milliseconds[step] for step in STEPS},
        }
    staged = scope.paths()[outlived:]
    return CleaningRun(model, table, summary, log, scope, staged)


def clean_data(
    df: DataFrame,
    *,
    outliers: str | None = "cap",
    normalize_cols: bool = True,
    clean_text: bool = True,
    categorical_mapping: Mapping[str, Mapping[str, str]] | None = None,
    auto_outlier_detect: bool = True,
    verbose: bool = False,
    profile: bool = False,
    **options: object,
) -> tuple[DataFrame, dict[str, object]]:
    """Clean a table: returns the (lazy) cleaned table and the summary.

    ``table.release()`` deletes the staged rows the table reads, once it is written.
    """
    run = run_cleaning(
        df,
        CleaningConfig(
            outliers=outliers,
            normalize_cols=normalize_cols,
            clean_text=clean_text,
            categorical_mapping=categorical_mapping,
            auto_outlier_detect=auto_outlier_detect,
            verbose=verbose,
            profile=profile,
            **options,
        ),
        complete=False,
    )
    run.table.release = run.release  # type: ignore[method-assign]
    if verbose:
        preview_rows(run.table).show(truncate=False)
    return run.table, run.summary


def fit(df: DataFrame, config: CleaningConfig | None = None) -> CleaningModel:
    """Learn a model for ``transform``; nothing staged is left behind."""
    with staging.stage_scope(df.sparkSession):
        return run_cleaning(df, config).model


def summary_frame(spark: SparkSession, summary: Mapping[str, object]) -> DataFrame:
    """The summary as a table of one row."""
    counters = (
        "rows",
        "columns",
        "duplicates_removed",
        "outliers_handled",
        "missing_filled",
        "columns_standardized",
        "text_unconverted",
    )
    fields = [T.StructField(c, T.LongType()) for c in counters]
    fields.append(T.StructField("duration", T.StringType()))
    values = tuple(summary[c] for c in counters) + (summary["duration"],)
    return spark.createDataFrame([values], T.StructType(fields))
