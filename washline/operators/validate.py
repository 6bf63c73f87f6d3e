"""Declared schemas: a spec becomes a list of violation conditions, checked in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.errors import DependencyError, ValidationError
from washline.functions.columns import missing_as_null
from washline.functions.names import quoted
from washline.functions.parsing import parse_datetime
from washline.operators.listed import Listed, is_long, label, listed_values

# Declared type names and the Spark types they stand for.
DTYPES = {
    "int": "bigint",
    "float": "double",
    "str": "string",
    "bool": "boolean",
    "datetime": "timestamp_ntz",
}


def _only(known: tuple[str, ...], given: Mapping, what: str) -> None:
    extra = sorted(set(given) - set(known))
    if extra:
        raise ValidationError(f"{what}: unknown key(s) {extra}")


@dataclass(frozen=True)
class CheckSpec:
    """Exactly one of a closed range, a list (or one-column table) of allowed values, or a pattern."""

    in_range: Mapping[str, float] | None = None
    isin: list | DataFrame | None = None
    regex: str | None = None

    def __post_init__(self) -> None:
        given = [x for x in (self.in_range, self.isin, self.regex) if x is not None]
        if len(given) != 1:
            raise ValidationError("a check holds one of in_range, isin and regex, and only one")
        if self.in_range is not None and not {"min", "max"} <= set(self.in_range):
            raise ValidationError("in_range needs both min and max")

    @classmethod
    def from_dict(cls, spec: Mapping) -> CheckSpec:
        _only(("in_range", "isin", "regex"), spec, "check")
        return cls(**spec)


@dataclass(frozen=True)
class ColumnSpec:
    """Declared type of a column, whether it may be missing, and its checks."""

    dtype: str
    nullable: bool = False
    required: bool = True
    checks: tuple[CheckSpec, ...] = ()

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValidationError(f"dtype must be one of {list(DTYPES)}, not {self.dtype!r}")
        if any(c.regex is not None for c in self.checks) and self.dtype != "str":
            raise ValidationError("a regex check needs dtype str")
        if any(c.in_range is not None for c in self.checks) and self.dtype not in ("int", "float"):
            raise ValidationError("an in_range check needs dtype int or float")

    @classmethod
    def from_dict(cls, spec: Mapping) -> ColumnSpec:
        _only(("dtype", "nullable", "required", "checks"), spec, "column")
        if "dtype" not in spec:
            raise ValidationError("column: dtype is missing")
        checks = tuple(CheckSpec.from_dict(c) for c in spec.get("checks") or ())
        return cls(**{**spec, "checks": checks})


@dataclass(frozen=True)
class SchemaSpec:
    """Declared columns of a table. Columns not listed are allowed."""

    columns: Mapping[str, ColumnSpec] = field(default_factory=dict)
    name: str | None = None

    @classmethod
    def from_dict(cls, spec: object) -> SchemaSpec:
        if not isinstance(spec, Mapping):
            raise ValidationError("a schema spec must be a top-level mapping")
        _only(("name", "columns"), spec, "schema")
        if not isinstance(spec.get("columns"), Mapping):
            raise ValidationError("schema: columns must be a mapping")
        columns = {}
        for name, column in spec["columns"].items():
            if not isinstance(column, Mapping):
                raise ValidationError(f"schema: column {name!r} must be a mapping")
            columns[name] = ColumnSpec.from_dict(column)
        return cls(columns, spec.get("name"))


def load_spec(path: str) -> SchemaSpec:
    """Read a schema spec from a YAML file on the driver."""
    try:
        import yaml
    except ImportError as error:
        raise DependencyError("reading schema files needs PyYAML") from error
    with open(path, encoding="utf-8") as lines:
        try:
            data = yaml.safe_load(lines) or {}
        except yaml.YAMLError as error:
            raise ValidationError(f"schema file is not valid YAML: {error}") from error
    return SchemaSpec.from_dict(data)


@dataclass(frozen=True)
class _Rule:
    column: str
    check: str
    violated: Column | None  # None: the table as a whole breaks the rule, or ``listed`` decides
    case: Column
    listed: Listed | None = None
    value: Column | None = None


def _as_spec(spec: SchemaSpec | Mapping) -> SchemaSpec:
    return spec if isinstance(spec, SchemaSpec) else SchemaSpec.from_dict(spec)


def _check_rule(check: CheckSpec, value: Column, dtype: str) -> tuple[str, Column]:
    if check.in_range is not None:
        low, high = check.in_range["min"], check.in_range["max"]
        return f"in_range({low}, {high})", ~value.between(F.lit(low), F.lit(high))
    if check.isin is not None:
        # Listed values are read as values of the column; one that cannot be is never met.
        known = F.filter(
            F.array(*[F.lit(v if v is None else str(v)).try_cast(dtype) for v in check.isin]), lambda x: x.isNotNull()
        )
        found = F.coalesce(F.array_contains(known, value), F.lit(False)) if check.isin else F.lit(False)
        return label(check.isin), value.isNotNull() & ~found
    # A pattern must match from the start of the text, not to its end.
    return f"str_matches({check.regex!r})", ~value.rlike(rf"\A(?:{check.regex})")


def _rules(df: DataFrame, spec: SchemaSpec) -> list[_Rule]:
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    rules: list[_Rule] = []
    for name, column in spec.columns.items():
        if name not in dtypes:
            if column.required:
                rules.append(_Rule(name, "required", None, F.lit(name)))
            continue
        raw = quoted(name)
        if column.dtype == "datetime" and isinstance(dtypes[name], T.StringType):
            value = parse_datetime(name)
        else:
            value = raw.try_cast(DTYPES[column.dtype])
        misfit = raw.isNotNull() & value.isNull()
        if column.dtype == "int" and isinstance(dtypes[name], (T.FractionalType,)):
            misfit = misfit | (raw != F.floor(raw))
        case = raw.cast("string")
        rules.append(_Rule(name, f"dtype({column.dtype})", misfit, case))
        if not column.nullable:
            rules.append(_Rule(name, "not_nullable", raw.isNull(), case))
        for check in column.checks:
            if check.isin is not None and is_long(check.isin):
                listed = listed_values(df.sparkSession, check.isin, DTYPES[column.dtype])
                rules.append(_Rule(name, label(check.isin), None, case, listed, value))
                continue
            text, broken = _check_rule(check, value, DTYPES[column.dtype])
            rules.append(_Rule(name, text, broken, case))
    return rules


def validation_report(df: DataFrame, spec: SchemaSpec | Mapping) -> DataFrame:
    """Every rule with its number of violations, counted in one pass and one more for each long list.

    The table is only read. A missing value breaks no rule but ``not_nullable``.
    """
    rows = missing_as_null(df)
    rules = _rules(rows, _as_spec(spec))
    counted = [r for r in rules if r.violated is not None]
    counts = iter(
        rows.agg(*(F.count_if(r.violated).alias(f"n{i}") for i, r in enumerate(counted))).first()
        if counted
        else ()
    )

    def failed(r: _Rule) -> int:
        if r.listed is not None:
            return r.listed.count_unlisted(rows, r.value)
        return 1 if r.violated is None else next(counts)

    result = [(i, r.column, r.check, failed(r)) for i, r in enumerate(rules)]
    return df.sparkSession.createDataFrame(
        result, "rule int, column string, check string, n_failed bigint"
    )


def failure_cases(
    df: DataFrame,
    spec: SchemaSpec | Mapping,
    *,
    limit: int | None = None,
    order_key: str | None = None,
) -> DataFrame:
    """Violating values as rows (rule, column, check, failure_case).

    With ``limit`` the first ones by rule, then by ``order_key`` (else by value).
    """
    rows = missing_as_null(df)
    rules = _rules(rows, _as_spec(spec))
    schema = "rule int, column string, check string, failure_case string"
    whole = [
        (i, r.column, r.check, r.column)
        for i, r in enumerate(rules)
        if r.violated is None and r.listed is None
    ]
    key = quoted(order_key) if order_key else F.lit(None).cast("string")
    hits = [
        F.when(
            r.violated,
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(r.column).alias("column"),
                F.lit(r.check).alias("check"),
                r.case.alias("failure_case"),
            ),
        )
        for i, r in enumerate(rules)
        if r.violated is not None
    ]
    cases = df.sparkSession.createDataFrame(whole, schema).withColumn(
        "__key", F.lit(None).cast(rows.select(key.alias("k")).schema[0].dataType)
    )
    if hits:
        broken = [F.coalesce(r.violated, F.lit(False)) for r in rules if r.violated is not None]
        failing = rows.where(reduce(or_, broken))
        found = failing.select(key.alias("__key"), F.explode(F.array(*hits)).alias("hit"))
        cases = cases.unionByName(
            found.where("hit is not null").select("hit.*", "__key")
        )
    for i, r in enumerate(rules):
        if r.listed is not None:
            present = rows.select(r.value.alias("listed"), r.case.alias("failure_case"), key.alias("__key"))
            names = {"rule": F.lit(i), "column": F.lit(r.column), "check": F.lit(r.check)}
            cases = cases.unionByName(r.listed.unlisted(present).withColumns(names).drop("listed"))
    if limit is not None:
        cases = cases.orderBy("rule", "__key", "failure_case").limit(limit)
    return cases.drop("__key")


def assert_valid(
    df: DataFrame, spec: SchemaSpec | Mapping, *, order_key: str | None = None
) -> None:
    """Raise ValidationError with the first three failures, if there are any."""
    cases = failure_cases(df, spec, limit=3, order_key=order_key).collect()
    if cases:
        listed = "; ".join(f"{c.column}: {c.check} ({c.failure_case})" for c in cases)
        raise ValidationError(f"Schema validation failed: {listed}")
