import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline.errors import ValidationError
from washline.operators import history, profile
from washline.operators.suggestions import parse_suggestions, suggestions_by_category
from washline.operators.validate import (
    SchemaSpec,
    assert_valid,
    failure_cases,
    load_spec,
    validation_report,
)

# ----------------------------------------------------------------------- profiles


@pytest.fixture
def people(spark):
    rows = [(i, float(i) if i % 3 else None, f"n{i % 4}", [i]) for i in range(80)]
    return spark.createDataFrame(rows, "i int, x double, s string, l array<int>"), rows


def test_profile_table(people):
    df, rows = people
    got = {r.column: r for r in profile.profile_table(df).collect()}
    x = pd.Series([r[1] for r in rows])
    assert got["x"].missing_pct == pytest.approx(x.isna().mean() * 100)
    assert got["x"].mean == pytest.approx(x.mean()) and got["x"].std == pytest.approx(x.std())
    assert got["x"].median == x.median() and got["x"].max == x.max()
    assert got["s"].n_distinct == 4 and got["s"].mean is None
    assert got["i"].n_distinct is None and got["l"].dtype == "array<int>"
    assert [r.column for r in profile.table_schema(df).collect()] == df.columns


def test_cardinality_limit(spark):
    df = spark.range(200).select((F.col("id") % 50).alias("a"), (F.col("id") % 51).alias("b"))
    assert profile.small_cardinalities(df) == {"a": 50}
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "x double")
    assert profile.small_cardinalities(zeros) == {"x": 1}


def test_profile_document(people):
    df, _ = people
    before = df.collect()
    text = profile.profile_document(df, {"rows": 80}, order_key="i").first().profile
    document = json.loads(text)
    assert document["dataset_kind"] == "unknown" and document["summary"] == {"rows": 80}
    assert document["small_cardinality"] == {"s": 4}
    assert len(document["sample_rows"]) == 50 and document["sample_rows"][0]["x"] is None
    assert document["schema"][0] == {"name": "i", "dtype": "int"}
    assert df.collect() == before


# --------------------------------------------------------------------- validation


def spec(**columns):
    return {"columns": columns}


def test_valid_table_passes(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b")], "age int, name string")
    assert_valid(df, spec(age={"dtype": "int", "nullable": False}, name={"dtype": "str"}))


@pytest.mark.parametrize(
    ("rows", "schema", "columns", "failed"),
    [
        ([("a",)], "name string", {"age": {"dtype": "int"}}, {"required"}),
        ([("a",)], "name string", {"note": {"dtype": "str", "required": False}}, set()),
        ([("not-int",)], "age string", {"age": {"dtype": "int"}}, {"dtype(int)"}),
        ([("10",), (" 7 ",)], "age string", {"age": {"dtype": "int"}}, set()),
        ([(1.5,)], "age double", {"age": {"dtype": "int"}}, {"dtype(int)"}),
        ([(2.0,)], "age double", {"age": {"dtype": "int"}}, set()),
        ([(None,)], "age int", {"age": {"dtype": "int"}}, {"not_nullable"}),
        ([(None,)], "age int", {"age": {"dtype": "int", "nullable": True}}, set()),
        ([(float("nan"),)], "x double", {"x": {"dtype": "float"}}, {"not_nullable"}),
        (
            [(150,), (0,), (120,)],
            "age int",
            {"age": {"dtype": "int", "checks": [{"in_range": {"min": 0, "max": 120}}]}},
            {"in_range(0, 120)"},
        ),
        (
            [("pending",)],
            "s string",
            {"s": {"dtype": "str", "checks": [{"isin": ["open", "closed"]}]}},
            {"isin(['open', 'closed'])"},
        ),
        (
            [("ab1",), ("xab",)],
            "s string",
            {"s": {"dtype": "str", "checks": [{"regex": "ab|cd"}]}},
            {"str_matches('ab|cd')"},
        ),
        ([("2024-01-05",), ("5 jan 2024",)], "d string", {"d": {"dtype": "datetime"}}, set()),
        ([("soon",)], "d string", {"d": {"dtype": "datetime"}}, {"dtype(datetime)"}),
        ([("maybe",)], "b string", {"b": {"dtype": "bool"}}, {"dtype(bool)"}),
    ],
)
def test_rules(spark, rows, schema, columns, failed):
    df = spark.createDataFrame(rows, schema)
    report = validation_report(df, spec(**columns)).collect()
    assert {r.check for r in report if r.n_failed} == failed
    assert {r.check for r in failure_cases(df, spec(**columns)).collect()} == failed
    if failed:
        with pytest.raises(ValidationError, match="^Schema validation failed: "):
            assert_valid(df, spec(**columns))


def test_message_lists_three_failures(spark):
    df = spark.createDataFrame([(i, 200 + i) for i in range(9)], "i int, age int")
    rule = {"dtype": "int", "checks": [{"in_range": {"min": 0, "max": 120}}]}
    with pytest.raises(ValidationError) as caught:
        assert_valid(df, spec(age=rule), order_key="i")
    assert str(caught.value) == (
        "Schema validation failed: age: in_range(0, 120) (200); age: in_range(0, 120) (201);"
        " age: in_range(0, 120) (202)"
    )
    assert failure_cases(df, spec(age=rule)).count() == 9


@pytest.mark.parametrize(
    "bad",
    [
        [], {"columns": {}, "unknown": True}, {"columns": {"a": {"dtype": "integer"}}},
        {"columns": {"a": {"dtype": "int", "extra": 1}}}, {"columns": {"a": {}}}, {},
        {"columns": {"a": {"dtype": "str", "checks": [{}]}}},
        {"columns": {"a": {"dtype": "str", "checks": [{"regex": "x", "isin": []}]}}},
        {"columns": {"a": {"dtype": "int", "checks": [{"regex": "x"}]}}},
        {"columns": {"a": {"dtype": "str", "checks": [{"in_range": {"min": 0, "max": 1}}]}}},
        {"columns": {"a": {"dtype": "int", "checks": [{"in_range": {"min": 0}}]}}},
        {"columns": {"a": 1}},
    ],
)
def test_bad_specs(bad):
    with pytest.raises(ValidationError):
        SchemaSpec.from_dict(bad)


def test_spec_files(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "schema.yml"
    path.write_text("columns:\n  age:\n    dtype: int\n    checks:\n      - isin: [1, 2]\n")
    assert load_spec(str(path)).columns["age"].checks[0].isin == [1, 2]
    path.write_text(":\n  - bad")
    with pytest.raises(ValidationError, match="not valid YAML"):
        load_spec(str(path))
    path.write_text("- a\n- b")
    with pytest.raises(ValidationError, match="top-level mapping"):
        load_spec(str(path))


# -------------------------------------------------------------------- suggestions


def entry(**fields):
    return {"category": "quality", "severity": "info", "message": "m", **fields}


ANSWERS = [
    json.dumps({"suggestions": [entry(category="Schema", severity="CRITICAL", column="id", evidence={"duplicates": 10})]}),
    '```json\n{"suggestions":[{"category":"quality","severity":"info","message":"trim spaces","column":null}]}\n    ```',
    "{not valid json",
    json.dumps([entry(message=f"m{i}") for i in range(20)]),
    json.dumps([1] * 11 + [entry(message="twelfth"), entry(message="thirteenth")]),
    json.dumps([entry(message="  "), {"severity": "odd"}, entry(category="odd", severity="odd", column=" ", evidence=[1])]),
    json.dumps({"suggestions": "none"}),
    json.dumps({"other": []}),
    "",
    None,
    "```\n[]\n```",
    json.dumps([{"message": None}, {"message": 5}]),
]


def test_suggestions(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, answer string")
    rows = {}
    for r in parse_suggestions(df, "answer", ["i"]).orderBy("i", "position").collect():
        rows.setdefault(r.i, []).append(r)
    first = rows[0][0]
    assert (first.category, first.severity, first.message, first.column) == ("schema", "critical", "m", "id")
    assert json.loads(first.evidence) == {"duplicates": 10}
    assert rows[1][0].message == "trim spaces" and rows[1][0].column is None
    assert [r.message for r in rows[3]] == [f"m{i}" for i in range(12)]
    assert [r.message for r in rows[4]] == ["twelfth"]
    odd = rows[5]
    assert len(odd) == 1
    assert (odd[0].category, odd[0].severity, odd[0].column, odd[0].evidence) == ("quality", "info", None, None)
    assert [r.message for r in rows[11]] == ["None", "5"]
    assert set(rows) == {0, 1, 3, 4, 5, 11}


def test_suggestion_counts(spark):
    answer = json.dumps([entry(), entry(category="schema"), entry()])
    df = spark.createDataFrame([(0, answer)], "i int, answer string")
    counts = suggestions_by_category(parse_suggestions(df, "answer", ["i"]))
    assert {r.category: r.suggestions for r in counts.collect()} == {"quality": 2, "schema": 1}


# -------------------------------------------------------------------- run history


def test_rollups(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (start + dt.timedelta(minutes=7 * i), "ok" if i % 3 else "bad", float(i), "ab"[i % 2])
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, status string, ms double, kind string")
    frame = pd.DataFrame(rows, columns=["ts", "status", "ms", "kind"])
    frame["hour"] = frame.ts.dt.floor("h")
    ok = F.col("status") == "ok"

    got = {(r.window_start, r.status): r for r in history.run_counts(df, "ts", "status").collect()}
    for key, n in frame.groupby(["hour", "status"]).size().items():
        assert got[key].runs == n and got[key].runs_per_second == pytest.approx(n / 3600)
    got = {r.window_start: r for r in history.latency(df, "ts", "ms").collect()}
    for hour, ms in frame.groupby("hour").ms:
        assert got[hour].avg_duration == pytest.approx(ms.mean())
        assert got[hour].p95_duration == pytest.approx(np.quantile(ms, 0.95))
    got = {r.window_start: r.total_ms for r in history.sums(df, "ts", ["ms"]).collect()}
    assert got == frame.groupby("hour").ms.sum().to_dict()
    assert history.totals(df, ["ms"]).first().total_ms == frame.ms.sum()
    got = {(r.window_start, r.category): r.total_ms for r in history.by_category(df, "ts", "kind", "ms", ok).collect()}
    assert got == frame[frame.status == "ok"].groupby(["hour", "kind"]).ms.sum().to_dict()
    got = {r.window_start: r.success_pct for r in history.success_rate(df, "ts", ok).collect()}
    for hour, group in frame.groupby("hour"):
        assert got[hour] == pytest.approx((group.status == "ok").mean() * 100)
