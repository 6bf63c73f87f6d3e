import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import washline
from washline import CleaningConfig, CleaningModel, clean_data, fit, run_cleaning, staging
from washline.errors import InvalidInputError, ValidationError
from washline.plans.cleaning import STEPS, dataset_kind, readable_duration, summary_frame
from washline.streaming.streams import clean_stream, read_stream, write_stream


@pytest.fixture
def small(spark):
    rows = [
        ("Alice", 25.0, "New York", 100.50),
        ("Bob", None, "Los Angeles", 200.75),
        ("Charlie", 30.0, "San Francisco", 300.0),
        ("Alice", 25.0, "New York", 100.50),
        ("David", 35.0, "Chicago", 150.25),
    ]
    return spark.createDataFrame(rows, "name string, age double, city string, price double")


GOLDEN = [
    ("alice", 25.0, "new york", 100.50),
    ("bob", 30.0, "los angeles", 200.75),
    ("charlie", 30.0, "san francisco", 300.0),
    ("david", 35.0, "chicago", 150.25),
]


def test_golden(small):
    table, summary = clean_data(small)
    assert sorted(tuple(r) for r in table.collect()) == GOLDEN
    summary.pop("duration")
    assert summary == {
        "rows": 4, "columns": 4, "duplicates_removed": 1, "outliers_handled": 0,
        "missing_filled": 1, "columns_standardized": 2, "text_unconverted": 2,
    }


def test_summary_as_table(small, spark):
    _, summary = clean_data(small)
    row = summary_frame(spark, summary).first()
    assert row.rows == 4 and row.duration.endswith("s")


def test_step_log(small, spark):
    run = run_cleaning(small, CleaningConfig(outliers=None, clean_text=False, normalize_cols=False))
    log = {r.step: r for r in run.log.as_frame(spark).collect()}
    assert list(log) == list(STEPS)
    assert (log["remove_duplicates"].rows_before, log["remove_duplicates"].rows_after) == (5, 4)
    assert [s for s in STEPS if log[s].status == "skipped"] == [
        "normalize_columns", "clean_text", "handle_outliers",
    ]
    assert run.summary["text_unconverted"] == 0


def test_timing_is_opt_in(small):
    assert "profiling" not in clean_data(small)[1]
    timing = clean_data(small, profile=True, outliers=None)[1]["profiling"]
    assert set(timing["steps"]) == set(STEPS)
    assert timing["total_ms"] > 0 and timing["steps"]["handle_outliers"] == 0.0


@pytest.mark.parametrize(("method", "rows", "handled"), [("cap", 5, 0), ("remove", 4, 1), (None, 5, 0)])
def test_outlier_methods(spark, method, rows, handled):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "x int")
    table, summary = clean_data(
        df, outliers=method, normalize_cols=False, clean_text=False, auto_outlier_detect=False
    )
    assert table.count() == summary["rows"] == rows and summary["outliers_handled"] == handled
    if method == "cap":
        assert table.agg(F.max("x")).first()[0] == 7.0


def test_bad_input(spark, small):
    with pytest.raises(InvalidInputError, match="unknown outlier method"):
        clean_data(small, outliers="bogus")
    with pytest.raises(InvalidInputError, match="empty"):
        clean_data(small.limit(0))
    with pytest.raises(InvalidInputError, match="empty"):
        clean_data(spark.range(3).select())
    with pytest.raises(InvalidInputError, match="empty"):
        clean_data(None)
    with pytest.raises(ValidationError):
        clean_data(small, categorical_mapping={"city": "x"})


def test_config():
    config = CleaningConfig()
    assert (config.outliers, config.normalize_cols, config.clean_text) == ("cap", True, True)
    assert config.categorical_mapping is None and config.auto_outlier_detect
    assert not config.verbose and not config.profile
    with pytest.raises(ValidationError):
        CleaningConfig(outliers="x").validate()
    with pytest.raises(ValidationError):
        CleaningConfig(categorical_mapping=[1]).validate()
    CleaningConfig(outliers=None, categorical_mapping={"a": {"b": "c"}}).validate()


def test_results_are_judged_by_errors():
    result = washline.CleaningResult(rows=3)
    result.add_warning("w")
    assert result.success and result.to_dict()["warnings"] == ["w"]
    result.add_error("e")
    assert result.failed and not washline.ValidationResult(errors=["e"]).success


def test_helpers():
    assert [dataset_kind(x) for x in (None, "a.CSV", "b.xlsx", "c.parquet", "d")] == [
        None, "csv", "excel", "parquet", "unknown",
    ]
    assert readable_duration(4.2) == "4.20s" and readable_duration(125) == "2m 5s"
    assert readable_duration(3725) == "1h 2m 5s"


@pytest.fixture
def untidy(spark):
    rows = []
    for i in range(120):
        rows.append(
            (
                i,
                None if i % 10 == 0 else f"${i * 10},000.00" if i != 50 else "$99,999,999",
                f"{i % 12 + 1}/{i % 28 + 1}/2024",
                None if i % 6 == 0 else "  Blue " if i % 2 else "RED",
                "é" if i % 40 == 0 else "Ａ",
                None if i % 5 == 0 else i % 3 == 0,
                None if i % 8 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i),
                [i],
            )
        )
    schema = (
        "`Row ID` int, `Unit-Price` string, `due ` string, `COLOUR` string, colour string,"
        " flag boolean, seen timestamp_ntz, tags array<int>"
    )
    df = spark.createDataFrame(rows, schema)
    return df.unionAll(df.where("`Row ID` < 20"))


def test_everything_together(untidy):
    run = run_cleaning(untidy, CleaningConfig(categorical_mapping={"colour": {"red": "crimson"}}))
    table = run.table
    assert dict(table.dtypes) == {
        "row_id": "int", "unit_price": "double", "due": "timestamp_ntz", "colour": "string",
        "colour_1": "string", "flag": "boolean", "seen": "timestamp_ntz", "tags": "array<int>",
    }
    assert run.summary["rows"] == table.count() == 120
    assert run.summary["duplicates_removed"] == 20
    assert run.summary["columns_standardized"] == 5
    for c in table.columns:
        assert table.where(F.col(c).isNull()).count() == 0, c
    assert {r.colour for r in table.select("colour").distinct().collect()} == {"blue", "crimson"}
    assert {r.colour_1 for r in table.select("colour_1").distinct().collect()} == {"é", "a"}
    assert table.agg(F.max("unit_price")).first()[0] < 99_999_999
    assert run.summary["missing_filled"] == 12 + 20 + 24 + 15


def test_model_repeats_the_cleaning(untidy):
    run = run_cleaning(untidy)
    again = run.model.transform(untidy, deduplicate=True)
    assert again.exceptAll(run.table).count() == run.table.exceptAll(again).count() == 0
    restored = CleaningModel.from_json(run.model.to_json())
    assert restored.to_json() == run.model.to_json()
    once = restored.transform(untidy)
    assert once.count() == untidy.count() and once.schema == run.table.schema
    with pytest.raises(ValueError, match="expected the columns"):
        restored.transform(untidy.drop("flag"))


def test_removal_changes_what_is_filled(spark):
    rows = [(i, float(i % 10), "a" if i % 3 else None) for i in range(60)]
    rows += [(100 + i, 1e6, "zz") for i in range(3)]
    df = spark.createDataFrame(rows, "i int, x double, s string")
    table, summary = clean_data(df, outliers="remove")
    assert summary["outliers_handled"] == 3 and summary["rows"] == 60
    assert {r.s for r in table.select("s").distinct().collect()} == {"a"}
    assert summary["missing_filled"] == 20


def test_names_without_normalisation(spark):
    df = spark.range(3).select("id", F.lit(1), F.lit(2), F.lit(3)).toDF("a.b", "A.B", "`x`", "")
    table, _ = clean_data(df, normalize_cols=False)
    assert table.columns == ["a.b", "A.B_1", "`x`", ""] and table.count() == 3


def test_stage_lives_in_the_checkpoint_folder_and_can_be_released(spark, small):
    root = staging.staging_root(spark)
    before = len(staging.staged_paths())
    with staging.stage_scope(spark):
        staged = staging.stage(small)
        path = staging.staged_paths()[-1].removeprefix("file:")
        assert staged.count() == 5 and path.startswith(root.removeprefix("file:"))
        assert os.path.isdir(path)
    assert not os.path.exists(path) and len(staging.staged_paths()) == before


def test_fit_leaves_nothing_staged(spark, untidy):
    before = staging.staged_paths()
    model = fit(untidy)
    assert staging.staged_paths() == before and model.targets == {"c1": "double", "c2": "timestamp_ntz"}


def test_stream(spark, untidy, tmp_path):
    untidy = untidy.toDF(*(n.strip() if i != 4 else "tone" for i, n in enumerate(untidy.columns)))
    untidy = untidy.withColumn("at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(`Row ID`)"))
    model = fit(untidy)
    arrivals, target = str(tmp_path / "in"), str(tmp_path / "out")
    untidy.repartition(3).write.parquet(arrivals)
    stream = clean_stream(
        read_stream(spark, arrivals, untidy.schema), model, event_time="at", delay="400 days",
        subset=["Row ID"],
    )
    write_stream(stream, target, str(tmp_path / "c"), once=True).awaitTermination()
    got = spark.read.parquet(target)
    assert got.schema.names == list(model.output_names)
    assert got.count() == 120


def test_quantile_accuracy_is_passed_on(untidy):
    exact = run_cleaning(untidy).model
    rough = run_cleaning(untidy, CleaningConfig(quantile_accuracy=10_000)).model
    assert exact.caps.keys() == rough.caps.keys()
