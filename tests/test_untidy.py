"""Untidy input: nothing is lost, rounded or passed by."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline import staging
from washline.errors import DataLoadError
from washline.functions.parsing import parse_datetime
from washline.operators import missing, outliers
from washline.operators.columns import normalize_categorical_text
from washline.operators.dedup import remove_duplicates
from washline.operators.formats import standardize_formats
from washline.operators.validate import validation_report
from washline.plans.cleaning import clean_data, fit, run_cleaning
from washline.session import cluster_settings
from washline.sources.files import read_data

SHAPES = [
    "2024-01-05 EST", "2024-01-05 x", "2024-01-01 error disk 0 full", "5 jan 2024 abc", "1/2/2024 abc", "2024-01-05 10:30 x",
    "2024-01-05" + " " * 60 + "10:30", "2024-01-05 ", "101112", "991231", "311299", "000112", "320112", "451301", "202401",
    "Fri Jan  5 10:30:00 2024", "Jan 5 10:30:00 2024", "1Q2024", "4q2023", "5Q2023", "2024-Q1", "2024", "2024-13-01",
    "13/01/2024", "jan 5, 2024 10pm", "2024-01-05  10:30 pm", "20240105103000", "5 oct 10pm", "2024-01-05T10:30:00+02:00",
]


def test_dates_are_read_like_the_pandas_library_reads_them(spark):
    df = spark.createDataFrame(list(enumerate(SHAPES)), "i int, c string")
    got = {r.i: r.v for r in df.select("i", parse_datetime("c").alias("v")).collect()}
    for i, text in enumerate(SHAPES):
        want = pd.to_datetime(pd.Series([text]), errors="coerce", format="mixed", utc=True)[0]
        assert got[i] == (None if want is pd.NaT else want.tz_localize(None).to_pydatetime()), text


def test_log_lines_stay_text(spark):
    df = spark.createDataFrame([(f"2024-01-{1 + i % 28:02d} error disk {i} full",) for i in range(40)], "line string")
    assert dict(standardize_formats(df).dtypes) == {"line": "string"}
    cleaned, summary = clean_data(df)
    assert cleaned.distinct().count() == 40 and summary["duplicates_removed"] == 0
    cleaned.release()


def test_ids_of_nineteen_digits(spark, tmp_path):
    path = str(tmp_path / "ids.csv")
    big = 1750000000000000000
    spark.createDataFrame([(big + 1, "a"), (big + 2, "a"), (big + 3, "b")], "id long, v string").coalesce(1).write.option(
        "header", True
    ).csv(path)
    cleaned, summary = clean_data(read_data(spark, path), outliers=None)
    assert sorted(r.id for r in cleaned.collect()) == [big + 1, big + 2, big + 3] and summary["duplicates_removed"] == 0


def test_whole_numbers_beyond_64_bits(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    rows = [(str(10**25 + i), str(10**40 + i)) for i in range(12)]
    spark.createDataFrame(rows, "a string, b string").coalesce(1).write.option("header", True).csv(path)
    df = read_data(spark, path)
    assert dict(df.dtypes) == {"a": "decimal(38,0)", "b": "string"}
    text = spark.createDataFrame(rows, "a string, b string")
    assert dict(standardize_formats(text).dtypes) == {"a": "decimal(38,0)", "b": "string"}


def test_files_with_columns_in_another_order_are_refused(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.createDataFrame([(1, 100)], "id int, amount int").write.option("header", True).csv(path)
    spark.createDataFrame([(200, 2)], "amount int, id int").write.mode("append").option("header", True).csv(path)
    with pytest.raises(DataLoadError, match="different headers"):
        read_data(spark, path)
    same = str(tmp_path / "s.csv")
    spark.range(10).repartition(3).write.option("header", True).csv(same)
    assert read_data(spark, same).count() == 10


def test_a_model_fitted_on_tidy_rows_serves_untidy_ones(spark):
    seen = spark.createDataFrame([(i, 10.0 + i % 7, "ab", i % 2 == 0) for i in range(50)], "k int, x double, t string, f boolean")
    new = spark.createDataFrame([(1, 1e9, "ﬁn Ａ", True), (2, None, None, None), (None, 12.0, " AB ", False)], seen.schema)
    model = fit(seen)
    rows = model.transform(new).collect()
    assert rows[0].t == "fin a" and rows[0].x < 30
    assert (rows[1].x, rows[1].t, rows[1].f) == (pytest.approx(12.9, abs=0.3), "ab", False)
    assert rows[2].k is not None and model.transform(new).dtypes == run_cleaning(seen).table.dtypes


def test_runs_side_by_side_keep_their_staged_tables(spark):
    df = spark.range(20)
    staged, gone = {}, threading.Event()
    inside = threading.Event()

    def other():
        with staging.stage_scope(spark):
            staged["other"] = staging.stage(df)
            inside.set()
            assert gone.wait(60)
            staged["rows"] = staged["other"].count()

    thread = threading.Thread(target=other)
    thread.start()
    with staging.stage_scope(spark):
        mine = staging.stage(df)
        assert inside.wait(60) and mine.count() == 20
    gone.set()
    thread.join(60)
    assert staged["rows"] == 20


def test_a_run_releases_what_it_staged(spark):
    run = run_cleaning(spark.range(5).withColumn("v", F.col("id") * 1.5))
    assert run.scope.paths() and run.table.count() == 5
    run.release()
    assert not run.scope.paths()


def test_decimals_stay_decimals(spark):
    rows = spark.sql("SELECT CAST(id AS decimal(38,2)) AS d FROM range(30) UNION ALL SELECT NULL UNION ALL SELECT CAST(99999 AS decimal(38,2))")
    assert missing.fill_missing_values(rows).dtypes == [("d", "decimal(38,2)")]
    capped = outliers.handle_outliers(rows, "cap")
    assert capped.dtypes == [("d", "decimal(38,2)")] and capped.agg(F.max("d")).first()[0] < 99999


@pytest.mark.parametrize("limit", [0, 200])
def test_codes_are_mapped(spark, limit):
    df = spark.createDataFrame([(1, True, 1.5), (2, False, 2.0), (None, None, None)], "i int, b boolean, x double")
    found = normalize_categorical_text(
        df, {"i": {2: 5, "q": 9}, "b": {True: "yes"}, "x": {2.0: None, 1.5: 3}}, inline_limit=limit
    )
    assert dict(found.dtypes) == {"i": "int", "b": "string", "x": "double"}
    assert {tuple(r) for r in found.collect()} == {(1, "yes", 3.0), (5, "false", None), (None, None, None)}


def test_listed_values_of_mixed_types(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    spec = {"columns": {"v": {"dtype": "int", "checks": [{"isin": [1, "x"]}]}}}
    failed = {r.check: r.n_failed for r in validation_report(df, spec).collect()}
    assert [n for check, n in failed.items() if check.startswith("isin")] == [1]


def test_cluster_settings_are_bounded():
    parts = {n: int(cluster_settings(n)["spark.sql.shuffle.partitions"]) for n in (1, 10**11, 10**13, 10**14, 10**16)}
    assert parts[1] == 200 and parts[10**11] == 373 and parts[10**13] == 4657 and parts[10**14] == 46567 and parts[10**16] == 50_000


def test_reports_tell_rows_apart_by_their_maps(spark):
    rows = [(1, 1, {"a": 1}), (1, 1, {"a": 2}), (1, 2, {"a": 1}), (2, 1, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "k int, o int, m map<string,int>")
    kept, removed = remove_duplicates(df, ["k"], order_key="o", return_report=True)
    assert kept.count() == 2 and removed.count() == 3
    everything = sorted(str(r) for part in (kept, removed) for r in part.collect())
    assert everything == sorted(str(r) for r in df.collect())


def test_variants_pass_through(spark):
    df = spark.sql("SELECT id % 2 AS k, parse_json('{\"a\": ' || (id % 2) || '}') AS v FROM range(6)")
    cleaned, summary = clean_data(df)
    assert summary["duplicates_removed"] == 4 and dict(cleaned.dtypes)["v"] == "variant"
    assert sorted(r.v.toJson() for r in cleaned.collect()) == ['{"a":0}', '{"a":1}']
    cleaned.release()
