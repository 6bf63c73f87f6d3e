import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline.errors import InvalidInputError
from washline.operators import missing, outliers
from washline.operators.missing import Fill, fill_missing_values, forward_fill, missing_summary
from washline.operators.outliers import Bounds, capped_type, handle_outliers, outlier_report


def pandas_bounds(series, auto=True):
    series = series.dropna()
    if series.nunique() < 2:
        return None
    if not auto or abs(series.skew()) > 0.5:
        q1, q3 = series.quantile([0.25, 0.75])
        return None if q1 == q3 else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return series.mean() - 3 * series.std(), series.mean() + 3 * series.std()


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        spike = 40.0 if i % 50 == 0 else 1.0
        rows.append(
            (
                i,
                rng.gauss(0, 1) * (30 if i % 80 == 0 else 1),
                None if i % 7 == 0 else rng.expovariate(1) * spike,
                rng.randrange(10) * (100 if i % 50 == 0 else 1),
                float("nan") if i % 3 == 0 else 2.0,
            )
        )
    columns = ["i", "a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "i int, a double, b double, c int, d double")
    return df, pd.DataFrame(rows, columns=columns)


@pytest.mark.parametrize("auto", [True, False])
def test_cap_matches_a_loop_over_columns(noisy, auto):
    df, frame = noisy
    expected = frame.astype("float64").copy()
    for c in expected.columns:
        bounds = pandas_bounds(expected[c], auto)
        if bounds:
            expected[c] = expected[c].clip(*bounds)
    got = handle_outliers(df, "cap", auto).toPandas().sort_values("i").reset_index(drop=True)
    pd.testing.assert_frame_equal(got.astype("float64"), expected, rtol=1e-9)


@pytest.mark.parametrize("auto", [True, False])
def test_remove_goes_column_by_column(noisy, auto):
    df, frame = noisy
    expected = frame.copy()
    for c in expected.columns:
        bounds = pandas_bounds(expected[c], auto)
        if bounds:
            low, high = bounds
            expected = expected[~((expected[c] < low) | (expected[c] > high))]
    got = handle_outliers(df, "remove", auto)
    assert sorted(r.i for r in got.collect()) == sorted(expected["i"])
    assert got.where("b is null").count() > 0  # rows with a missing value stay


def test_spike(spark, values):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "x int")
    assert values(handle_outliers(df, "cap", False), "x", "x") == [1, 2, 3, 4, 7]
    assert values(handle_outliers(df, "remove", False), "x", "x") == [1, 2, 3, 4]
    assert values(handle_outliers(df, None), "x", "x") == [1, 2, 3, 4, 100]
    with pytest.raises(InvalidInputError):
        handle_outliers(df, "bogus")


def test_whole_numbers_stay_whole_if_the_bounds_are():
    from pyspark.sql.types import DoubleType, IntegerType

    assert capped_type(IntegerType(), Bounds(-1.0, 7.0, "IQR")) == IntegerType()
    assert capped_type(IntegerType(), Bounds(-1.5, 7.0, "IQR")) == DoubleType()


def test_guards(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, 1.0), (1.0, 6.0, 1.0, None), (1.0, None, None, None)],
        "constant double, two double, one double, single double",
    )
    report = {r.column: r for r in outlier_report(df).collect()}
    assert report["constant"].method is None and report["one"].low is None
    assert report["two"].method == "Z-score" and report["two"].skew is None
    assert all(r.outliers == 0 for r in report.values())
    assert handle_outliers(df).count() == 3


def test_capping_does_not_turn_missing_into_a_bound(spark, values):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)] + [(98, 1e6), (99, None)], "i int, x double")
    assert values(handle_outliers(df), "x", "i")[-1] is None


# ----------------------------------------------------------------- missing values

D = dt.datetime


def test_every_type(spark, values):
    rows = [
        (0, 1, 1.0, True, "b", D(2024, 1, 1), dt.date(2024, 1, 1), [1]),
        (1, 2, None, True, "a", D(2024, 1, 3), dt.date(2024, 1, 4), None),
        (2, None, 4.0, False, None, None, None, None),
        (3, 6, float("nan"), None, "b", D(2024, 1, 4), dt.date(2024, 1, 9), [2]),
        (4, 100, 100.0, False, "a", D(2024, 1, 9), None, [3]),
    ]
    df = spark.createDataFrame(
        rows, "i int, n int, x double, f boolean, s string, t timestamp_ntz, d date, l array<int>"
    )
    out = fill_missing_values(df)
    assert values(out, "n", "i")[2] == 4.0  # skewed: median of 1, 2, 6, 100
    assert values(out, "x", "i")[1] == 4.0 and values(out, "x", "i")[3] == 4.0
    assert values(out, "f", "i")[3] is False  # a tie
    assert values(out, "s", "i")[2] == "a"  # a tie: the smaller text
    assert values(out, "t", "i")[2] == D(2024, 1, 3, 12)  # mean of the middle two
    assert values(out, "d", "i")[2] == dt.date(2024, 1, 4)
    assert values(out, "l", "i")[1] is None  # nested columns are left alone
    assert dict(out.dtypes)["n"] == "double" and dict(out.dtypes)["i"] == "int"


def test_strategies(spark, values):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 9.0), (3, 100.0), (4, None)], "i int, x double")
    assert values(fill_missing_values(df, numeric_strategy="mean"), "x", "i")[4] == 28.0
    assert values(fill_missing_values(df, numeric_strategy="median"), "x", "i")[4] == 5.5
    assert values(fill_missing_values(df), "x", "i")[4] == 5.5


def test_empty_columns(spark):
    df = spark.sql(
        "select cast(null as int) n, cast(null as double) x, cast(null as boolean) f,"
        " cast(null as string) s, cast(null as timestamp) t, null v"
    )
    row = fill_missing_values(df).first()
    assert (row.n, row.x, row.f, row.s, row.v) == (0, 0, False, "Unknown", "Unknown")
    assert row.t == D(1970, 1, 1)


def test_regular_spacing_fills_forward(spark, values):
    times = [None if i in (0, 7, 8, 20) else D(2024, 1, 1) + dt.timedelta(hours=i) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz").repartition(7)
    out = fill_missing_values(df, datetime_strategy="auto", order_key="i")
    expected = pd.Series(times).ffill().tolist()
    assert values(out, "t", "i") == [None if x is pd.NaT else x.to_pydatetime() for x in expected]
    with pytest.raises(ValueError, match="order_key"):
        fill_missing_values(df, datetime_strategy="auto")


def test_many_repeats_fill_the_mode(spark, values):
    times = [D(2024, 1, 1 + i % 3) for i in range(20)] + [D(2024, 5, 5), None]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz")
    out = fill_missing_values(df, datetime_strategy="auto")
    assert values(out, "t", "i")[-1] == D(2024, 1, 1)


def test_irregular_times_fill_the_median(spark, values):
    times = [D(2024, 1, 1), D(2024, 1, 2), D(2024, 6, 1), D(2025, 1, 1), D(2025, 1, 2), None]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz")
    assert values(fill_missing_values(df, datetime_strategy="auto"), "t", "i")[-1] == D(2024, 6, 1)
    two = df.where("i < 2 or i = 5")
    assert values(fill_missing_values(two, datetime_strategy="auto"), "t", "i")[-1] == D(2024, 1, 1, 12)


def test_spacing_matches_pandas(spark):
    rng = random.Random(1)
    for spread in (0.05, 0.15, 0.3, 2.0):
        base = [D(2024, 1, 1) + dt.timedelta(hours=i + rng.uniform(0, spread)) for i in range(200)]
        base += base[:10]
        df = spark.createDataFrame([(t,) for t in base], "t timestamp_ntz")
        from washline.functions.columns import as_micros

        micros = as_micros(F.col("t"), df.schema["t"].dataType).alias("micros")
        counted = df.select(micros).groupBy("micros").agg(F.count(F.lit(1)).alias("copies"))
        n, different, got = missing._distinct_moments(counted)
        gaps = pd.Series(sorted(base)).diff().dropna().dt.total_seconds()
        assert (n, different) == (210, 200)
        assert got == pytest.approx(gaps.std() / gaps.mean(), rel=1e-6)


def test_forward_fill_of_several_columns_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.choice([None, None, f"a{i}"]), None if 20 < i < 160 else i) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "k int, s string, n int").repartition(5)
    got = forward_fill(df, ["s", "n"], "k").toPandas().sort_values("k")
    expected = pd.DataFrame(rows, columns=["k", "s", "n"]).ffill()
    assert got["s"].tolist() == expected["s"].tolist()
    assert got["n"].tolist() == expected["n"].tolist()


def test_timestamps_with_zone_keep_their_type(spark, values):
    df = spark.createDataFrame([(0, D(2024, 1, 1)), (1, D(2024, 1, 3)), (2, None)], "i int, t timestamp")
    out = fill_missing_values(df)
    assert values(out, "t", "i")[2] == D(2024, 1, 2) and dict(out.dtypes)["t"] == "timestamp"


def test_summary(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    assert tuple(missing_summary(df, fill_missing_values(df)).first()) == (2, 0, 2)
    assert {r.column: r.missing for r in missing.missing_counts(df).collect()} == {"a": 1, "b": 1}


def test_nothing_missing_changes_nothing(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert fill_missing_values(df).schema == df.schema


def test_fill_is_plain_data():
    assert Fill("number", 1.5) == Fill(**{"kind": "number", "value": 1.5})
    assert outliers.METHODS == ("cap", "remove", None)
