import time
import warnings

import pandas as pd
import pytest

from pyspark.sql import functions as F

from washline.functions.parsing import parse_datetime, parse_number
from washline.operators import formats
from washline.operators.formats import TextStats, choose_target, standardize_formats

DATES = """2024-01-05|2024-1-5|2024-01-05 10:30|2024-01-05t10:30:05.123z|2024-01-05 10:30:05+02:00
2024-01-05 10:30:05-0530|2024-01|2024|20240105|202401|123456|20240105103000|20240105t103000
202401051030|2024/1/5|2024.1.5|1/5/2024|13/1/2024|01-05-2024|13-01-2024|1.5.2024|13.01.2024|1/5/24
13/1/24|jan 5, 2024|january 5, 2024|Jan 5 2024|5 jan 2024|5-jan-2024|5 JANUARY 2024|05jan2024
jan 2024|january 2024|2024 jan 5|2024-jan-05|5-jan-24|friday, january 5, 2024|1/5/2024 10:30
1/5/2024 10:30 pm|1/5/2024 10:30:05 am|jan 5, 2024 10:30 pm|5th january 2024|jan 5th, 2024
2024-13-01|2024-02-30|31/02/2024|12/31/9999|1704412800|1999.5|2024q1|q1 2024|2024-q3
2024-01-05 24:00|99|1677|1678|2262|2263|0001-01-01|nan|2024-W01|2024 01 05|01 05 2024|1 5 2024
2024-005|a1|may|12|2024-01-05 10pm|sep 5 2024|sept 5 2024|5. jan 2024|20240105 10:30|2024, jan 5
1/2024|13/2024|01-2024|2024/01|1.5.24|jan. 5, 2024|5000|25|100|12.5|2024-01-05 12:15 am
2024-01-05 13:15 pm|2024-01-05 25:00|1-5/2024|customer#000000001|may 5 2024 extra words"""


def test_datetimes_match_pandas(spark):
    cells = DATES.replace("\n", "|").split("|") + ["", None]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    ours = [r.t for r in df.select("*", parse_datetime("c").alias("t")).orderBy("i").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for cell, got in zip(cells, ours):
            wanted = pd.to_datetime(pd.Series([cell]), errors="coerce", format="mixed")[0]
            if wanted is not pd.NaT and wanted.tzinfo:
                wanted = wanted.tz_convert("UTC").tz_localize(None)
            wanted = None if wanted is pd.NaT else wanted.to_pydatetime()
            assert got == wanted, cell


def test_time_without_a_day_is_refused(spark, values):
    df = spark.createDataFrame([("10:30",), ("10pm",)], "c string")
    assert values(df.select("*", parse_datetime("c").alias("t")), "t") == [None, None]


def test_bare_digits_can_be_refused(spark, values):
    cells = ["2024", "20240105", "20240105103000", "2024-01"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    got = values(df.select("*", parse_datetime("c", bare_digits=False).alias("t")), "t", "i")
    assert [g is not None for g in got] == [False, False, False, True]


def test_results_do_not_depend_on_the_session_zone(spark, values):
    df = spark.createDataFrame([("2024-03-31 02:30:00+02:00",)], "c string")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = values(df.select("*", parse_datetime("c").alias("t")), "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert str(got[0]) == "2024-03-31 00:30:00"


NUMBERS = {
    "$1,234.50": 1234.5, "USD 5": 5, "usd 5": 5, "(12.5)": -12.5, "Rp100": 100, "1e5": 1e5,
    "1d": None, "5%": None, "5f": None, "1_000": None, "0x1F": None, "inf": float("inf"),
    "-Infinity": float("-inf"), "nan": None, "12.": 12, "+.5": 0.5, ".": None, "A$5": 5,
    "NZ$ 7": 7, "$(1,234.50)": -1234.5, "€5": 5, "5 €": 5, "5kr": 5, "1.234,56": 1.23456,
    "R$5": 5, "15R7": 157, "r101": None, "hello 5": None, "-5": -5, "--5": None, "5 USD": 5,
    "USDX 5": None, "12 zł": 12, "e5": None, "1 2 3": 123, "": None, "1e400": float("inf"),
    " 7 ": 7, "(5": None, "krkrkrkr9": 9,
}


def test_numbers(spark):
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, c string")
    got = {r.c: r.n for r in df.select("*", parse_number("c").alias("n")).collect()}
    assert got == NUMBERS


def test_code_case_can_matter(spark, values):
    df = spark.createDataFrame([(0, "usd 5"), (1, "USD 5")], "i int, c string")
    assert values(df.select("*", parse_number("c", ignore_code_case=False).alias("n")), "n", "i") == [None, 5]


@pytest.mark.parametrize(
    ("label", "stats", "target"),
    [
        ("x", TextStats(10, 10, 9, 0, 0, True), None),  # 0.9 is not above 0.9
        ("x", TextStats(100, 100, 91, 0, 0, True), "timestamp_ntz"),
        ("Created_At", TextStats(10, 10, 9, 0, 0, True), "timestamp_ntz"),
        ("candidate", TextStats(10, 10, 8, 0, 0, True), None),  # 0.8 is not above 0.8
        ("x", TextStats(10, 10, 0, 8, 8, True), None),
        ("x", TextStats(100, 100, 0, 81, 81, True), "double"),
        ("x", TextStats(10, 10, 0, 10, 10, True), "bigint"),
        ("x", TextStats(10, 9, 0, 9, 9, True), "double"),  # missing cells count as failures
        ("x", TextStats(10, 10, 0, 10, 0, False), None),  # nothing hints at numbers
        ("price", TextStats(10, 10, 0, 10, 0, False), "double"),
        ("x", TextStats(), None),
    ],
)
def test_gate(label, stats, target):
    assert choose_target(label, stats) == target


_PLAIN = [
    f"{a}{x}{b}{y}{c}{clock}"
    for a in ("1677", "1678", "1700", "1999", "2024", "2199", "2262", "2263", "9", "13", "31", "0", "00")
    for b in ("2", "02", "12", "13", "30")
    for c in ("1", "31", "29", "2024", "1900", "1677", "69", "68")
    for x, y in (("-", "-"), ("/", "/"), (".", "."), ("-", "/"))
    for clock in ("", " 10:30", " 1:02:03.5", " 24:00:00")
] + ["20240229", "20230229", "16770101", "22000101", "19991301", " 2024-01-05 ", "2024-1-5  10:30", "2024/01/05 10:61", "١٢/٣/2024"]


def test_plain_shapes_go_the_short_way_with_the_same_results(spark):
    df = spark.createDataFrame([(t,) for t in _PLAIN], "t string")
    for bare in (True, False):
        both = df.select("t", parse_datetime("t", bare_digits=bare).alias("a"), parse_datetime("t", bare_digits=bare, plain_shapes=False).alias("b"))
        assert [tuple(r) for r in both.where("NOT a <=> b").collect()] == []
        assert both.where("a IS NOT NULL").count() > 500


_TWO = [f"{i:02}" for i in range(100)]
_DIGITS = (
    [a + b for a in _TWO for b in _TWO]
    + [a + b + c for a in _TWO for b in _TWO for c in ("00", "01", "24", "31", "32", "68", "69", "99")]
    + [y + m + d
       for y in ("0001", "1599", "1600", "1676", "1677", "1678", "2023", "2024", "2199", "2261", "2262", "2263", "2300")
       for m in ("00", "01", "02", "04", "09", "10", "11", "12", "13", "20")
       for d in ("00", "01", "10", "11", "12", "21", "22", "28", "29", "30", "31", "32", "40")]
    + ["1" * n for n in range(1, 20)] + ["20240105" + "103059"[:n] for n in range(7)]
    + [f"{a}{x}{b}" for a in ("", "1", "12", "13", "202", "2024", "20240", "202401", "20240105") for x in (".", ",", ".,", "..", ",,")
       for b in ("", "1", "12", "13", "123", "2024", "20240")]
    + ["1,234.50", "1,234,567", "2024.1.5", "1.5.2024", "1.5,2024", "-5", "+2024", "-20240105", "2024-", "1e5", "", " ", ".", "?", "unknown",
       "may", "inf", "٢٠٢٤", "١٢.٢٠٢٤", "٢٠٢٤0105"]
)


@pytest.mark.parametrize("bare", [True, False])
def test_digits_and_words_go_the_short_way_with_the_same_results(spark, bare):
    cells = _DIGITS + [f" {t} " for t in _DIGITS[::7]] + [f"{t}{end}" for t in _DIGITS[::7] + _DIGITS[-400:] for end in ("\n", "\t", "t", "\r\n")]
    df = spark.createDataFrame([(t,) for t in cells], "t string")
    both = df.select("t", parse_datetime("t", bare_digits=bare).alias("a"), parse_datetime("t", bare_digits=bare, plain_shapes=False).alias("b"))
    assert [tuple(r) for r in both.where("NOT a <=> b").collect()] == []
    assert both.where("a IS NOT NULL").count() > (3000 if bare else 5)


def test_plain_numbers_are_read_as_those_with_a_comma(spark):
    """A comma at the end sends a number through all the replacements."""
    cells = ["0", "007", "-5", "+5", "12.", "12.50", "1" * 19, "9" * 25, "-0", "1.5.2", "5-", "12\n", " 7", "1e5", ".5", "", "-", "+."]
    df = spark.createDataFrame([(t, t + ",") for t in cells], "t string, u string")
    both = df.select("t", parse_number("t").alias("a"), parse_number("u").alias("b"))
    assert [tuple(r) for r in both.where("NOT a <=> b").collect()] == []


def test_numbers_do_not_go_through_the_date_rules(spark):
    df = spark.range(400_000, numPartitions=1).select(
        F.when(F.col("id") % 10 < 3, "unknown").otherwise((F.col("id") + 100_000.5).cast("string")).alias("t")
    )

    def seconds(**options):
        taken = []
        for _ in range(3):
            start = time.perf_counter()
            df.select(parse_datetime("t", **options)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return min(taken)

    assert seconds() < seconds(plain_shapes=False) / 2


@pytest.mark.parametrize(("estimate", "lookup_bytes"), [(0, 0), (1e9, 0), (1e9, 1_000_000)])
def test_standardize(spark, values, monkeypatch, estimate, lookup_bytes):
    """All routes agree: cell by cell, counted by value, and looked up by value."""
    monkeypatch.setattr(formats, "LOOKUP_BYTES", lookup_bytes)
    # Without room for lookups, values are still grouped if the estimate is far too low.
    monkeypatch.setattr(formats.TextSurvey, "value_bytes", property(lambda s: 0.0 if estimate else 1.0))
    rows = [
        (i, f"${i},000.50", "2024-01-%02d" % (i % 9 + 1) if i else "junk", str(i), f"id {i}", None)
        for i in range(20)
    ]
    df = spark.createDataFrame(
        rows, "i int, price string, day string, n string, word string, empty string"
    )
    out = standardize_formats(df)
    assert dict(out.dtypes) == {
        "i": "int", "price": "double", "day": "timestamp_ntz", "n": "bigint", "word": "string",
        "empty": "string",
    }
    assert values(out, "price", "i")[3] == 3000.5
    assert values(out, "day", "i")[0] is None
    assert formats.typed_column_count(out) == 4


def test_years_become_timestamps_like_any_date(spark):
    df = spark.createDataFrame([(str(1900 + i),) for i in range(30)], "y string")
    assert dict(standardize_formats(df).dtypes) == {"y": "timestamp_ntz"}
    assert dict(standardize_formats(df, bare_digits=False).dtypes) == {"y": "bigint"}


def test_filters_on_parsed_columns_stay_small(spark, values):
    """Spark pushes the filter below the parser: the plan must not grow with every step."""
    df = spark.createDataFrame([("5 jan 2024", "$5"), ("6/1/2024", "$7")], "d string, p string")
    out = df.select(parse_datetime("d").alias("d"), parse_number("p").alias("p"))
    kept = out.where("d > timestamp_ntz'2024-02-01' and p > 1").where("p < 10 or d is null")
    assert values(kept, "p") == [7.0]
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 200_000
