import pytest
from pyspark.sql import functions as F

from washline.errors import ValidationError
from washline.functions.names import quoted
from washline.operators import missing
from washline.operators.frequent import CANDIDATES, sketched_modes
from washline.operators.listed import MAX_LITERALS, listed_values
from washline.operators.statistics import modes
from washline.operators.validate import failure_cases, validation_report

LONG = list(range(0, 4 * MAX_LITERALS, 2))


def spec(column, dtype, allowed):
    return {"columns": {column: {"dtype": dtype, "nullable": True, "checks": [{"isin": allowed}]}}}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_both_joins_count_rows_that_are_not_listed(spark, limit):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 2, None, 4, 9_999]], "a bigint")
    listed = listed_values(spark, LONG, "bigint", limit)
    assert listed.small is (limit > 0)
    assert listed.count_unlisted(df, F.col("a")) == 4


def test_long_lists_and_tables_give_what_short_lists_give(spark):
    rows = [("x",), ("y",), (None,), ("1",), ("z",), ("z",), ("",)]
    df = spark.createDataFrame(rows, "listed string")
    short = ["x", 1, None, "w"]
    table = spark.createDataFrame([("x",), ("1",), (None,), ("w",), ("x",)], "any string")
    expected = sorted(r.failure_case for r in failure_cases(df, spec("listed", "str", short)).collect())
    assert expected == ["", "y", "z", "z"]
    for allowed in (table, [*short, *(f"q{i}" for i in range(MAX_LITERALS))]):
        found = failure_cases(df, spec("listed", "str", allowed))
        assert sorted(r.failure_case for r in found.collect()) == expected
        assert [r.n_failed for r in validation_report(df, spec("listed", "str", allowed)).collect()] == [0, 4]


def test_cases_of_long_lists_come_in_order(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a"), (4, "x")], "k bigint, v string")
    table = spark.createDataFrame([("x",)], "v string")
    found = failure_cases(df, spec("v", "str", table), limit=2, order_key="k").collect()
    assert [(r.check, r.failure_case) for r in found] == [("isin(table v)", "c"), ("isin(table v)", "a")]


def test_empty_tables_and_lists(spark):
    df = spark.createDataFrame([(1,), (None,)], "v bigint")
    nothing = spark.createDataFrame([], "v bigint")
    assert [r.n_failed for r in validation_report(df, spec("v", "int", nothing)).collect()] == [0, 1]
    assert [r.n_failed for r in validation_report(nothing, spec("v", "int", LONG)).collect()] == [0, 0]


def test_a_table_of_values_has_one_column(spark):
    with pytest.raises(ValidationError, match="one column"):
        listed_values(spark, spark.createDataFrame([(1, 2)], "a int, b int"), "bigint")


def test_a_long_list_is_no_part_of_the_plan(spark):
    df = spark.createDataFrame([(1,)], "v bigint")
    cases = failure_cases(df, spec("v", "int", [777_000_000 + i for i in LONG]))
    assert "777000" not in cases._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", ["id % 7", "id", "pow(id, 0.5) cast int", "if(id % 3 = 0, 5, id)", "if(id < 3, 1, id)"])
def test_sketched_modes_are_modes(spark, rows):
    value = {"pow(id, 0.5) cast int": "cast(pow(id, 0.5) as int)"}.get(rows, rows)
    df = spark.range(20_000, numPartitions=7).selectExpr(f"cast({value} as bigint) as n").withColumn(
        "s", F.concat(F.lit("v"), F.col("n"))
    )
    for c in ("n", "s"):
        assert sketched_modes(df, {c: quoted(c)}) == modes(df, [c])


def test_sketched_modes_of_ties_missing_and_long_texts(spark):
    rows = [("b", None, "w" * 200_000), ("a", None, "w" * 200_000), ("a", None, "x"), ("b", None, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, u string, v string")
    columns = {c: quoted(c) for c in df.columns}
    assert sketched_modes(df, columns) == {"t": "a", "v": "w" * 200_000}
    assert sketched_modes(df.limit(0), columns) == {}
    assert missing.fit_texts(df, df.columns, sketch=True) == missing.fit_texts(df, df.columns)


def test_more_equally_frequent_values_than_candidates(spark):
    df = spark.range(20 * CANDIDATES, numPartitions=5).selectExpr(f"cast(id % {10 * CANDIDATES} as string) as s")
    assert sketched_modes(df, {"s": quoted("s")}) == {"s": "0"}


def test_doubles_are_counted_in_full(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert sketched_modes(df, {"x": quoted("x")}) == {"x": 0.0}
