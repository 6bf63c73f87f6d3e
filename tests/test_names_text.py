import unicodedata
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washline.functions import text
from washline.functions.names import normalize_name, unique_names
from washline.operators.columns import (
    clean_text_columns,
    columns_with_non_ascii,
    decollide_column_names,
    normalize_categorical_text,
    normalize_column_names,
    preview_rows,
    sample_rows,
)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (" A ", "a"), (2, "2"), ("b b", "b_b"), ("###", ""), ("naïve", "na_ve"),
        ("__x--y__", "x_y"), (None, ""), ("Total  Price ($)", "total_price"),
    ],
)
def test_normalize_name(raw, expected):
    assert normalize_name(raw) == expected


def test_unique_names():
    assert unique_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert unique_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    assert unique_names(["a", "a"], joiner=".") == ["a", "a.1"]
    assert unique_names(["A", "a"], fold=str.lower) == ["A", "a_1"]


@given(st.lists(st.sampled_from(["a", "a_1", "b", "a_1_1", ""]), max_size=12))
def test_unique_names_are_unique_and_keep_first_uses(names):
    result = unique_names(names)
    assert len(set(result)) == len(result) == len(names)
    for i, name in enumerate(names):
        if name not in names[:i] and name not in result[:i]:
            assert result[i] == name


def test_normalize_column_names(spark):
    one = spark.range(1)
    df = one.select(*(F.lit(i) for i in range(6))).toDF(" A ", "2", "b b", "a", "A", "###")
    assert normalize_column_names(df).columns == ["a", "2", "b_b", "a_1", "a_2", ""]
    assert decollide_column_names(df).columns == [" A ", "2", "b b", "a", "A_1", "###"]


CELLS = [
    "  Foo\t\n Bar ", "nan", " null ", "NULL", "null", "none", "Ａ１", "ﬁ", " x　y\x1f",
    "", None, "é ½", "ΑΣ", "İstanbul", "a  b", "plain text",
]


def _expected(cell):
    if cell in (None, "nan", "none", "null"):
        return None
    return unicodedata.normalize("NFKC", " ".join(cell.split())).lower()


def test_clean_text_matches_python(spark, values):
    df = spark.createDataFrame(list(enumerate(CELLS)), "i int, v string")
    assert values(clean_text_columns(df), "v", "i") == [_expected(c) for c in CELLS]


def test_clean_text_options(spark, values):
    df = spark.createDataFrame([(0, " null "), (1, " Ab ")], "i int, v string")
    assert values(clean_text_columns(df, tokens_after_strip=True), "v", "i") == [None, "ab"]
    assert values(clean_text_columns(df, lowercase=False), "v", "i") == ["null", "Ab"]


def test_strip_keeps_inner_space(spark, values):
    df = spark.createDataFrame([("  a  b\x85",)], "v string")
    assert values(df.select(text.strip(F.col("v")).alias("v")), "v") == ["a  b"]


def test_only_non_ascii_columns_use_python(spark):
    df = spark.createDataFrame([("a", "é")], "x string, y string")
    found = columns_with_non_ascii(df, ["x", "y"])
    assert found == ["y"]
    plan = clean_text_columns(df, unicode=found)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
    plan = clean_text_columns(df, unicode=())._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_nfkc_holds_few_cells_as_text(spark):
    """A batch of 60 MB, four bytes a character as Python text, stays bytes but for a piece at a time."""
    psutil = pytest.importorskip("psutil")

    def workers():
        return [Path(f"/proc/{p.pid}") for p in psutil.Process().children(recursive=True) if "python" in p.name()]

    for p in workers():
        (p / "clear_refs").write_text("5")  # peaks begin anew
    long = F.concat(F.repeat(F.lit("word "), 2000), F.lit("\ufb01\U0001f600"), F.col("id").cast("string"))
    df = spark.range(6000, numPartitions=1).select(long.alias("v"), F.lit("\uff21").alias("w"), F.lit(None).cast("string").alias("x"))
    done = clean_text_columns(df).select(F.count_if(F.col("v").contains("word fi\U0001f600") & (F.col("w") == "a") & F.col("x").isNull()))
    assert done.first()[0] == 6000
    peaks = [int((p / "status").read_text().split("VmHWM:")[1].split()[0]) // 1024 for p in workers()]
    assert peaks and max(peaks) < 450


@pytest.mark.parametrize("inline_limit", [0, 200])
def test_categorical_mapping(spark, values, inline_limit):
    df = spark.createDataFrame(
        [(0, "o"), (1, "f"), (2, "p"), (3, None), (4, "gone")], "i int, status string"
    )
    mapping = {"status": {"o": "open", "f": "filled", "gone": None}, "absent": {"a": "b"}}
    mapped = normalize_categorical_text(df, mapping, inline_limit=inline_limit)
    assert values(mapped, "status", "i") == ["open", "filled", "p", None, None]
    assert mapped.columns == df.columns


def test_mapping_runs_after_lower_case(spark, values):
    df = spark.createDataFrame([(0, "O")], "i int, s string")
    assert values(clean_text_columns(df, categorical_mapping={"s": {"o": "x"}}), "s") == ["x"]
    assert values(clean_text_columns(df, categorical_mapping={"s": {"O": "x"}}), "s") == ["o"]


def test_short_views(spark):
    df = spark.range(100).select(
        "id", F.repeat(F.lit("x"), 300).alias("t"), F.lit(float("nan")).alias("n")
    )
    preview = preview_rows(df, "id").collect()
    assert [r.id for r in preview] == ["0", "1"] and {len(r.t) for r in preview} == {80}
    sample = sample_rows(df, "id").collect()
    assert len(sample) == 50 and {len(r.t) for r in sample} == {200}
    assert {r.n for r in sample} == {None}
