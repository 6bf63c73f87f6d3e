import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from washline.operators import dedup
from washline.operators.dedup import duplicate_counts, remove_duplicates


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def orders(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice(["a", "B ", None])) for i in range(60)]
    rows += rows[:5]  # rows repeated whole, order key included
    return spark.createDataFrame(rows, "k int, ord int, v string"), rows


def expected(rows, keep):
    best = {}
    for row in rows:
        key = row[0]
        if key not in best or (row[1] > best[key][1] if keep == "last" else row[1] < best[key][1]):
            best[key] = row
    if keep is False:
        counts = Counter(r[0] for r in rows)
        return Counter(r for r in rows if counts[r[0]] == 1)
    return Counter(best.values())


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_subset_keeps_and_reports_every_row(orders, keep):
    df, rows = orders
    kept, removed = remove_duplicates(df, ["k"], keep, order_key="ord", return_report=True)
    assert rows_of(kept) == expected(rows, keep)
    assert rows_of(kept) + rows_of(removed) == Counter(rows)
    assert rows_of(remove_duplicates(df, ["k"], keep, order_key="ord")) == expected(rows, keep)


def test_whole_rows(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, None, None), (1, None, float("nan")), (2, "A", 1.0)]
    df = spark.createDataFrame(rows, "k int, v string, x double")
    kept, removed = remove_duplicates(df, return_report=True)
    assert rows_of(kept) == Counter([(1, "a", 0.0), (1, None, None), (2, "A", 1.0)])
    assert sum(rows_of(removed).values()) == 2
    none, all_copies = remove_duplicates(df, keep=False, return_report=True)
    assert rows_of(none) == Counter([(2, "A", 1.0)])
    assert sum(rows_of(all_copies).values()) == 4


def test_a_hot_row_is_listed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_CHUNK", 7)
    df = spark.range(100).select((F.col("id") % 3 == 0).alias("hot"), F.lit(1).alias("one"))
    kept, removed = remove_duplicates(df, return_report=True)
    assert kept.count() == 2
    assert rows_of(removed) == Counter({(True, 1): 33, (False, 1): 65})


def test_normalized_text_is_kept_in_the_output(spark):
    df = spark.createDataFrame([(" Alice",), ("alice ",), ("BOB",)], "v string")
    assert rows_of(remove_duplicates(df, normalize_text=True)) == Counter([("alice",), ("bob",)])
    assert remove_duplicates(df).count() == 3


def test_maps_count_as_values(spark):
    df = spark.sql("select * from values (1, map('a', 1)), (1, map('a', 1)), (1, map('a', 2)) t(k, m)")
    assert remove_duplicates(df).count() == 2
    assert remove_duplicates(df, ["k"], "first", order_key="k").count() == 1


def test_bad_arguments(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="unknown columns"):
        remove_duplicates(df, ["a", "nope"])
    with pytest.raises(ValueError, match="order_key"):
        remove_duplicates(df, ["a"])
    with pytest.raises(ValueError, match="keep"):
        remove_duplicates(df, keep="middle")


def test_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 1)], "a int, b int")
    assert tuple(duplicate_counts(df).first()) == (4, 3, 1)
    assert tuple(duplicate_counts(df, ["a"]).first()) == (4, 2, 2)
    assert tuple(duplicate_counts(df.where("a > 5")).first()) == (0, 0, 0)


def test_no_window_gathers_a_key(orders):
    df, _ = orders
    plan = remove_duplicates(df, ["k"], "first", order_key="ord")._jdf.queryExecution().toString()
    assert "Window" not in plan
