import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washline.operators import statistics
from washline.operators.statistics import grouped_quantile, modes, moments, quantiles

POINTS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


def columns():
    rng = random.Random(3)
    n = 3001
    return {
        "uniform": [rng.uniform(-5, 5) for _ in range(n)],
        "heavy_tail": [math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1]) for _ in range(n)],
        "one_third_equal": [7.0 if i % 3 == 0 else rng.gauss(7, 1e-9) for i in range(n)],
        "few": [float(rng.randrange(4)) for _ in range(n)],
        "constant": [2.5] * n,
        "gaps": [None if i % 2 else float(i) for i in range(n)],
        "tiny": [5e-324 * (i % 7) for i in range(n)],
        "neighbours": [math.nextafter(1.0, 2.0) if i % 2 else 1.0 for i in range(n)],
        "negative": [-float(i) ** 3 for i in range(n)],
    }


@pytest.fixture(scope="module")
def numbers(spark):
    data = columns()
    rows = list(zip(*data.values()))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)), data


@pytest.mark.parametrize(
    "route",
    [{}, {"small_rows": 0}, {"small_rows": 7}, {"small_rows": 60}],
)
def test_quantiles_match_numpy(numbers, route):
    """Exact in one buffer, narrowed to single values, and narrowed to what a buffer holds."""
    df, data = numbers
    found = quantiles(df, {c: POINTS for c in data}, **route)
    for c, cells in data.items():
        present = [x for x in cells if x is not None]
        for p in POINTS:
            assert found[c][p] == pytest.approx(np.quantile(present, p), rel=1e-12, abs=0), (c, p)


def test_infinite_values_have_their_rank(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("inf"), float("-inf"))], "x double")
    found = quantiles(df, {"x": (0.0, 0.5, 1.0)}, small_rows=0)["x"]
    assert found == {0.0: float("-inf"), 0.5: 2.0, 1.0: float("inf")}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=30))
def test_narrowing_finds_any_order_statistic(spark, cells):
    df = spark.createDataFrame([(x,) for x in cells], "x double")
    ranks = [i / (len(cells) - 1) for i in range(len(cells))] if len(cells) > 1 else [0.0]
    found = quantiles(df, {"x": (ranks[0], ranks[-1], ranks[len(ranks) // 2])}, small_rows=0)["x"]
    ordered = sorted(cells)
    assert found[ranks[0]] == ordered[0] and found[ranks[-1]] == ordered[-1]


def test_no_values_no_quantiles(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(df, {"x": (0.5,)}) == {}


def test_approximation_is_opt_in(numbers):
    df, data = numbers
    found = quantiles(df, {"uniform": (0.5,)}, accuracy=1000)["uniform"][0.5]
    assert abs(found - np.median(data["uniform"])) < 0.1


def test_moments_match_pandas(numbers):
    df, data = numbers
    found = moments(df, list(data))
    for c in ("uniform", "few", "gaps", "negative"):
        series = pd.Series(data[c], dtype="float64")
        stats = found[c]
        assert stats.n == series.count()
        assert stats.low == series.min() and stats.high == series.max()
        assert stats.mean == pytest.approx(series.mean())
        assert stats.std == pytest.approx(series.std())
        assert stats.skew == pytest.approx(series.skew(), abs=1e-9)
    assert found["constant"].skew == 0.0 and not found["constant"].varies


def test_moments_of_almost_nothing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    found = moments(df, ["a", "b"])
    assert found["a"].skew is None and found["a"].n == 2
    assert found["b"].n == 0 and not found["b"].varies


@pytest.mark.parametrize("small_rows", [0, 40, 1000])
def test_grouped_quantile(spark, small_rows):
    rng = random.Random(5)
    rows = [(rng.choice("aaab") if i % 9 else None, rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").where("k is not null")
    got = {r.k: r.quantile for r in grouped_quantile(df, ["k"], "v", 0.95, small_rows=small_rows).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(np.quantile([v for key, v in rows if key == k], 0.95))


def test_modes(spark):
    df = spark.createDataFrame(
        [("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "v string, w string"
    )
    assert modes(df, ["v", "w"]) == {"v": "a"}
    assert modes(df, []) == {}


def test_narrowing_broadcasts_its_few_intervals(spark, numbers, monkeypatch):
    df, _ = numbers
    plans = []
    real = statistics._collected

    def watched(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        result = real(frame)
        assert result._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10_000
        return result

    monkeypatch.setattr(statistics, "_collected", watched)
    quantiles(df, {"uniform": (0.5,)}, small_rows=0)
    assert 1 <= len(plans) <= 7


def test_no_pass_shuffles_rows_or_sorts_them(numbers):
    """Counting passes exchange one record per bucket, so no sort of the values is planned."""
    df, _ = numbers
    from washline.operators.statistics import stacked

    plan = (
        stacked(df, {"few": F.col("few")}).groupBy("col").agg(F.avg("v"))._jdf.queryExecution().toString()
    )
    assert plan.count("Exchange") == 1 and "Sort" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("small_rows", [0, 1_000_000])
def test_grouped_quantile_of_a_missing_key(spark, small_rows):
    """A missing key is a key: narrowed like any other, with its mean."""
    rows = [(None if i % 2 else "a", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: (r.quantile, r.mean) for r in grouped_quantile(df, ["k"], "v", 0.5, small_rows=small_rows).collect()}
    assert found == {"a": (199.0, 199.0), None: (200.0, 200.0)}
