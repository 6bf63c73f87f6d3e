from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import washline
from washline.errors import InvalidInputError, ValidationError
from washline.plans.states import fit_state, merge_states, model_of, moments_of, state_points

SCHEMA = "`Some Key` bigint, x double, y int, price string, day string, word string, flag boolean, at date, tags array<int>"


def rows(n, seed):
    rng = np.random.default_rng(seed)
    found = []
    for i in range(n):
        k = int(rng.integers(0, 1_000_000))
        found.append(
            (
                k,
                None if i % 7 == 0 else float(rng.lognormal(1, 1)),
                int(rng.integers(-50, 50)),
                "n.a." if i % 10 == 0 else f"${k / 100:.2f}",
                None if i % 12 == 0 else f"2024-0{1 + k % 9}-1{k % 9}",
                ("  Red ", "red", "BLUE", "ﬁne")[int(rng.integers(0, 4))],
                None if i % 3 == 0 else bool(rng.random() < 0.8),
                None,
                [1],
            )
        )
    return found


@pytest.fixture(scope="module")
def parts(spark):
    return [spark.createDataFrame(rows(n, n), SCHEMA) for n in (900, 40, 3_000)]


@pytest.fixture(scope="module")
def stored(parts, tmp_path_factory):
    """The state of each part, written and read again."""
    states = []
    for i, part in enumerate(parts):
        path = str(tmp_path_factory.mktemp("states") / str(i))
        fit_state(part).write.parquet(path)
        states.append(part.sparkSession.read.parquet(path))
    return states


@pytest.fixture(scope="module")
def merged(stored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("states") / "merged")
    merge_states(reduce(DataFrame.unionByName, stored)).write.parquet(path)
    return stored[0].sparkSession.read.parquet(path)


def points(state):
    return {(r.name, r.reading): r.asDict() for r in state_points(state).collect()}


def test_merged_states_equal_the_state_of_all_rows(parts, merged):
    whole, found = points(fit_state(reduce(DataFrame.unionByName, parts))), points(merged)
    assert whole.keys() == found.keys() and len(found) == 9 + 2 * 3
    for key, row in whole.items():
        other = found[key]
        for c in ("position", "dtype", "rows", "n", "digits", "integers", "whole", "wide", "beyond_double", "low", "high", "mode"):
            assert (row[c] or 0) == (other[c] or 0), (key, c)
        if key[1] == "text":
            continue
        a, b = moments_of(row), moments_of(other)
        for c in ("mean", "std", "skew", "total"):
            one, two = getattr(a, c) or 0, getattr(b, c) or 0
            assert one == pytest.approx(two, rel=1e-9, abs=1e-12), (key, c)


def test_moments_and_sketched_ranks_against_numpy(parts, merged):
    x = np.array([r.x for p in parts for r in p.select("x").collect() if r.x is not None])
    row = points(merged)["x", "value"]
    m = moments_of(row)
    assert (m.n, m.low, m.high) == (len(x), x.min(), x.max())
    assert m.mean == pytest.approx(x.mean()) and m.std == pytest.approx(x.std(ddof=1))
    n, z = len(x), (x - x.mean()) / x.std()
    assert m.skew == pytest.approx((z**3).mean() * (n * (n - 1)) ** 0.5 / (n - 2))
    for p, v in zip((0.25, 0.5, 0.75), row["points"][-3:]):
        assert (x < v).mean() - 0.004 <= p <= (x <= v).mean() + 0.004


def test_model_equals_that_of_a_fit_on_all_rows(parts, merged):
    whole = reduce(DataFrame.unionByName, parts)
    found, exact = model_of(merged), washline.fit(whole)
    assert found.source_names == exact.source_names and found.output_names == exact.output_names
    assert found.targets == exact.targets == {"c3": "double", "c4": "timestamp_ntz"}
    assert found.caps.keys() == exact.caps.keys() and found.fills.keys() == exact.fills.keys()
    for c, cap in exact.caps.items():
        assert found.caps[c].method == cap.method
        assert (found.caps[c].low, found.caps[c].high) == pytest.approx((cap.low, cap.high), rel=0.05)
    for c, fill in exact.fills.items():
        other = found.fills[c]
        assert other.kind == fill.kind
        if fill.kind in ("text", "boolean"):
            assert other.value == fill.value
        else:
            assert other.value == pytest.approx(fill.value, rel=0.02, abs=1)
    assert model_of(merged).transform(whole).schema == exact.transform(whole).schema
    assert washline.CleaningModel.from_json(found.to_json()) == found


def test_states_merge_in_any_grouping(stored):
    a, b, c = stored
    left = merge_states(merge_states(a.unionByName(b)).unionByName(c))
    right = merge_states(a.unionByName(merge_states(b.unionByName(c))))
    one, two = points(left), points(right)
    assert one.keys() == two.keys()
    for key in one:
        assert [one[key][c] for c in ("rows", "n", "low", "high", "mode")] == [two[key][c] for c in ("rows", "n", "low", "high", "mode")]
        if not one[key]["n"] or key[1] == "text":
            continue
        assert one[key]["m2"] == pytest.approx(two[key]["m2"])
        assert one[key]["m3"] == pytest.approx(two[key]["m3"], rel=1e-9, abs=1e-9)


def test_empty_tables_and_columns_without_values(spark):
    schema = "a double, b string, c int"
    empty = fit_state(spark.createDataFrame([], schema))
    assert empty.count() == 0
    with pytest.raises(InvalidInputError):
        model_of(merge_states(empty))
    gaps = fit_state(spark.createDataFrame([(None, None, 4), (float("nan"), None, 4)], schema))
    model = model_of(merge_states(gaps.unionByName(empty)))
    assert model.caps == {} and {c: f.value for c, f in model.fills.items()} == {"c0": 0.0, "c1": "Unknown", "c2": 4}
    later = fit_state(spark.createDataFrame([(2.0, "12", 4)] * 8 + [(4.0, "x", 4)], schema))
    both = model_of(merge_states(gaps.unionByName(later)))
    assert both.fills["c0"].value == pytest.approx(20 / 9, rel=0.15) and both.fills["c1"].value == "12"
    constant = points(merge_states(gaps.unionByName(later)))["c", "value"]
    assert moments_of(constant).std == 0 and moments_of(constant).skew == 0


def test_a_type_is_decided_by_all_rows_together(spark):
    words = spark.createDataFrame([("word",)] * 3, "v string")
    numbers = spark.createDataFrame([(str(i),) for i in range(20)], "v string")
    assert model_of(merge_states(fit_state(words).unionByName(fit_state(numbers)))).targets == {"c0": "double"}
    assert model_of(fit_state(numbers)).targets == {"c0": "bigint"}
    assert model_of(fit_state(words)).targets == {}


def test_states_that_do_not_belong_together(spark):
    one, other = spark.range(3), spark.range(3).select(F.col("id").cast("int"))
    with pytest.raises(InvalidInputError):
        model_of(merge_states(fit_state(one).unionByName(fit_state(other))))
    with pytest.raises(InvalidInputError):  # not merged
        model_of(fit_state(one).unionByName(fit_state(one)))
    with pytest.raises(ValidationError):
        model_of(fit_state(one), washline.CleaningConfig(outliers="remove"))


def test_a_cap_changes_the_fill(spark):
    rows = spark.createDataFrame([(float(i % 100),) for i in range(2_000)] + [(1e6,), (None,)], "v double")
    model, exact = model_of(fit_state(rows)), washline.fit(rows)
    assert model.caps["c0"].high == pytest.approx(exact.caps["c0"].high, abs=5)  # quartiles off by one value each
    assert model.fills["c0"].value == pytest.approx(exact.fills["c0"].value, abs=1)


def test_modes_of_many_different_texts(spark):
    # 3,000 texts of equal frequency but one, and 20,000 texts of which one has two rows of a hundred.
    rows = spark.range(30_000).selectExpr(
        "id",
        "concat('t', CASE WHEN id = 7 THEN 1234 ELSE id % 3000 END) AS few",
        "concat('u', CASE WHEN id % 50 = 0 THEN 5 ELSE id % 20000 END) AS many",
    )
    thirds = [fit_state(rows.where(f"id % 3 = {i}")) for i in range(3)]
    found = points(merge_states(reduce(DataFrame.unionByName, thirds)))
    assert found["few", "text"]["mode"] == "t1234" and found["many", "text"]["mode"] == "u5"
