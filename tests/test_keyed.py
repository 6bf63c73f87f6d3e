"""Statistics by group against pandas, for hot, missing and constant groups."""

import math
import random

import pandas as pd
import pytest

from washline.errors import InvalidInputError
from washline.operators.keyed import cap_by, fill_by, fit_by, profile_by


@pytest.fixture
def sales(spark):
    pick = random.Random(11)
    rows = []
    for i in range(600):
        key = "hot" if i % 2 else pick.choice(["a", "b", None, "one"])
        skewed = round(math.exp(pick.gauss(0, 1.5)), 3)
        rows.append((i, key, i % 3, None if i % 7 == 0 else skewed, None if i % 5 == 0 else float(pick.randrange(20)), 7))
    rows += [(1000, "single", 0, 5.0, None, 7), (1001, "gap", 0, None, None, 7), (1002, "nan", 0, float("nan"), 1.0, 7)]
    return spark.createDataFrame(rows, "id int, key string, part int, price double, qty double, same int")


def frame(df):
    found = df.toPandas()
    found[["price", "qty"]] = found[["price", "qty"]].astype(float)
    return found


def plain_stats(values):
    q1, med, q3 = (values.quantile(p) for p in (0.25, 0.5, 0.75))
    skew = values.skew() if len(values) > 2 else float("nan")
    margin = 1.5 * (q3 - q1) if abs(skew) > 0.5 else 3 * values.std()
    centre = (q1, q3) if abs(skew) > 0.5 else (values.mean(), values.mean())
    stated = values.min() < values.max() and margin > 0
    return {
        "n": len(values), "mean": values.mean(), "q1": q1, "median": med, "q3": q3,
        "lower": centre[0] - margin if stated else None, "upper": centre[1] + margin if stated else None,
        "fill": med if abs(skew) > 0.75 else values.mean(),
    }


@pytest.mark.parametrize("by", [["key"], ["key", "part"]])
def test_model_against_pandas(sales, by):
    found = {(*[r[c] for c in by], r.column): r for r in fit_by(sales, by, ["price", "qty"]).collect()}
    expected = {}
    for key, group in frame(sales).groupby(by, dropna=False):
        for c in ("price", "qty"):
            values = group[c].dropna()
            if len(values):
                expected[(*[None if pd.isna(k) else k for k in key], c)] = plain_stats(values)
    assert set(found) == set(expected)
    for k, stats in expected.items():
        for name, value in stats.items():
            assert found[k][name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), (k, name)


def test_caps_and_fills_by_group(sales):
    rows = frame(sales).set_index("id")
    stats = {
        (None if pd.isna(k) else k, c): plain_stats(g[c].dropna()) for k, g in rows.groupby("key", dropna=False) for c in ("price", "qty") if g[c].notna().any()
    }
    capped, filled = cap_by(sales, ["key"], ["price", "qty"]), fill_by(sales, ["key"], ["price", "qty"])
    assert capped.columns == filled.columns == sales.columns
    for r, f in zip(capped.orderBy("id").collect(), filled.orderBy("id").collect()):
        for c in ("price", "qty"):
            value, s = rows.loc[r.id, c], stats.get((r.key, c))
            if math.isnan(value):
                assert r[c] is None and f[c] == pytest.approx(s["fill"] if s else 0.0)
            else:
                low, high = (s[b] if s[b] is not None else value for b in ("lower", "upper"))
                assert r[c] == pytest.approx(min(max(value, low), high)) and f[c] == value


def test_profile_counts_gaps_of_every_group(sales):
    found = {(r.key, r.column): r for r in profile_by(sales, ["key"], ["price", "qty"]).collect()}
    rows = frame(sales)
    for k, g in rows.groupby("key", dropna=False):
        for c in ("price", "qty"):
            r = found.pop((None if pd.isna(k) else k, c))
            assert (r.rows, r.missing) == (len(g), g[c].isna().sum())
    assert not found


def test_no_rows_and_wrong_columns(sales):
    none = sales.limit(0)
    assert fit_by(none, ["key"]).count() == cap_by(none, ["key"]).count() == fill_by(none, ["key"]).count() == 0
    assert profile_by(none, ["key"]).count() == 0
    for by, columns in (([], None), (["absent"], None), (["key"], ["key"]), (["key"], ["absent"]), (["part"], ["part"])):
        with pytest.raises(InvalidInputError):
            fit_by(sales, by, columns)
