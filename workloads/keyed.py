"""Statistics, caps and fills by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.operators.keyed import cap_by, fill_by, fit_by, profile_by
from workloads.registry import query
from workloads.views import LINEITEM, sql_view, table, view

_VALUES = ["l_quantity", "l_extendedprice", "l_tax"]
_SOURCE = sql_view("lineitem", LINEITEM)


def _stats(c: str, by: str = "l_returnflag") -> str:
    return f"""
        SELECT {by} AS k, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, skewness({c}) AS skew, min({c}) AS lo,
               max({c}) AS hi, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3,
               count(*) AS rows
        FROM src GROUP BY {by}"""


_BOUNDED = """
    SELECT *, CASE WHEN abs(skew) > 0.5 THEN q1 - 1.5 * (q3 - q1) ELSE mean - 3 * std END AS lower,
           CASE WHEN abs(skew) > 0.5 THEN q3 + 1.5 * (q3 - q1) ELSE mean + 3 * std END AS upper FROM ({})"""


def _capped_sql() -> str:
    ctes = ", ".join(f"m{i} AS ({_BOUNDED.format(_stats(c))})" for i, c in enumerate(_VALUES))
    cells = ", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, m{i}.lower), m{i}.upper) END, 4) AS {c}"
        for i, c in enumerate(_VALUES)
    )
    joins = " ".join(f"LEFT JOIN m{i} ON src.l_returnflag IS NOT DISTINCT FROM m{i}.k" for i in range(len(_VALUES)))
    return f"WITH src AS ({_SOURCE}), {ctes} SELECT l_orderkey, l_linenumber, l_returnflag, {cells} FROM src {joins}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_capped_sql())
def outliers_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Each value capped by the bounds of its column among rows of its return flag; a missing flag is a group."""
    rows = view(spark, sf, "lineitem", LINEITEM).select("l_orderkey", "l_linenumber", "l_returnflag", *_VALUES)
    return _rounded(cap_by(rows, ["l_returnflag"], _VALUES))


def _filled_sql() -> str:
    ctes = ", ".join(f"m{i} AS ({_stats(c)})" for i, c in enumerate(_VALUES))
    cells = ", ".join(
        f"round(coalesce({c}, CASE WHEN abs(m{i}.skew) > 0.75 THEN m{i}.q2 ELSE m{i}.mean END, 0), 4) AS {c}"
        for i, c in enumerate(_VALUES)
    )
    joins = " ".join(f"LEFT JOIN m{i} ON src.l_returnflag IS NOT DISTINCT FROM m{i}.k" for i in range(len(_VALUES)))
    return f"WITH src AS ({_SOURCE}), {ctes} SELECT l_orderkey, l_linenumber, l_returnflag, {cells} FROM src {joins}"


@query(_filled_sql())
def fill_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps filled with the mean or median of the rows with the same return flag."""
    rows = view(spark, sf, "lineitem", LINEITEM).select("l_orderkey", "l_linenumber", "l_returnflag", *_VALUES)
    return _rounded(fill_by(rows, ["l_returnflag"], _VALUES))


@query(
    f"WITH src AS ({_SOURCE}) "
    + " UNION ALL ".join(
        f"SELECT k AS l_returnflag, '{c}' AS \"column\", rows, rows - n AS missing, round(mean, 4) AS mean, round(std, 4) AS std,"
        f" round(lo, 4) AS min, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, round(hi, 4) AS max"
        f" FROM ({_stats(c)})"
        for c in _VALUES
    )
)
def profile_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of numeric columns for each return flag."""
    return _rounded(profile_by(view(spark, sf, "lineitem", LINEITEM), ["l_returnflag"], _VALUES))


@query(
    "SELECT o_custkey, 'o_totalprice' AS \"column\", count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,"
    " round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max"
    " FROM orders GROUP BY o_custkey"
)
def quantiles_of_many_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quartiles of thousands of groups at once."""
    model = fit_by(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"])
    return _rounded(model.select("o_custkey", "column", "n", "q1", "median", "q3", "max"))
