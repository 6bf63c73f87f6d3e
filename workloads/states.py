"""Fits from merged states: each third of a table is summarised alone, the model comes from the states only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.plans.states import fit_state, merge_states, model_of, moments_of, state_points
from washline.staging import stage
from workloads.registry import query
from workloads.views import LINEITEM, sql_view, view


def _in_thirds(rows: DataFrame, key: str) -> DataFrame:
    """The states of three parts of a table, merged, as they would be read from where they are kept."""
    parts = [fit_state(rows.where(F.pmod(F.col(key), F.lit(3)) == i)) for i in range(3)]
    return merge_states(stage(reduce(DataFrame.unionByName, parts)))


_MEASURED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MOMENTS = """
    SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
           round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skew FROM lines"""


@query(
    f"WITH lines AS ({sql_view('lineitem', LINEITEM)})" + " UNION ALL ".join(_MOMENTS.format(c=c) for c in _MEASURED)
)
def state_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, ranges and moments of all rows from the merged states of three parts."""
    state = _in_thirds(view(spark, sf, "lineitem", LINEITEM), "l_orderkey")
    found = []
    for row in state_points(state.where(F.col("name").isin(*_MEASURED))).collect():  # one row per column
        m = moments_of(row.asDict())
        found.append((row.name, row.rows, m.n, m.low, m.high, round(m.mean, 4), round(m.std, 4), round(m.skew, 4)))
    return spark.createDataFrame(
        found, 'column string, n_rows bigint, n bigint, low double, high double, mean double, std double, skew double'
    )


_EVEN = ("l_quantity", "l_discount", "l_tax")
_LIMITS = """
    SELECT '{c}' AS "column", 'Z-score' AS method, round(avg({c}) - 3 * stddev_samp({c}), 4) AS low,
           round(avg({c}) + 3 * stddev_samp({c}), 4) AS high, round(avg({c}), 4) AS fill FROM lines"""


@query(f"WITH lines AS ({sql_view('lineitem', LINEITEM)})" + " UNION ALL ".join(_LIMITS.format(c=c) for c in _EVEN))
def state_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Limits and fills of columns without skew, from the merged states of three parts."""
    rows = view(spark, sf, "lineitem", LINEITEM)
    model = model_of(_in_thirds(rows, "l_orderkey"))
    found = []
    for c in _EVEN:
        at = f"c{rows.columns.index(c)}"
        cap = model.caps[at]
        found.append((c, cap.method, round(cap.low, 4), round(cap.high, 4), round(float(model.fills[at].value), 4)))
    return spark.createDataFrame(found, "column string, method string, low double, high double, fill double")


_TEXTS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'n.a.' ELSE '$' || CAST(o_custkey AS varchar(20)) END AS price",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS varchar(40)), 1, 10) END AS placed",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE o_orderpriority END AS priority",
    "o_orderstatus",
]
_READINGS = """
    SELECT 'price' AS "column", 'double' AS target, count(*) AS n_rows, count(*) FILTER (WHERE price <> 'n.a.') AS n_read,
           NULL AS mode FROM texts
    UNION ALL
    SELECT 'placed', 'timestamp_ntz', count(*), count(placed), NULL FROM texts
    UNION ALL
    SELECT 'priority', NULL, count(*), count(*), (SELECT lower(priority) FROM texts WHERE priority <> 'null'
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM texts WHERE priority <> 'null'
    UNION ALL
    SELECT 'o_orderstatus', NULL, count(*), count(o_orderstatus), (SELECT lower(o_orderstatus) FROM texts
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM texts"""


@query(f"WITH texts AS ({sql_view('orders', _TEXTS)})" + _READINGS)
def state_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Types that text columns get from merged states, the cells that are read, and the modes of the others."""
    rows = view(spark, sf, "orders", _TEXTS)
    state = stage(_in_thirds(rows, "o_orderkey"))
    model = model_of(state)
    reading = {"double": "number", "timestamp_ntz": "datetime"}
    chosen = []
    for i, c in enumerate(rows.columns[1:], 1):
        target, fill = model.targets.get(f"c{i}"), model.fills[f"c{i}"]
        chosen.append((i, target, reading.get(target, "text"), fill.value if fill.kind == "text" else None))
    picked = spark.createDataFrame(chosen, "position int, target string, reading string, mode string")
    n_rows = F.when(F.col("name") == "priority", F.col("n")).otherwise(F.col("rows"))
    return state.join(picked, ["position", "reading"]).select(
        F.col("name").alias("column"), "target", n_rows.alias("n_rows"), F.col("n").alias("n_read"), "mode"
    )
