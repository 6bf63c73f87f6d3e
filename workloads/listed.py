"""Long lists of allowed values, and modes of columns with many different values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.functions.names import quoted
from washline.operators import validate
from washline.operators.frequent import sketched_modes
from workloads.registry import query
from workloads.views import table

_GOOD = "SELECT c_custkey FROM customer WHERE c_acctbal >= 0"


def _known_customers(spark: SparkSession, sf: str) -> dict:
    good = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey")
    return {"columns": {"o_custkey": {"dtype": "int", "nullable": True, "checks": [{"isin": good}]}}}


@query(
    f"""
    SELECT CAST(0 AS INTEGER) AS rule, 'o_custkey' AS "column", 'dtype(int)' AS "check", CAST(0 AS BIGINT) AS n_failed
    UNION ALL
    SELECT CAST(1 AS INTEGER), 'o_custkey', 'isin(table c_custkey)', count(*) FROM orders WHERE o_custkey NOT IN ({_GOOD})
    """
)
def validate_listed_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer is not in a table of customers, counted."""
    return validate.validation_report(table(spark, sf, "orders"), _known_customers(spark, sf))


@query(
    f"""
    SELECT CAST(1 AS INTEGER) AS rule, 'o_custkey' AS "column", 'isin(table c_custkey)' AS "check",
           CAST(o_custkey AS VARCHAR) AS failure_case
    FROM orders WHERE o_custkey NOT IN ({_GOOD})
    """
)
def unlisted_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of orders that are not in a table of customers."""
    return validate.failure_cases(table(spark, sf, "orders"), _known_customers(spark, sf))


@query(
    """
    SELECT CAST(0 AS INTEGER) AS rule, 'o_orderkey' AS "column", 'dtype(int)' AS "check", CAST(0 AS BIGINT) AS n_failed
    UNION ALL
    SELECT CAST(1 AS INTEGER), 'o_orderkey', 'isin(1000000 values)',
           count(*) FILTER (WHERE o_orderkey % 2 = 1 OR o_orderkey >= 2000000 OR o_orderkey < 0) FROM orders
    """
)
def validate_long_list(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose key is not among a million listed ones, counted."""
    spec = {"dtype": "int", "nullable": True, "checks": [{"isin": list(range(0, 2_000_000, 2))}]}
    return validate.validation_report(table(spark, sf, "orders"), {"columns": {"o_orderkey": spec}})


_KEPT = """
    SELECT CAST({i} AS INTEGER) AS rule, '{column}' AS "column", '{check}' AS "check",
           count(*) FILTER (WHERE {test}) AS n_failed, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_new FROM orders"""
_KEPT_RULES = [
    ("o_orderstatus", "dtype(str)", "FALSE"),
    ("o_orderstatus", "not_nullable", "o_orderstatus IS NULL"),
    ("o_orderstatus", "isin([''O'', 1])", "o_orderstatus NOT IN ('O', '1')"),
    ("o_custkey", "dtype(int)", "FALSE"),
    ("o_custkey", "not_nullable", "o_custkey IS NULL"),
    ("o_custkey", "in_range(0, 500)", "o_custkey NOT BETWEEN 0 AND 500"),
]


@query(
    " UNION ALL ".join(
        _KEPT.format(i=i, column=column, check=check, test=test) for i, (column, check, test) in enumerate(_KEPT_RULES)
    )
)
def validate_keeps_table(spark: SparkSession, sf: str) -> DataFrame:
    """A report that finds violations, with the rows that the validated table lost or got against a fresh read."""
    rows = table(spark, sf, "orders")
    spec = {
        "columns": {
            "o_orderstatus": {"dtype": "str", "checks": [{"isin": ["O", 1]}]},
            "o_custkey": {"dtype": "int", "checks": [{"in_range": {"min": 0, "max": 500}}]},
        }
    }
    report = validate.validation_report(rows, spec)
    fresh = table(spark, sf, "orders")
    lost, new = fresh.exceptAll(rows).count(), rows.exceptAll(fresh).count()
    return report.withColumns({"n_lost": F.lit(lost).cast("long"), "n_new": F.lit(new).cast("long")})


def _mode_sql(name: str, column: str) -> str:
    return (
        f"(SELECT '{column}' AS \"column\", CAST({column} AS VARCHAR) AS mode FROM {name} WHERE {column} IS NOT NULL"
        f" GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query(" UNION ALL ".join(_mode_sql("orders", c) for c in ("o_orderstatus", "o_custkey", "o_orderkey")))
def modes_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Modes of columns with few, many and only different values, by sketches and exact counts of candidates."""
    orders = table(spark, sf, "orders")
    status = sketched_modes(orders, {"o_orderstatus": quoted("o_orderstatus")})
    keys = sketched_modes(orders, {c: quoted(c).cast("bigint") for c in ("o_custkey", "o_orderkey")})
    found = [(c, str(v)) for c, v in {**status, **keys}.items()]
    return spark.createDataFrame(found, "column string, mode string")
