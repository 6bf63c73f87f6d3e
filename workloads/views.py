"""Untidy versions of the tables, as column expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from washline.staging import staging_root

LINEITEM = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_linenumber = 2 THEN NULL WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50"
    " ELSE l_extendedprice END AS l_extendedprice",
    "l_discount",
    "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_tax END AS l_tax",
    "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate END AS l_shipdate",
]

PART = [
    "p_partkey",
    "CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || chr(9)"
    " WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', chr(10) || '  ')"
    " ELSE p_name END AS p_name",
    "CASE WHEN p_partkey % 7 = 0 THEN 'nan' WHEN p_partkey % 7 = 1 THEN ' null '"
    " WHEN p_partkey % 7 = 2 THEN 'NULL' WHEN p_partkey % 7 = 3 THEN 'none'"
    " ELSE p_type END AS p_type",
    "p_brand",
]

CUSTOMER = [
    "c_custkey",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name",
    "CASE WHEN c_custkey % 6 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey",
    "CASE WHEN c_custkey % 9 = 0 THEN 'n.a.' ELSE CAST(c_nationkey AS varchar(9)) END AS c_code",
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal",
    "c_mktsegment",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def sql_view(name: str, columns: list[str]) -> str:
    return f"SELECT {', '.join(columns)} FROM {name}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared staging folder."""
    import uuid

    return f"{staging_root(spark).rstrip('/')}/washline-files/{uuid.uuid4().hex}/{name}"
