"""Sources, names, text, mappings, short views and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.functions import text as text_rules
from washline.operators import columns as ops
from washline.operators.dedup import duplicate_counts, remove_duplicates
from washline.plans.jobs import clean_file
from washline.sources.files import read_data, write_data
from workloads.registry import query
from workloads.views import PART, scratch, sql_view, table, view

# ---------------------------------------------------------------- sources, sinks


@query("SELECT * FROM nation")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return read_data(spark, f"{sf}/nation.parquet")


@query(
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,"
    " c_mktsegment FROM customer"
)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "customer.csv")
    write_data(table(spark, sf, "customer"), path)
    return read_data(spark, path)


@query(
    "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal"
    " FROM supplier"
)
def convert_csv_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    first, second = scratch(spark, "supplier.csv"), scratch(spark, "supplier.parquet")
    write_data(table(spark, sf, "supplier"), first)
    write_data(read_data(spark, first), second)
    return read_data(spark, second)


_TOKENS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 1 THEN '#N/A'"
    " WHEN o_orderkey % 5 = 2 THEN 'None' ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'NULL' WHEN o_orderkey % 7 = 1 THEN ''"
    " ELSE CAST(o_custkey AS varchar(20)) END AS custkey",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END AS flag",
    "'null' AS nothing",
]


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_orderstatus END AS status,"
    " CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE o_custkey END AS custkey,"
    " o_orderkey % 2 = 0 AS flag, CAST(NULL AS DOUBLE) AS nothing FROM orders"
)
def csv_na_tokens(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "orders.csv")
    write_data(view(spark, sf, "orders", _TOKENS), path)
    return read_data(spark, path)


@query(
    "WITH q AS (SELECT skewness(s_acctbal) AS sk, quantile_cont(s_acctbal, 0.25) AS q1,"
    " quantile_cont(s_acctbal, 0.75) AS q3, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS d"
    " FROM supplier), b AS (SELECT"
    " CASE WHEN abs(sk) > 0.5 THEN q1 - 1.5 * (q3 - q1) ELSE m - 3 * d END AS lo,"
    " CASE WHEN abs(sk) > 0.5 THEN q3 + 1.5 * (q3 - q1) ELSE m + 3 * d END AS hi FROM q)"
    " SELECT s_suppkey, lower(s_name) AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey,"
    " round(least(greatest(s_acctbal, lo), hi), 4) AS s_acctbal FROM supplier, b"
)
def clean_csv_file(spark: SparkSession, sf: str) -> DataFrame:
    """Twice the supplier rows, cleaned from CSV to Parquet."""
    source, target = scratch(spark, "supplier.csv"), scratch(spark, "supplier_cleaned.parquet")
    rows = table(spark, sf, "supplier")
    write_data(rows.unionAll(rows), source)
    clean_file(spark, source, target)
    return read_data(spark, target).withColumn("s_acctbal", F.round("s_acctbal", 4))


# -------------------------------------------------------------------- names, text


@query("SELECT * FROM customer")
def normalize_columns(spark: SparkSession, sf: str) -> DataFrame:
    untidy = table(spark, sf, "customer").toDF(
        "C CustKey", " c-name ", "C  NationKey!!", "__c.acctbal", "C_MktSegment__"
    )
    return ops.normalize_column_names(untidy)


@query(
    "SELECT c_custkey AS a, c_name AS a_1, c_nationkey AS a_2, c_acctbal AS a_1_1,"
    " c_mktsegment AS b FROM customer"
)
def decollide_columns(spark: SparkSession, sf: str) -> DataFrame:
    untidy = table(spark, sf, "customer").toDF("a", "a ", "A", "a_1", "b")
    return ops.normalize_column_names(untidy)


_PART_SQL = sql_view("part", PART)
_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _tidy_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def _token_sql(c: str) -> str:
    return f"CASE WHEN {c} IN ('nan', 'none', 'null') THEN NULL ELSE {c} END"


@query(f"SELECT p_partkey, {_token_sql('p_type')} AS p_type FROM ({_PART_SQL})")
def text_null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "part", PART)
    return rows.select("p_partkey", text_rules.null_tokens(F.col("p_type")).alias("p_type"))


@query(
    "SELECT p_partkey, trim(p_name, ' ' || chr(9) || chr(10)) AS stripped,"
    f" {_tidy_sql('p_name')} AS tidy, lower({_tidy_sql('p_name')}) AS lowered FROM ({_PART_SQL})"
)
def text_strip_collapse_lower(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return view(spark, sf, "part", PART).select(
        "p_partkey",
        text_rules.strip(name).alias("stripped"),
        text_rules.tidy_space(name).alias("tidy"),
        F.lower(text_rules.tidy_space(name)).alias("lowered"),
    )


def _clean_sql(c: str) -> str:
    return f"lower({_tidy_sql(_token_sql(c))})"


@query(
    f"SELECT p_partkey, {_clean_sql('p_name')} AS p_name, {_clean_sql('p_type')} AS p_type,"
    f" {_clean_sql('p_brand')} AS p_brand FROM ({_PART_SQL})"
)
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return ops.clean_text_columns(view(spark, sf, "part", PART))


def _normal_sql(c: str) -> str:
    return f"lower(nfc_normalize({_tidy_sql(c)}))"


# DuckDB has NFC only. The documents hold no compatibility characters, so there NFC and NFKC
# agree; the ones appended here (a ligature, full-width text) are written out by hand.
@query(
    f"SELECT doc_id, {_normal_sql("text || ' fi a1'")} AS text, {_normal_sql('lang')} AS lang"
    " FROM documents"
)
def text_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents through every text rule."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.concat("text", F.lit(" \ufb01 \uff21\uff11")).alias("text"), "lang"
    )
    return ops.clean_text_columns(rows)


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled'"
    " ELSE lower(o_orderstatus) END AS o_orderstatus FROM orders"
)
def categorical_map(spark: SparkSession, sf: str) -> DataFrame:
    mapping = {"o_orderstatus": {"o": "open", "f": "filled"}, "absent": {"x": "y"}}
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ops.clean_text_columns(rows, categorical_mapping=mapping)


@query(
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN NULL"
    " ELSE o_orderpriority END AS o_orderpriority FROM orders"
)
def categorical_map_join(spark: SparkSession, sf: str) -> DataFrame:
    """The route of large dictionaries: a join instead of an expression."""
    mapping = {"o_orderpriority": {"1-URGENT": "now", "5-LOW": None}}
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ops.normalize_categorical_text(rows, mapping, inline_limit=0)


def _head_sql(n: int, width: int) -> str:
    cells = ", ".join(
        f"left(CAST({c} AS VARCHAR), {width}) AS {c}"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
    return f"SELECT {cells} FROM (SELECT * FROM documents ORDER BY documents.doc_id LIMIT {n})"


@query(_head_sql(2, 80))
def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.preview_rows(table(spark, sf, "documents"), "doc_id")


@query(_head_sql(50, 200))
def sample_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sample_rows(table(spark, sf, "documents"), "doc_id")


# --------------------------------------------------------------------- duplicates

_REPEATED = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem"
_ALL = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,"
    " l_tax, l_returnflag, l_linestatus, l_shipdate"
)


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.unionAll(rows)


@query(f"SELECT DISTINCT * FROM ({_REPEATED})")
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(_repeated(spark, sf))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_full(spark: SparkSession, sf: str) -> DataFrame:
    """Few different rows, so almost every row is a copy of a very frequent one."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return remove_duplicates(rows)


@query(
    f"SELECT {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY {_ALL}) AS rn"
    f" FROM ({_REPEATED})) WHERE rn > 1"
)
def dedup_rows_report(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(_repeated(spark, sf), return_report=True)[1]


def _ranked_sql(order: str, test: str) -> str:
    return (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
        f" FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {order})"
        f" AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE {test}"
    )


@query(_ranked_sql("ASC", "rn = 1"))
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(
        table(spark, sf, "orders"), ["o_custkey"], "first", order_key="o_orderkey"
    )


@query(_ranked_sql("DESC", "rn = 1"))
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(
        table(spark, sf, "orders"), ["o_custkey"], "last", order_key="o_orderkey"
    )


_BY_PRICE = (
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n"
    " FROM orders) WHERE n {} 1"
)


@query(f"SELECT * EXCLUDE (n) FROM ({_BY_PRICE.format('=')})")
def dedup_keep_none(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], False)


@query(_ranked_sql("ASC", "rn > 1"))
def dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(
        table(spark, sf, "orders"),
        ["o_custkey"],
        "first",
        order_key="o_orderkey",
        return_report=True,
    )[1]


@query(f"SELECT * EXCLUDE (n) FROM ({_BY_PRICE.format('>')})")
def dedup_report_none(spark: SparkSession, sf: str) -> DataFrame:
    return remove_duplicates(
        table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], False, return_report=True
    )[1]


@query(
    "SELECT DISTINCT lower(trim(p_name, ' ' || chr(9) || chr(10))) AS p_name"
    f" FROM ({_PART_SQL})"
)
def dedup_normalized(spark: SparkSession, sf: str) -> DataFrame:
    names = view(spark, sf, "part", PART).select("p_name")
    return remove_duplicates(names, normalize_text=True)


@query(
    "SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after,"
    " CAST(sum(n) - count(*) AS BIGINT) AS duplicates_removed"
    " FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)"
)
def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_counts(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])
