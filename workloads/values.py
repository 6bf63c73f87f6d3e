"""Formats, outliers and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.operators import formats, missing, outliers
from washline.operators.statistics import moments, quantiles
from workloads.registry import query
from workloads.views import LINEITEM, sql_view, table, view

_LINEITEM_SQL = sql_view("lineitem", LINEITEM)
_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


def untidy_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "lineitem", LINEITEM)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(
        *(F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns)
    )


# ------------------------------------------------------------------------ formats

_MIXED_DATE = (
    "CASE o_orderkey % 8"
    " WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')"
    " WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy')"
    " WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd HH:mm:ss')"
    " WHEN 3 THEN date_format(o_orderdate, 'MMM d, yyyy')"
    " WHEN 4 THEN date_format(o_orderdate, 'yyyyMMdd')"
    " WHEN 5 THEN date_format(o_orderdate, 'd MMMM yyyy')"
    " WHEN 6 THEN upper(date_format(o_orderdate, 'EEE, d MMM yyyy'))"
    " ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 't02:00:00+02:00') END"
)
_MONEY = (
    "CASE o_orderkey % 6"
    " WHEN 0 THEN concat('$', format_number(o_totalprice, 2))"
    " WHEN 1 THEN concat('USD ', format_number(o_totalprice, 2))"
    " WHEN 2 THEN concat('(', format_number(o_totalprice, 2), ')')"
    " WHEN 3 THEN concat(format_number(o_totalprice, 2), ' €')"
    " WHEN 4 THEN concat('Rp', format_number(o_totalprice, 2))"
    " ELSE format_number(o_totalprice, 2) END"
)


@query("SELECT o_orderkey, o_orderdate FROM orders")
def parse_datetimes(spark: SparkSession, sf: str) -> DataFrame:
    """Dates printed in eight ways come back as the dates they were."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_MIXED_DATE).alias("o_orderdate"))
    return formats.standardize_formats(rows)


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 THEN -o_totalprice ELSE o_totalprice END"
    " AS o_totalprice FROM orders"
)
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_MONEY).alias("o_totalprice"))
    return formats.standardize_formats(rows)


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 10 < 3 THEN 'unknown' ELSE cast(o_custkey AS string) END").alias("mostly"),
        F.expr("CASE WHEN o_orderkey % 10 < 1 THEN 'unknown' ELSE cast(o_custkey + 0.5 AS string) END").alias("nearly"),
        F.expr("CASE WHEN o_orderkey % 20 < 3 THEN '?' ELSE date_format(o_orderdate, 'd MMM yyyy') END").alias("order_date"),
        F.expr("CASE WHEN o_orderkey % 20 < 3 THEN '?' ELSE date_format(o_orderdate, 'd MMM yyyy') END").alias("day_text"),
        F.expr("cast(o_custkey + 10000000 AS string)").alias("whole"),
    )


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 3 THEN 'unknown'"
    " ELSE CAST(o_custkey AS VARCHAR) END AS mostly,"
    " CASE WHEN o_orderkey % 10 < 1 THEN NULL ELSE o_custkey + CAST(0.5 AS DOUBLE) END AS nearly,"
    " CASE WHEN o_orderkey % 20 < 3 THEN NULL ELSE o_orderdate END AS order_date,"
    " CASE WHEN o_orderkey % 20 < 3 THEN '?' ELSE strftime(o_orderdate, '%-d %b %Y') END"
    " AS day_text, o_custkey + 10000000 AS whole FROM orders"
)
def standardize_gate(spark: SparkSession, sf: str) -> DataFrame:
    """30 % junk keeps text, 10 % does not; 15 % is fine only for a column named like a date."""
    return formats.standardize_formats(_gated(spark, sf))


@query(
    "SELECT CAST(1 + 1"
    " + max(CASE WHEN nearly > 0.8 THEN 1 ELSE 0 END) + max(CASE WHEN dated > 0.8 THEN 1 ELSE 0 END)"
    " + max(CASE WHEN mostly > 0.8 THEN 1 ELSE 0 END) + max(CASE WHEN dated > 0.9 THEN 1 ELSE 0 END)"
    " AS BIGINT) AS columns_standardized FROM (SELECT"
    " avg(CASE WHEN o_orderkey % 10 < 3 THEN 0 ELSE 1 END) AS mostly,"
    " avg(CASE WHEN o_orderkey % 10 < 1 THEN 0 ELSE 1 END) AS nearly,"
    " avg(CASE WHEN o_orderkey % 20 < 3 THEN 0 ELSE 1 END) AS dated FROM orders)"
)
def typed_column_count(spark: SparkSession, sf: str) -> DataFrame:
    n = formats.typed_column_count(formats.standardize_formats(_gated(spark, sf)))
    return spark.createDataFrame([(n,)], "columns_standardized bigint")


# ----------------------------------------------------------------------- outliers


def stats_sql(source: str, c: str) -> str:
    return (
        f"SELECT skewness({c}) AS sk, quantile_cont({c}, 0.25) AS q1,"
        f" quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS d,"
        f" min({c}) AS mn, max({c}) AS mx FROM {source}"
    )


def bounds_sql(source: str, c: str, auto: bool = True) -> str:
    """One row lo, hi (NULL where the rule does not apply) and the method."""
    iqr = "abs(sk) > 0.5" if auto else "TRUE"
    margin = f"CASE WHEN {iqr} THEN 1.5 * (q3 - q1) ELSE 3 * d END"
    return (
        f"SELECT CASE WHEN g = 0 OR mn = mx THEN NULL WHEN {iqr} THEN q1 - g ELSE m - g END AS lo,"
        f" CASE WHEN g = 0 OR mn = mx THEN NULL WHEN {iqr} THEN q3 + g ELSE m + g END AS hi,"
        f" CASE WHEN {iqr} THEN 'IQR' ELSE 'Z-score' END AS method, sk"
        f" FROM (SELECT *, {margin} AS g FROM ({stats_sql(source, c)}))"
    )


def capped_sql(c: str, bounds: str) -> str:
    return f"CASE WHEN {c} < {bounds}.lo THEN {bounds}.lo WHEN {c} > {bounds}.hi THEN {bounds}.hi ELSE {c} END"


def _report_sql(source: str, columns: list[str], auto: bool = True) -> str:
    ctes = ", ".join(f"b_{c} AS ({bounds_sql('src', c, auto)})" for c in columns)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", any_value(method) AS method, round(any_value(sk), 4) AS skew,"
        f" round(any_value(lo), 4) AS low, round(any_value(hi), 4) AS high,"
        f" count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers FROM src, b_{c}"
        for c in columns
    )
    return f"WITH src AS ({source}), {ctes} {parts}"


@query(_report_sql(_LINEITEM_SQL, _NUMBERS))
def outlier_report(spark: SparkSession, sf: str) -> DataFrame:
    """Skew, chosen rule, bounds and number of outliers of every numeric column."""
    return rounded(outliers.outlier_report(untidy_lineitem(spark, sf)))


@query(_report_sql("SELECT * FROM orders", ["o_orderkey", "o_custkey", "o_totalprice"], False))
def outlier_report_iqr(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic choice off: quartiles for every column."""
    return rounded(outliers.outlier_report(table(spark, sf, "orders"), auto_detect=False))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p,"
        f" round(quantile_cont({c}, {p}), 4) AS value FROM ({_LINEITEM_SQL})"
        for c in _NUMBERS
        for p in (0.01, 0.25, 0.5, 0.75, 0.999)
    )
)
def quantiles_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles by narrowing intervals, the route of columns too large for a buffer."""
    points = (0.01, 0.25, 0.5, 0.75, 0.999)
    found = quantiles(
        untidy_lineitem(spark, sf), {c: points for c in _NUMBERS}, small_rows=0
    )
    rows = [(c, p, v) for c, at in found.items() for p, v in at.items()]
    return rounded(spark.createDataFrame(rows, "column string, p double, value double"))


def _cap_sql(source: str, columns: list[str], others: list[str]) -> str:
    ctes = ", ".join(f"b_{c} AS ({bounds_sql('src', c)})" for c in columns)
    cells = [f"round({capped_sql(c, f'b_{c}')}, 4) AS {c}" for c in columns]
    return (
        f"WITH src AS ({source}), {ctes} SELECT {', '.join(others + cells)}"
        f" FROM src, {', '.join(f'b_{c}' for c in columns)}"
    )


_FLOATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    _cap_sql(
        _LINEITEM_SQL,
        _FLOATS,
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
         "l_shipdate"],
    )
)
def outliers_cap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.handle_outliers(untidy_lineitem(spark, sf)))


_SPIKED = [
    "l_orderkey",
    "CASE WHEN l_orderkey % 89 = 0 THEN l_quantity * 20 ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 WHEN l_linenumber = 2 THEN NULL"
    " ELSE l_extendedprice END AS l_extendedprice",
    "CASE WHEN l_orderkey % 89 = 0 THEN l_tax + 1 ELSE l_tax END AS l_tax",
]


def remove_sql(source: str, columns: list[str], last: str) -> str:
    """CTEs that remove rows column by column; ``last`` names the remaining rows."""
    ctes, current = [f"r0 AS ({source})"], "r0"
    for i, c in enumerate(columns, 1):
        ctes.append(f"b{i} AS ({bounds_sql(current, c)})")
        ctes.append(
            f"r{i} AS (SELECT {current}.* FROM {current}, b{i}"
            f" WHERE NOT coalesce({c} < lo OR {c} > hi, FALSE))"
        )
        current = f"r{i}"
    return f"WITH {', '.join(ctes)}, {last} AS (SELECT * FROM {current})"


@query(
    remove_sql(
        sql_view("lineitem", _SPIKED),
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"],
        last="kept",
    )
    + " SELECT * FROM kept"
)
def outliers_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of a column come from the rows that the earlier columns left."""
    return outliers.handle_outliers(view(spark, sf, "lineitem", _SPIKED), "remove")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low,"
        f" CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 4) AS mean,"
        f" round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skew"
        f" FROM ({_LINEITEM_SQL})"
        for c in _NUMBERS
    )
)
def skew_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, range, mean, deviation and skewness of every numeric column, in one pass."""
    found = moments(untidy_lineitem(spark, sf), _NUMBERS)
    rows = [(c, m.n, m.low, m.high, m.mean, m.std, m.skew) for c, m in found.items()]
    return rounded(
        spark.createDataFrame(
            rows,
            "column string, n bigint, low double, high double, mean double, std double, skew double",
        )
    )


# ----------------------------------------------------------------- missing values

_LINEITEM_COLUMNS = [*_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM ({_LINEITEM_SQL})"
        for c in _LINEITEM_COLUMNS
    )
)
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_counts(untidy_lineitem(spark, sf))


_TOTAL = " + ".join(f"(count(*) - count({c}))" for c in _LINEITEM_COLUMNS)


@query(
    f"SELECT {_TOTAL} AS missing_before, CAST(0 AS BIGINT) AS missing_after,"
    f" {_TOTAL} AS missing_filled FROM ({_LINEITEM_SQL})"
)
def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = untidy_lineitem(spark, sf)
    return missing.missing_summary(rows, missing.fill_missing_values(rows))


def fill_sql(c: str, strategy: str = "auto") -> str:
    """Aggregate that gives the fill value of a numeric column."""
    if strategy == "mean":
        return f"avg({c})"
    if strategy == "median":
        return f"median({c})"
    return f"CASE WHEN abs(skewness({c})) > 0.75 THEN median({c}) ELSE avg({c}) END"


def mode_sql(source: str, c: str) -> str:
    return (
        f"SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        f" ORDER BY count(*) DESC, {c} LIMIT 1"
    )


def _numeric_fill_sql(strategy: str) -> str:
    cells = ", ".join(
        f"round(coalesce({c}, (SELECT {fill_sql(c, strategy)} FROM src)), 4) AS {c}"
        for c in _FLOATS
    )
    return f"WITH src AS ({_LINEITEM_SQL}) SELECT l_orderkey, l_linenumber, {cells} FROM src"


def _numeric_fill(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    rows = untidy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", *_FLOATS)
    return rounded(missing.fill_missing_values(rows, numeric_strategy=strategy))


@query(_numeric_fill_sql("auto"))
def fill_numeric_auto(spark: SparkSession, sf: str) -> DataFrame:
    return _numeric_fill(spark, sf, "auto")


@query(_numeric_fill_sql("mean"))
def fill_numeric_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _numeric_fill(spark, sf, "mean")


@query(_numeric_fill_sql("median"))
def fill_numeric_median(spark: SparkSession, sf: str) -> DataFrame:
    return _numeric_fill(spark, sf, "median")


@query(
    "SELECT c_custkey, CAST(0 AS DOUBLE) AS number, TIMESTAMP '1970-01-01 00:00:00' AS moment,"
    " FALSE AS flag, 'Unknown' AS word FROM customer"
)
def fill_all_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey < 0 THEN c_acctbal END AS number",
        "CASE WHEN c_custkey < 0 THEN timestamp_ntz'2000-01-01' END AS moment",
        "CASE WHEN c_custkey < 0 THEN true END AS flag",
        "CASE WHEN c_custkey < 0 THEN c_name END AS word",
    )
    return missing.fill_missing_values(rows)


_DATED = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate",
]


@query(
    f"WITH src AS ({sql_view('orders', _DATED)}) SELECT o_orderkey,"
    " coalesce(o_orderdate, (SELECT median(o_orderdate) FROM src)) AS o_orderdate FROM src"
)
def fill_datetime_median(spark: SparkSession, sf: str) -> DataFrame:
    return missing.fill_missing_values(view(spark, sf, "orders", _DATED))


@query(
    f"WITH src AS ({sql_view('orders', _DATED)}) SELECT o_orderkey,"
    f" coalesce(o_orderdate, ({mode_sql('src', 'o_orderdate')})) AS o_orderdate FROM src"
)
def fill_datetime_auto_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Dates repeat a lot, so the automatic choice is the most frequent one."""
    rows = view(spark, sf, "orders", _DATED)
    return missing.fill_missing_values(rows, datetime_strategy="auto")


@query(
    "WITH src AS (SELECT event_id, CASE WHEN event_id % 101 = 3 THEN NULL"
    " ELSE TIMESTAMP '2024-01-01' + to_minutes(CAST(event_id AS INTEGER)) END AS tick FROM events)"
    " SELECT event_id, last_value(tick IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN"
    " UNBOUNDED PRECEDING AND CURRENT ROW) AS tick FROM src"
)
def fill_datetime_auto_forward(spark: SparkSession, sf: str) -> DataFrame:
    """One tick a minute is nearly regular, so gaps repeat the tick before them."""
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 101 = 3 THEN NULL ELSE"
        " timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(event_id AS int)) END AS tick",
    )
    return missing.fill_missing_values(rows, datetime_strategy="auto", order_key="event_id")


@query(
    "WITH src AS (SELECT event_id, CASE WHEN event_id % 101 = 3 THEN NULL"
    " ELSE TIMESTAMP '2024-01-01' + to_milliseconds(CAST(event_id * event_id AS BIGINT)) END AS tick FROM events)"
    " SELECT event_id, coalesce(tick, (SELECT median(tick) FROM src)) AS tick FROM src"
)
def fill_datetime_auto_median(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks that grow apart and never repeat are neither regular nor frequent, so gaps get the median."""
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 101 = 3 THEN NULL ELSE"
        " timestampadd(MILLISECOND, event_id * event_id, timestamp_ntz'2024-01-01') END AS tick",
    )
    return missing.fill_missing_values(rows, datetime_strategy="auto", order_key="event_id")


@query(
    "WITH src AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN NULL"
    " ELSE l_returnflag = 'R' END AS returned FROM lineitem) SELECT l_orderkey, l_linenumber,"
    " coalesce(returned, (SELECT count(*) FILTER (WHERE returned) > count(*) FILTER"
    " (WHERE NOT returned) FROM src)) AS returned FROM src"
)
def fill_bool_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag = 'R' END AS returned",
    )
    return missing.fill_missing_values(rows)


_WORDS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
]


@query(
    f"WITH src AS ({sql_view('orders', _WORDS)}) SELECT o_orderkey, "
    + ", ".join(
        f"coalesce({c}, ({mode_sql('src', c)})) AS {c}" for c in ("o_orderstatus", "o_orderpriority")
    )
    + " FROM src"
)
def fill_string_mode(spark: SparkSession, sf: str) -> DataFrame:
    return missing.fill_missing_values(view(spark, sf, "orders", _WORDS))
