"""Profiles, validation, suggestions, whole cleaning runs, run history and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.operators import history, profile, suggestions, validate
from washline.plans.cleaning import fit, run_cleaning, summary_frame
from washline.plans.config import CleaningConfig
from washline.streaming.streams import clean_stream, read_stream, write_stream
from workloads.registry import query
from workloads.values import (
    bounds_sql,
    capped_sql,
    fill_sql,
    mode_sql,
    remove_sql,
    rounded,
    untidy_lineitem,
)
from workloads.views import CUSTOMER, LINEITEM, scratch, sql_view, table, view

_LINEITEM_SQL = sql_view("lineitem", LINEITEM)
_CUSTOMER_SQL = sql_view("customer", CUSTOMER)
_CUSTOMER_TYPES = {
    "c_custkey": "bigint",
    "c_name": "string",
    "c_nationkey": "int",
    "c_code": "string",
    "c_acctbal": "double",
    "c_mktsegment": "string",
}
_CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


def untidy_customer(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "customer", CUSTOMER)


def _each(columns, form: str) -> str:
    return " UNION ALL ".join(form.format(c=c) for c in columns)


# ----------------------------------------------------------------------- profiles


@query(
    _each(
        _CUSTOMER_TYPES,
        "SELECT '{c}' AS \"column\", round(100.0 * (count(*) - count({c})) / count(*), 4)"
        f" AS missing_pct FROM ({_CUSTOMER_SQL})",
    )
)
def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.profile_missing(untidy_customer(spark, sf)))


@query(
    "SELECT * FROM ("
    + _each(
        _CUSTOMER_TYPES,
        "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct"
        f" FROM ({_CUSTOMER_SQL})",
    )
    + ") WHERE n_distinct <= 50"
)
def profile_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_cardinality(untidy_customer(spark, sf))


_NUMBERS_FORM = (
    "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,"
    " CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,"
    " round(median({c}), 4) AS median"
)


@query(
    _each(
        [
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax",
        ],
        f"SELECT '{{c}}' AS \"column\", {_NUMBERS_FORM} FROM ({_LINEITEM_SQL})",
    )
)
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.profile_numeric(untidy_lineitem(spark, sf)))


def _profile_sql() -> str:
    parts = []
    for c, dtype in _CUSTOMER_TYPES.items():
        numbers = (
            _NUMBERS_FORM.format(c=c)
            if c in _CUSTOMER_NUMBERS
            else ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("mean", "std", "min", "max", "median"))
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype,"
            f" round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct,"
            f" CASE WHEN count(DISTINCT {c}) <= 50 THEN count(DISTINCT {c}) END AS n_distinct,"
            f" {numbers} FROM ({_CUSTOMER_SQL})"
        )
    return " UNION ALL ".join(parts)


@query(_profile_sql())
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.profile_table(untidy_customer(spark, sf)))


@query(
    "SELECT 'parquet' AS dataset_kind, CAST(6 AS BIGINT) AS columns,"
    " round(100.0 * (count(*) - count(c_name)) / count(*), 4) AS name_missing_pct,"
    " CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS segments,"
    " round(median(c_acctbal), 4) AS balance_median,"
    " least(count(*), 50) AS sample_size, CAST(min(c_custkey) AS VARCHAR) AS first_key"
    f" FROM ({_CUSTOMER_SQL})"
)
def profile_document(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON document, read back field by field."""
    document = profile.profile_document(
        untidy_customer(spark, sf), {"columns": len(CUSTOMER)}, "parquet", "c_custkey"
    )

    def at(path: str):
        return F.get_json_object("profile", f"$.{path}")

    return document.select(
        at("dataset_kind").alias("dataset_kind"),
        at("summary.columns").cast("bigint").alias("columns"),
        F.round(at("missing_pct.c_name").cast("double"), 4).alias("name_missing_pct"),
        at("small_cardinality.c_mktsegment").cast("bigint").alias("segments"),
        F.round(at("numeric_stats.c_acctbal.median").cast("double"), 4).alias("balance_median"),
        F.json_array_length(at("sample_rows")).cast("bigint").alias("sample_size"),
        at("sample_rows[0].c_custkey").alias("first_key"),
    )


# --------------------------------------------------------------------- validation

SPEC = {
    "name": "customers",
    "columns": {
        "c_custkey": {"dtype": "int"},
        "c_name": {"dtype": "str", "checks": [{"regex": "Customer#0+[1-4]"}]},
        "c_nationkey": {"dtype": "int", "checks": [{"in_range": {"min": 0, "max": 24}}]},
        "c_code": {"dtype": "int"},
        "c_acctbal": {
            "dtype": "float",
            "nullable": True,
            "checks": [{"in_range": {"min": 0.0, "max": 9000.0}}],
        },
        "c_mktsegment": {
            "dtype": "str",
            "checks": [{"isin": ["AUTOMOBILE", "BUILDING", "MACHINERY"]}],
        },
        "c_phone": {"dtype": "str"},
        "c_comment": {"dtype": "str", "required": False},
    },
}

# Rule number, column, check and violation in SQL, in the order of the spec.
_RULES = [
    ("c_custkey", "dtype(int)", "FALSE"),
    ("c_custkey", "not_nullable", "c_custkey IS NULL"),
    ("c_name", "dtype(str)", "FALSE"),
    ("c_name", "not_nullable", "c_name IS NULL"),
    ("c_name", "str_matches('Customer#0+[1-4]')", "NOT regexp_matches(c_name, '^Customer#0+[1-4]')"),
    ("c_nationkey", "dtype(int)", "FALSE"),
    ("c_nationkey", "not_nullable", "c_nationkey IS NULL"),
    ("c_nationkey", "in_range(0, 24)", "c_nationkey < 0 OR c_nationkey > 24"),
    ("c_code", "dtype(int)", "c_code = 'n.a.'"),
    ("c_code", "not_nullable", "c_code IS NULL"),
    ("c_acctbal", "dtype(float)", "FALSE"),
    ("c_acctbal", "in_range(0.0, 9000.0)", "c_acctbal < 0 OR c_acctbal > 9000"),
    ("c_mktsegment", "dtype(str)", "FALSE"),
    ("c_mktsegment", "not_nullable", "c_mktsegment IS NULL"),
    (
        "c_mktsegment",
        "isin(['AUTOMOBILE', 'BUILDING', 'MACHINERY'])",
        "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')",
    ),
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules_sql(form: str) -> str:
    return " UNION ALL ".join(
        form.format(i=i, c=c, column=_quote(c), check=_quote(check), test=test)
        for i, (c, check, test) in enumerate(_RULES)
    )


@query(
    _rules_sql(
        "SELECT CAST({i} AS INTEGER) AS rule, {column} AS \"column\", {check} AS \"check\","
        f" count(*) FILTER (WHERE {{test}}) AS n_failed FROM ({_CUSTOMER_SQL})"
    )
    + f" UNION ALL SELECT CAST({len(_RULES)} AS INTEGER), 'c_phone', 'required', CAST(1 AS BIGINT)"
)
def validate_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validation_report(untidy_customer(spark, sf), SPEC)


def _single(column: str, nullable: bool = True, **changes: object) -> dict:
    return {"columns": {column: {**SPEC["columns"][column], "nullable": nullable, **changes}}}


def _register_single(name: str, spec: dict, rules: list[int]) -> None:
    sql = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS rule, {_quote(_RULES[r][0])} AS \"column\","
        f" {_quote(_RULES[r][1])} AS \"check\", count(*) FILTER (WHERE {_RULES[r][2]}) AS n_failed"
        f" FROM ({_CUSTOMER_SQL})"
        for i, r in enumerate(rules)
    )
    query(sql, name)(
        lambda spark, sf: validate.validation_report(untidy_customer(spark, sf), spec)
    )


_register_single("validate_types", _single("c_code"), [8])
_register_single("validate_nulls", _single("c_name", False, checks=[]), [2, 3])
_register_single("validate_range", _single("c_nationkey"), [5, 7])
_register_single("validate_isin", _single("c_mktsegment"), [12, 14])
_register_single("validate_regex", _single("c_name"), [2, 4])


_CASES_FORM = (
    "SELECT CAST({i} AS INTEGER) AS rule, {column} AS \"column\", {check} AS \"check\","
    f" CAST({{c}} AS VARCHAR) AS failure_case FROM ({_CUSTOMER_SQL}) WHERE {{test}}"
)


@query(
    _rules_sql(_CASES_FORM)
    + f" UNION ALL SELECT CAST({len(_RULES)} AS INTEGER), 'c_phone', 'required', 'c_phone'"
)
def validate_cases(spark: SparkSession, sf: str) -> DataFrame:
    return validate.failure_cases(untidy_customer(spark, sf), SPEC)


@query(
    "SELECT CAST(3 AS INTEGER) AS rule, 'c_name' AS \"column\", 'not_nullable' AS \"check\","
    " CAST(NULL AS VARCHAR) AS failure_case FROM (SELECT * FROM customer"
    " WHERE c_custkey % 5 = 0 ORDER BY c_custkey LIMIT 3)"
)
def validate_first_cases(spark: SparkSession, sf: str) -> DataFrame:
    return validate.failure_cases(
        untidy_customer(spark, sf), SPEC, limit=3, order_key="c_custkey"
    )


# -------------------------------------------------------------------- suggestions

# Model answers as text, made from the labels: fenced, bare, broken and list-shaped ones.
ANSWER = (
    "CASE doc_id % 4"
    " WHEN 0 THEN concat('```json', chr(10), '{\"suggestions\":[{\"category\":\"',"
    " CASE WHEN quality = 1 THEN 'Schema' ELSE 'odd' END, '\",\"severity\":\"CRITICAL\",\"message\":',"
    " '\" check \",\"column\":\"text\",\"evidence\":{\"toxic\":', cast(toxic AS string), '}}]}', chr(10), '```')"
    " WHEN 1 THEN concat('[{\"message\":\"first\"},', cast(doc_id AS string),"
    " ',{\"message\":\"  \"},{\"message\":\"third\",\"severity\":\"warning\",\"column\":\" \",\"evidence\":[1]}]')"
    " WHEN 2 THEN '{not valid json'"
    " ELSE '{\"answers\":[]}' END"
)


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select("doc_id", F.expr(ANSWER).alias("answer"))
    return suggestions.parse_suggestions(rows, "answer", ["doc_id"])


_SUGGESTIONS_SQL = (
    "SELECT doc_id, CAST(0 AS INTEGER) AS position,"
    " CASE WHEN quality = 1 THEN 'schema' ELSE 'quality' END AS category, 'critical' AS severity,"
    " 'check' AS message, 'text' AS \"column\", '{\"toxic\":' || toxic || '}' AS evidence"
    " FROM labels WHERE doc_id % 4 = 0"
    " UNION ALL SELECT doc_id, 0, 'quality', 'info', 'first', NULL, NULL FROM labels"
    " WHERE doc_id % 4 = 1"
    " UNION ALL SELECT doc_id, 3, 'quality', 'warning', 'third', NULL, NULL FROM labels"
    " WHERE doc_id % 4 = 1"
)


@query(_SUGGESTIONS_SQL)
def suggestions_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf)


@query(
    f"SELECT category, count(*) AS suggestions FROM ({_SUGGESTIONS_SQL}) GROUP BY category"
)
def suggestions_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return suggestions.suggestions_by_category(_answers(spark, sf))


# ------------------------------------------------------------------ cleaning runs


def _untidy_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders twice over, with odd names, printed prices and dates, noise and gaps."""
    once = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS `O OrderKey`",
        "CASE o_orderstatus WHEN 'F' THEN 'null' ELSE concat('  ', o_orderstatus, ' ') END"
        " AS `Order-Status`",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN"
        " concat('$', format_number(o_totalprice * 20, 2)) ELSE"
        " concat('$', format_number(o_totalprice, 2)) END AS `Total  Price`",
        "date_format(o_orderdate, 'M/d/yyyy') AS `o_orderdate `",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS Priority",
    )
    return once.unionAll(once)


_ORDERS_BASE = (
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL ELSE lower(o_orderstatus) END"
    " AS order_status, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN"
    " round(o_totalprice * 20, 2) ELSE o_totalprice END AS total_price, o_orderdate,"
    " CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lower(o_orderpriority) END AS priority"
    " FROM orders"
)
_CLEAN_CTES = (
    f"WITH src AS ({_ORDERS_BASE}), b AS ({bounds_sql('src', 'total_price')}),"
    f" capped AS (SELECT src.* REPLACE ({capped_sql('total_price', 'b')} AS total_price)"
    " FROM src, b)"
)


@query(
    f"{_CLEAN_CTES} SELECT o_orderkey,"
    f" coalesce(order_status, ({mode_sql('src', 'order_status')})) AS order_status,"
    f" round(coalesce(total_price, (SELECT {fill_sql('total_price')} FROM capped)), 4)"
    " AS total_price, o_orderdate,"
    f" coalesce(priority, ({mode_sql('src', 'priority')})) AS priority FROM capped"
)
def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    """All six steps: duplicates, names, text, formats, caps, fills."""
    return rounded(run_cleaning(_untidy_orders(spark, sf), complete=False).table)


@query(
    f"SELECT count(*) AS \"rows\", CAST(5 AS BIGINT) AS \"columns\", count(*) AS duplicates_removed,"
    " CAST(0 AS BIGINT) AS outliers_handled, (count(*) - count(order_status)) + (count(*) -"
    " count(total_price)) + (count(*) - count(priority)) AS missing_filled,"
    " CAST(3 AS BIGINT) AS columns_standardized, CAST(4 AS BIGINT) AS text_unconverted"
    f" FROM ({_ORDERS_BASE})"
)
def clean_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary_frame(spark, run_cleaning(_untidy_orders(spark, sf), complete=False).summary).drop("duration")


def _steps_sql() -> str:
    gaps = (
        "(count(*) - count(order_status)) + (count(*) - count(total_price))"
        " + (count(*) - count(priority))"
    )
    rows = [
        ("remove_duplicates", "2 * count(*)", "done", "duplicates_removed", "count(*)"),
        ("normalize_columns", "count(*)", "done", "columns_after", "5"),
        ("clean_text", "count(*)", "done", "text_columns", "4"),
        ("standardize_formats", "count(*)", "done", "columns_standardized", "3"),
        ("handle_outliers", "count(*)", "skipped", "outliers_handled", "0"),
        ("fill_missing", "count(*)", "done", "missing_filled", gaps),
    ]
    return " UNION ALL ".join(
        f"SELECT '{step}' AS step, CAST({before} AS BIGINT) AS rows_before, count(*) AS rows_after,"
        f" '{status}' AS status, '{name}' AS counter, CAST({value} AS BIGINT) AS n"
        f" FROM ({_ORDERS_BASE})"
        for step, before, status, name, value in rows
    )


@query(_steps_sql())
def clean_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The step log of a run without outlier handling, one counter per step."""
    log = run_cleaning(_untidy_orders(spark, sf), CleaningConfig(outliers=None), complete=False).log
    shown = [
        "duplicates_removed", "columns_after", "text_columns", "columns_standardized",
        "outliers_handled", "missing_filled",
    ]
    return (
        log.as_frame(spark)
        .select("step", "rows_before", "rows_after", "status", F.explode("counts").alias("counter", "n"))
        .where(F.col("counter").isin(shown))
    )


_STAGES_SQL = (
    "WITH src AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,"
    f" l_extendedprice, l_discount, l_tax FROM ({_LINEITEM_SQL})),"
    + ", ".join(
        f" b_{c} AS ({bounds_sql('src', c)})"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + ", capped AS (SELECT src.* REPLACE ("
    + ", ".join(
        f"{capped_sql(c, f'b_{c}')} AS {c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + ") FROM src, b_l_quantity, b_l_extendedprice, b_l_discount, b_l_tax)"
    + " SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(
        f"round(coalesce({c}, (SELECT {fill_sql(c)} FROM capped)), 4) AS {c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + " FROM capped"
)
_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


@query(_STAGES_SQL)
def clean_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates, caps and fills over the largest table."""
    return rounded(run_cleaning(untidy_lineitem(spark, sf).select(*_NUMBERS), complete=False).table)


_REMAINING = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    f"{remove_sql(_LINEITEM_SQL, _NUMBERS, last='kept')} SELECT l_orderkey, l_partkey, l_suppkey,"
    " l_linenumber, l_discount, "
    + ", ".join(
        f"round(coalesce({c}, (SELECT {fill_sql(c)} FROM kept)), 4) AS {c}" for c in _REMAINING
    )
    + f", coalesce(l_returnflag, ({mode_sql('kept', 'l_returnflag')})) AS l_returnflag FROM kept"
)
def clean_lineitem_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with outliers go, and the fills come from the rows that remain."""
    rows = untidy_lineitem(spark, sf).select(*_NUMBERS, "l_returnflag")
    run = run_cleaning(rows, CleaningConfig(outliers="remove", clean_text=False), complete=False)
    return rounded(run.table)


@query(_STAGES_SQL.replace("SELECT DISTINCT", "SELECT", 1))
def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on the batch table cleans the same rows arriving as a file stream."""
    rows = untidy_lineitem(spark, sf).select(*_NUMBERS)
    model = fit(rows, CleaningConfig(normalize_cols=False))
    arrivals, target = scratch(spark, "arrivals"), scratch(spark, "cleaned")
    rows.write.parquet(arrivals)
    stream = clean_stream(read_stream(spark, arrivals, rows.schema), model)
    write_stream(stream, target, scratch(spark, "progress"), once=True).awaitTermination()
    return rounded(spark.read.parquet(target))


# -------------------------------------------------------------------- run history

_OK = "event_type <> 'error'"
_HOUR = "date_trunc('hour', ts)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn(
        "status", F.when(F.expr(_OK), "success").otherwise("failure")
    )


@query(
    f"SELECT {_HOUR} AS window_start, CASE WHEN {_OK} THEN 'success' ELSE 'failure' END AS status,"
    " count(*) AS runs, round(count(*) / 3600.0, 6) AS runs_per_second FROM events GROUP BY 1, 2"
)
def history_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.run_counts(_runs(spark, sf), "ts", "status"), 6)


_LATENCY_SQL = (
    f"SELECT {_HOUR} AS window_start, round(avg(value), 4) AS avg_duration,"
    " round(quantile_cont(value, 0.95), 4) AS p95_duration FROM events GROUP BY 1"
)


@query(_LATENCY_SQL)
def history_latency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.latency(_runs(spark, sf), "ts", "value"))


@query(
    "SELECT date_trunc('day', ts) AS window_start, count(value) AS runs, round(avg(value), 4) AS avg_duration,"
    " TRUE AS within FROM events GROUP BY 1"
)
def history_latency_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of hours merged to days; ``within``: the share of runs below the percentile is 0.95, give or take 0.01."""
    runs = _runs(spark, sf)
    days = history.sketched_latency(history.merged_sketches(history.latency_sketches(runs, "ts", "value"), "1 day"))
    found = runs.select(F.window("ts", "1 day")["start"].alias("window_start"), "value").join(days, "window_start")
    share = lambda test: F.count_if(test) / F.count("value")
    below, up_to = share(F.col("value") < F.col("p95_duration")), share(F.col("value") <= F.col("p95_duration"))
    checked = found.groupBy("window_start", "runs", "avg_duration").agg(
        ((below <= 0.96) & (up_to >= 0.94)).alias("within")
    )
    return rounded(checked)


@query(
    "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS quantile FROM events GROUP BY 1"
)
def grouped_quantile_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """The route of groups too large for a buffer, forced for every group."""
    from washline.operators.statistics import grouped_quantile

    return rounded(
        grouped_quantile(_runs(spark, sf), ["event_type"], "value", 0.95, small_rows=0).drop("mean")
    )


@query(
    f"SELECT {_HOUR} AS window_start, CAST(sum(user_id) AS BIGINT) AS total_user_id,"
    " round(sum(value), 4) AS total_value FROM events GROUP BY 1"
)
def history_sums(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.sums(_runs(spark, sf), "ts", ["user_id", "value"]))


@query("SELECT CAST(sum(user_id) AS BIGINT) AS total_user_id FROM events")
def history_total(spark: SparkSession, sf: str) -> DataFrame:
    return history.totals(_runs(spark, sf), ["user_id"])


@query(
    f"SELECT {_HOUR} AS window_start, event_type AS category, round(sum(value), 4) AS total_value"
    f" FROM events WHERE {_OK} GROUP BY 1, 2"
)
def history_by_category(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    return rounded(history.by_category(runs, "ts", "event_type", "value", F.expr(_OK)))


@query(
    f"SELECT {_HOUR} AS window_start, count(*) AS runs,"
    f" round(100.0 * count(*) FILTER (WHERE {_OK}) / count(*), 4) AS success_pct"
    " FROM events GROUP BY 1"
)
def history_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.success_rate(_runs(spark, sf), "ts", F.expr(_OK)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return clean_lineitem(spark, sf)


