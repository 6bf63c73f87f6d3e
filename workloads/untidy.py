"""Untidy input: text after dates, long integers, rows a model has not seen, decimals, codes, bad files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.errors import WashlineError
from washline.operators import columns as ops
from washline.operators import formats, missing, outliers, validate
from washline.operators.dedup import remove_duplicates
from washline.plans.cleaning import clean_data, dataset_kind, fit, run_cleaning
from washline.plans.config import CleaningConfig
from washline.plans.jobs import clean_file
from washline.sources.files import job_output, read_data, write_data
from washline.streaming.streams import clean_stream, read_stream, write_stream
from workloads.registry import query
from workloads.values import bounds_sql, capped_sql, fill_sql, mode_sql, rounded
from workloads.views import scratch, table

# ------------------------------------------------------------------ dates and integers


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority AS note,"
    " CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' EST'"
    " ELSE strftime(o_orderdate, '%d %b %Y') || ' late' END AS remark FROM orders"
)
def text_after_date(spark: SparkSession, sf: str) -> DataFrame:
    """Text that only begins with a date stays text."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' ', o_orderpriority)").alias("note"),
        F.expr(
            "CASE WHEN o_orderkey % 2 = 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' EST')"
            " ELSE concat(date_format(o_orderdate, 'dd MMM yyyy'), ' late') END"
        ).alias("remark"),
    )
    return formats.standardize_formats(rows)


@query("SELECT o_orderkey, o_orderdate, o_orderdate AS shipped FROM orders")
def rare_date_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Six digits, time before the year, and long blanks before a time of day."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("date_format(o_orderdate, 'MMddyy')").alias("o_orderdate"),
        F.expr(
            "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'EEE MMM  d HH:mm:ss yyyy')"
            " ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), repeat(' ', 60), '00:00') END"
        ).alias("shipped"),
    )
    return formats.standardize_formats(rows)


_BIG = 1750000000000000000


@query(f"SELECT o_orderkey + {_BIG} AS id, o_custkey FROM orders")
def csv_big_integers(spark: SparkSession, sf: str) -> DataFrame:
    """19-digit ids come back from CSV digit by digit."""
    path = scratch(spark, "ids.csv")
    write_data(table(spark, sf, "orders").select((F.col("o_orderkey") + _BIG).alias("id"), "o_custkey"), path)
    return read_data(spark, path)


@query(
    """
    SELECT 'loaded' AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL
    SELECT 'longer than the header', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 7 = 0
    """
)
def csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a cell too many are put aside as they stand, the others are loaded."""
    path, side = scratch(spark, "orders.csv"), scratch(spark, "bad")
    line = "CASE WHEN o_orderkey % 7 = 0 THEN concat_ws(',', o_orderkey, o_custkey, 'more') ELSE concat_ws(',', o_orderkey, o_custkey) END"
    lines = table(spark, sf, "orders").selectExpr(f"{line} AS value")
    # Each file has a header: the first line of a task.
    header = F.explode(F.when(F.monotonically_increasing_id() % (1 << 33) == 0, F.array(F.lit("key,customer"), "value")).otherwise(F.array("value")))
    lines.select(header.alias("value")).write.text(path)
    good, bad = read_data(spark, path, quarantine=side), spark.read.parquet(side)
    key = F.regexp_extract("record", "^[0-9]+", 0).cast("bigint")
    parts = good.select(F.lit("loaded").alias("part"), F.col("key")).unionAll(bad.select("reason", key))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderkey + {_BIG} END AS id FROM orders")
def parse_big_integers(spark: SparkSession, sf: str) -> DataFrame:
    """19-digit ids printed as text, some unreadable: no digit is rounded."""
    text = f"CASE WHEN o_orderkey % 20 = 0 THEN '?' ELSE cast(o_orderkey + {_BIG} AS string) END"
    return formats.standardize_formats(table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("id")))


@query("SELECT count(*) AS rows_kept FROM orders")
def clean_big_integers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ in the last digit of an id are no duplicates."""
    path = scratch(spark, "ids.csv")
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") + _BIG).alias("id"), "o_orderstatus")
    write_data(rows, path)
    cleaned, _ = clean_data(read_data(spark, path), outliers=None)
    return cleaned.agg(F.count("*").alias("rows_kept"))


# ------------------------------------------------------------------ rows not seen before

_SEEN = "SELECT o_orderkey, o_totalprice, lower(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 0"
_NEW = (
    "CASE WHEN o_orderkey % 10 = 1 THEN NULL WHEN o_orderkey % 10 = 3 THEN o_totalprice * 1000 ELSE o_totalprice END",
    "CASE WHEN o_orderkey % 10 = 5 THEN 'ﬁＡ' WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_orderstatus END",
)
_NEW_ROWS_SQL = (
    f"WITH src AS ({_SEEN}), b_o_totalprice AS ({bounds_sql('src', 'o_totalprice')})"
    f", capped AS (SELECT {capped_sql('o_totalprice', 'b_o_totalprice')} AS o_totalprice FROM src, b_o_totalprice)"
    f", new AS (SELECT o_orderkey, {_NEW[0]} AS o_totalprice, {_NEW[1]} AS status FROM orders WHERE o_orderkey % 2 = 1)"
    f" SELECT o_orderkey, round(coalesce({capped_sql('o_totalprice', 'b_o_totalprice')},"
    f" (SELECT {fill_sql('o_totalprice')} FROM capped)), 4) AS o_totalprice,"
    f" CASE WHEN o_orderkey % 10 = 5 THEN 'fia' ELSE coalesce(lower(status), ({mode_sql('src', 'status')})) END AS status"
    " FROM new, b_o_totalprice"
)


def _seen_and_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    # Tidy rows teach the model, untidy ones follow: no gap, spike or wide character was seen before.
    seen = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"))
    new = orders.where("o_orderkey % 2 = 1").select(
        "o_orderkey", F.expr(_NEW[0]).alias("o_totalprice"), F.expr(_NEW[1]).alias("status")
    )
    return seen, new


@query(_NEW_ROWS_SQL)
def model_on_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on tidy rows normalises, caps and fills rows it has not seen."""
    seen, new = _seen_and_new(spark, sf)
    return rounded(fit(seen).transform(new))


@query(_NEW_ROWS_SQL)
def stream_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a file stream of new rows."""
    seen, new = _seen_and_new(spark, sf)
    arrivals, target = scratch(spark, "arrivals"), scratch(spark, "cleaned")
    new.write.parquet(arrivals)
    stream = clean_stream(read_stream(spark, arrivals, new.schema), fit(seen))
    write_stream(stream, target, scratch(spark, "progress"), once=True).awaitTermination()
    return rounded(spark.read.parquet(target))


# ------------------------------------------------------------------ types that stay

_DECIMAL = "CAST(CASE WHEN l_linenumber = 2 THEN NULL WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS decimal(20,2))"


def _decimals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_DECIMAL).alias("price"))


def _described(df: DataFrame) -> DataFrame:
    """The type of the column stands beside its values."""
    return df.select(
        "l_orderkey", "l_linenumber", F.col("price").cast("double").alias("price"), F.lit(dict(df.dtypes)["price"]).alias("dtype")
    )


@query(
    f"WITH src AS (SELECT l_orderkey, l_linenumber, {_DECIMAL} AS price FROM lineitem), f AS (SELECT"
    " CASE WHEN abs(skewness(CAST(price AS DOUBLE))) > 0.75 THEN median(CAST(price AS DOUBLE))"
    " ELSE avg(CAST(price AS DOUBLE)) END AS v FROM src)"
    " SELECT l_orderkey, l_linenumber, CAST(coalesce(price, CAST(v AS decimal(20,2))) AS DOUBLE) AS price,"
    " 'decimal(20,2)' AS dtype FROM src, f"
)
def fill_decimal(spark: SparkSession, sf: str) -> DataFrame:
    return _described(missing.fill_missing_values(_decimals(spark, sf)))


@query(
    f"WITH src AS (SELECT l_orderkey, l_linenumber, {_DECIMAL} AS price FROM lineitem),"
    " wide AS (SELECT CAST(price AS DOUBLE) AS price FROM src),"
    f" b AS ({bounds_sql('wide', 'price')})"
    " SELECT l_orderkey, l_linenumber, CASE WHEN CAST(price AS DOUBLE) < lo THEN CAST(CAST(lo AS decimal(20,2)) AS DOUBLE)"
    " WHEN CAST(price AS DOUBLE) > hi THEN CAST(CAST(hi AS decimal(20,2)) AS DOUBLE) ELSE CAST(price AS DOUBLE) END AS price,"
    " 'decimal(20,2)' AS dtype FROM src, b"
)
def cap_decimal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _decimals(spark, sf)
    bounds = {"price": outliers.fit_caps(rows.select("price")).get("price")}
    return _described(outliers.apply_caps(rows, {c: b for c, b in bounds.items() if b}))


@query(
    "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 10 WHEN 2 THEN 12 ELSE n_regionkey END AS region_code,"
    " CASE n_regionkey WHEN 1 THEN 'america' WHEN 3 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS region_name"
    " FROM nation"
)
def categorical_map_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes in whole-number columns are mapped like any value; new text makes the column text."""
    rows = table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_regionkey").alias("region_code"), F.col("n_regionkey").alias("region_name")
    )
    inline = ops.normalize_categorical_text(rows, {"region_code": {0: 10, 2: 12, "x": 1}})
    return ops.normalize_categorical_text(inline, {"region_name": {1: "america", 3: None}}, inline_limit=0)


# ------------------------------------------------------------------ files, guards, logs


@query("SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS \"name.1\" FROM supplier")
def csv_duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    """A header that names a column twice."""
    path = scratch(spark, "twice.csv")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.toDF("id", "name", "name ").write.option("header", True).option("quoteAll", False).csv(path)
    text = spark.read.text(path)
    again = scratch(spark, "again.csv")
    text.select(F.regexp_replace("value", '^id,name,"?name ?"?$', "id,name,name").alias("value")).write.text(again)
    return read_data(spark, again, "csv")


def _error_of(action) -> str:
    try:
        action()
    except (WashlineError, ValueError, FileNotFoundError) as error:
        return type(error).__name__
    return "none"


@query(
    "SELECT check_name, outcome, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES ('empty_table', 'InvalidInputError'),"
    " ('missing_path', 'FileNotFoundError'), ('unknown_format', 'DataLoadError'), ('different_headers', 'DataLoadError'),"
    " ('unknown_subset', 'ValueError'), ('unknown_method', 'InvalidInputError'), ('bad_mapping', 'ValidationError'),"
    " ('bad_spec', 'ValidationError'), ('good_table', 'none')) AS t(check_name, outcome)"
)
def guards(spark: SparkSession, sf: str) -> DataFrame:
    """What refuses bad input, tried on the orders."""
    orders = table(spark, sf, "orders")
    mixed = scratch(spark, "mixed.csv")
    orders.select("o_orderkey", "o_custkey").write.option("header", True).csv(mixed)
    orders.select("o_custkey", "o_orderkey").write.mode("append").option("header", True).csv(mixed)
    tried = {
        "empty_table": lambda: run_cleaning(orders.where("o_orderkey < 0"), complete=False),
        "missing_path": lambda: read_data(spark, f"{sf}/no_such_table.parquet"),
        "unknown_format": lambda: write_data(orders, scratch(spark, "orders.xyz")),
        "different_headers": lambda: read_data(spark, mixed),
        "unknown_subset": lambda: remove_duplicates(orders, ["no_such_column"], order_key="o_orderkey"),
        "unknown_method": lambda: outliers.handle_outliers(orders, "shrink"),
        "bad_mapping": lambda: run_cleaning(orders, CleaningConfig(categorical_mapping={"o_orderstatus": "x"})),
        "bad_spec": lambda: validate.validation_report(orders, {"columns": {"o_orderkey": {"dtype": "whole"}}}),
        "good_table": lambda: validate.validation_report(orders, {"columns": {"o_orderkey": {"dtype": "int"}}}),
    }
    rows = [(name, _error_of(action)) for name, action in tried.items()]
    return spark.createDataFrame(rows, "check_name string, outcome string").crossJoin(
        F.broadcast(orders.agg(F.count("*").alias("n_rows")))
    )


@query(
    "SELECT 'fixed' AS \"column\", CAST(NULL AS VARCHAR) AS method, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,"
    " CAST(0 AS BIGINT) AS outliers, (SELECT count(*) FROM part) AS n_rows"
)
def outlier_constant(spark: SparkSession, sf: str) -> DataFrame:
    """A constant column has no bounds, whatever its size."""
    rows = table(spark, sf, "part").select((F.col("p_partkey") * 0 + 7).alias("fixed"))
    return outliers.outlier_report(rows).select("column", "method", "low", "high", "outliers").withColumn(
        "n_rows", F.lit(rows.count()).cast("long")
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def validate_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """Validation counts violations and leaves the table as it is."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    spec = {"columns": {"o_orderstatus": {"dtype": "str", "checks": [{"isin": ["O", 1]}]}, "o_custkey": {"dtype": "int"}}}
    validate.validation_report(rows, spec).count()
    return rows


@query(
    "SELECT step, TRUE AS timed FROM (VALUES ('remove_duplicates'), ('normalize_columns'), ('clean_text'),"
    " ('standardize_formats'), ('handle_outliers'), ('fill_missing')) AS t(step)"
)
def clean_step_times(spark: SparkSession, sf: str) -> DataFrame:
    """Every step of a profiled run has a time."""
    _, summary = clean_data(table(spark, sf, "customer"), profile=True)
    steps = summary["profiling"]["steps"]
    return spark.createDataFrame([(s, ms >= 0) for s, ms in steps.items()], "step string, timed boolean")


@query(
    "SELECT lower(s_name) AS s_name, CAST(s_suppkey AS BIGINT) AS s_suppkey, 'parquet' AS kind FROM supplier"
)
def clean_to_job_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Default output name of a file, then the folder of a job, by suffix."""
    source = scratch(spark, "supplier.parquet")
    write_data(table(spark, sf, "supplier").select("s_suppkey", "s_name"), source)
    clean_file(spark, source, config=CleaningConfig(outliers=None))
    cleaned = read_data(spark, source.replace("supplier.parquet", "supplier_cleaned.parquet"))
    target = job_output(scratch(spark, "store"), "jobs/7", "jobs", "cleaned.parquet")
    write_data(cleaned, target)
    return read_data(spark, target).withColumn("kind", F.lit(dataset_kind(target)))
