"""The registered queries: complete, deterministic in shape, and free of bad plan shapes."""

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


def test_every_expected_result_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(driver.QUERIES) == set(driver.ORACLES)


def test_flagship(spark):
    result = driver.entry(spark)
    assert result.count() > 0 and "l_quantity" in result.columns


@pytest.mark.parametrize("name", ["dedup_keep_first", "dedup_rows", "outliers_cap", "clean_text"])
def test_plans_have_no_cartesian_product_and_no_window(spark, name):
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Window [" not in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = driver.queries()["dedup_counts"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
