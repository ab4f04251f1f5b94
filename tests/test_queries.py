import re

import pytest
from oracle import compare, duck

import __spark_entry__ as contract
from plumeline.plans import oracles
from plumeline.plans import queries as named

QUERIES, SQL = named.queries(), oracles.oracle_sql()
MODELS = {"boost_predict", "boost_route"}  # scored by trees in Arrow batches
SLOW = {"gbt_metrics", "gbt_importance", "gbt_predict", "gbt_learning_curve", "gbt_cross_validation", "route_predictions"}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == SLOW | {"arima_search"}


def test_entry(spark, folder):
    assert contract.entry(spark).count() > 0


def plan(df):
    """The plan that ran; call after the rows were collected."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    assert compare(df, con, SQL[name]) == ""
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert name in MODELS or ("Python" not in text and "FlatMapGroups" not in text)


def test_search_covers_every_site(spark, folder):
    rows = QUERIES["arima_search"](spark, folder).groupBy("site").count().collect()
    assert {r["count"] for r in rows} == {named.HORIZON} and len(rows) == 10


def test_split_covers_every_row(spark, folder):
    sizes = {r.is_train: r.n_rows for r in QUERIES["holdout_split"](spark, folder).collect()}
    assert sum(sizes.values()) == spark.read.parquet(f"{folder}/orders.parquet").count()


def ran(spark, folder, name):
    df = QUERIES[name](spark, folder)
    df.collect()
    return plan(df)


def test_forecast_shuffles_a_series_once(spark, folder):
    text = ran(spark, folder, "forecast_best")
    assert len(re.findall("Exchange hashpartitioning", text)) == 2  # the sum by period, then the series


def test_grid_rows_are_not_shuffled(spark, folder):
    text = ran(spark, folder, "grid_best_per_unit")
    above = text[: text.index("Generate explode")]
    assert "Exchange hashpartitioning" not in above


def test_scan_reads_only_needed_columns(spark, folder):
    text = ran(spark, folder, "forecast_best")
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp" in text
