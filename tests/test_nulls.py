"""Nulls, zeros and NaN give defined results, never the bound that they meet."""

import math

import pytest
from pyspark.sql import functions as F

from plumeline.functions import columns
from plumeline.operators import model, pathways, profile, ranks, scoring


def test_bounds_keep_nulls(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS n, 5D AS x").select(
        columns.clamp(F.col("n"), 0, 1), columns.at_least(F.col("n"), 0.0), columns.at_most(F.col("n"), 0.0), columns.at_most(F.col("x"), F.col("n")),
        columns.clamp(F.col("x"), 0, 1), columns.at_least(F.col("x"), 7.0), columns.at_most(F.col("x"), 3.0),
    ).first()
    assert tuple(row) == (None, None, None, None, 1.0, 7.0, 3.0)


def test_points_without_a_condition_have_no_yield(spark):
    rows = [("t", None, 10.0, 3.0), ("p", 300.0, None, 3.0), ("h", 300.0, 10.0, None), ("all", 300.0, 10.0, 3.0)]
    points = spark.createDataFrame(rows, "k string, temperature_c double, pressure_bar double, h2_to_co2 double").selectExpr(
        "*", "'Sabatier (methanation)' AS pathway", "'Ni-based' AS catalyst_family", "'Fixed-bed' AS reactor_type", "450D AS grid_ci_gco2_per_kwh"
    )
    got = {r.k: r for r in scoring.score_points(points).collect()}
    for k in ("t", "p", "h"):
        assert (got[k].yield_pct, got[k].yield_low, got[k].yield_high, got[k].carbon_util_pct) == (None,) * 4
    assert (got["t"].sel_others, got["t"].operating_score, got["all"].yield_pct) == (None, None, 32.1)
    conditions = [F.col(c) for c in ("temperature_c", "pressure_bar", "h2_to_co2")]
    confidence = {r.k: r.c for r in points.select("k", model.confidence(*conditions).alias("c")).collect()}
    assert [confidence[k] for k in ("t", "p", "h")] == [None] * 3 and 0 < confidence["all"] < 1


def test_zero_current_value_gives_null(spark):
    series = spark.createDataFrame([("z", 2000 + i, 0.0) for i in range(12)], "k string, year int, v double")
    scenario = [{"scenario": s, "pathway": s, "target_kind": "percent", "target_amount": 50.0, "target_period": 2015} for s in ("exponential", "linear")]
    rows = pathways.run_scenarios(series, scenario, ["k"], "year", "v").collect()
    assert {(r.commitment, r.gap) for r in rows if r.scenario == "exponential"} == {(None, None)}
    assert {r.commitment for r in rows if r.scenario == "linear"} == {0.0}


def test_profile_of_empty_and_nan_columns(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", math.nan), ("a", None), ("b", math.nan), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = profile.describe(df, ["k"], "x").collect()
    assert len(found) == 1 and (found[0].k, found[0].n, found[0].low, found[0].high, found[0].q50) == ("a", 3, 1.0, 4.0, 2.0)
    assert found[0].mean == pytest.approx(7 / 3) and found[0].std == pytest.approx(math.sqrt(7 / 3))
    assert profile.describe(df.filter("k = 'b'"), ["k"], "x").count() == 0
    assert tuple(profile.describe(df.filter("k = 'b'"), [], "x").first()) == (0, *[None] * 7)
    assert ranks.cumulative_counts(df.limit(0), ["k"], "x").count() == 0
    one = profile.describe(df.limit(1), [], "x").first()
    assert (one.n, one.mean, one.std, one.q25) == (1, 1.0, None, 1.0)


def test_profile_reads_the_table_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS k", "id * 0.5D AS x").write.parquet(str(tmp_path / "t"))
    counted = ranks.counted_values(spark.read.parquet(str(tmp_path / "t")), ["k"], "x")
    plan = profile.describe(spark.read.parquet(str(tmp_path / "t")), ["k"], "x")._jdf.queryExecution().executedPlan().toString()
    assert counted.count() == 1000 and "FileScan" not in plan and "Scan ExistingRDD" in plan
