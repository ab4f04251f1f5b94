import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import sketches
from plumeline.sources import sinks


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{i % 3}", i % 10, int(rng.integers(0, 4000)), float(rng.normal()) if i % 40 else None) for i in range(30_000)]
    return spark.createDataFrame(rows, "k string, day int, who int, x double")


def test_merged_states_keep_their_bounds(spark, days, tmp_path):
    path, shares = str(tmp_path / "states"), {"q05": 0.05, "q50": 0.5, "q99": 0.99}
    for part in (days.where("day < 6"), days.where("day >= 6")):
        sketches.store(sketches.states(part, ["k", "day"], "who", "x"), path, "day")
    before = {(r.k, r.day): bytes(r.number_state) for r in sketches.stored(spark, path).collect()}
    sketches.store(sketches.states(days.where("day = 3"), ["k", "day"], "who", "x"), path, "day")  # a day is delivered again
    after = {(r.k, r.day): bytes(r.number_state) for r in sketches.stored(spark, path).collect()}
    assert len(after) == 30 and {k for k in after if after[k] != before[k]} <= {(f"k{i}", 3) for i in range(3)}
    whole = sketches.merged(sketches.stored(spark, path), ["k"])
    found = sketches.held_against(days, sketches.estimates(whole, ["k"], shares), ["k"], "who", "x", shares).collect()
    assert [(r.distinct_ok, r.quantiles_ok) for r in found] == [(True, True)] * 3
    assert {r.k: r.n for r in found} == {r.k: r.n for r in days.groupBy("k").agg(F.count("x").alias("n")).collect()}


def test_union_of_parts_equals_the_whole(days):
    whole = sketches.estimates(sketches.states(days, ["k"], "who", "x"), ["k"], {"q50": 0.5})
    parts = sketches.estimates(sketches.merged(sketches.states(days, ["k", "day"], "who", "x"), ["k"]), ["k"], {"q50": 0.5})
    a, b = ({r.k: r for r in d.collect()} for d in (whole, parts))
    for k in a:
        assert a[k].n == b[k].n and b[k].n_distinct == pytest.approx(a[k].n_distinct, rel=0.05) and b[k].q50 == pytest.approx(a[k].q50, abs=0.06)


def test_sketches_of_nothing(spark, days):
    none = sketches.estimates(sketches.states(days.where("x IS NULL and day = 0"), ["k"], "who", "x"), ["k"], {"q50": 0.5}).collect()
    assert none and all(r.n == 0 and r.q50 is None and r.n_distinct > 0 for r in none)
    assert sketches.states(days.limit(0), ["k"], "who", "x").collect() == []


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_second_write_leaves_other_keys(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    both = spark.createDataFrame([("A", 2030, 1.23456), ("B", 2030, 2.0), ("B", 2031, 3.0)], "country string, year int, forecast double")
    sinks.write_forecast(both, path, fmt=fmt, partition_by=["country"], replace_keys=True)
    for _ in range(2):  # and once more, with the same result
        sinks.write_forecast(both.where("country = 'B' and year = 2030").withColumn("forecast", F.lit(9.0)), path, fmt=fmt, partition_by=["country"], replace_keys=True)
    read = spark.read.option("header", True).option("inferSchema", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    assert sorted((r.country, r.year, r.forecast_gtco2) for r in read.collect()) == [("A", 2030, 1.235), ("B", 2030, 9.0)]


def test_keys_are_needed(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_forecast(spark.createDataFrame([("A", 1.0)], "country string, forecast double"), str(tmp_path), replace_keys=True)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 97).cast("string").alias("country"), F.col("id").alias("year"), F.rand(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bau_rows", "commitment_rows"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            sinks.write_bucketed(rows, name, ["country", "year"], 8, str(tmp_path / name))
        joined = spark.table("bau_rows").join(spark.table("commitment_rows").withColumnRenamed("v", "w"), ["country", "year"])
        assert joined.count() == 4000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        summed = spark.table("bau_rows").groupBy("country", "year").agg(F.sum("v"))
        summed.collect()
        assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("bau_rows", "commitment_rows"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
