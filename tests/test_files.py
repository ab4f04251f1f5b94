import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from fixtures import GOAL, SHORT

from plumeline.operators import features, forecast, pathways, policy, series
from plumeline.sources import series as readers
from plumeline.sources import sinks
from plumeline.sources.documents import read_documents


ROOT = Path(__file__).resolve().parents[1]


def test_series_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("year,emissions_gtco2,note\n2001,1.5,x\n2000,1.0,\n2002,NA,y\n")
    df = readers.read_series(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"year": "int", "emissions_gtco2": "double", "note": "string"}
    kept = series.prepare(df, [], "year", "emissions_gtco2")
    assert {r.year for r in kept.collect()} == {2001}
    needed = series.prepare(df, [], "year", "emissions_gtco2", drop_any=False)
    assert {r.year for r in needed.collect()} == {2000, 2001}
    with pytest.raises(ValueError, match="missing required columns: emissions"):
        readers.read_series(spark, str(tmp_path / "a.csv"), value="emissions")


def test_repeated_periods_are_summed_and_counted(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 1.0)], "k string, t int, v double")
    assert {(r.k, r.v, r.row_count) for r in series.prepare(df, ["k"], "t", "v").collect()} == {("a", 5.0, 2), ("b", 1.0, 1)}


def test_regional_csv(spark, tmp_path):
    folder = tmp_path / "regional"
    folder.mkdir()
    (folder / "1.csv").write_text("iso,country,year,pop,co2\nX,Xland,2000,1,500\nX,Xland,2001,1,\n")
    (folder / "2.csv").write_text("iso,country,year,pop,co2\nY,Yland,1999,1,2000\n")
    df = readers.read_regional_series(spark, str(folder))
    assert {tuple(r) for r in df.collect()} == {("Xland", 2000, 0.5), ("Yland", 1999, 2.0)}
    assert {r.country for r in series.regions(df, "country").collect()} == {"Xland", "Yland"}
    only = series.filter_keys(df, "country", ["Yland"], "year", "emissions_gtco2")
    assert [tuple(r) for r in only.collect()] == [("Yland", 1999, 2.0)]
    assert series.filter_periods(df, "year", 2000, 2000).count() == 1


def test_forecast_and_scenario_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", 2000 + i, v) for i, v in enumerate(SHORT)], "k string, year int, v double")
    best = forecast.forecast_best(df, ["k"], "year", "v", 2)
    sinks.write_forecast(best, str(tmp_path / "f"), partition_by=["k"])
    back = spark.read.option("header", True).csv(str(tmp_path / "f"))
    assert sorted(back.columns) == ["forecast_gtco2", "k", "model", "year"]
    assert {r.forecast_gtco2 for r in back.filter("year = 2026").collect()} == {str(round(best.filter('year = 2026').first().forecast, 3))}
    scenario = [{"scenario": "s", "pathway": "linear", "target_kind": "net_zero", "target_period": 2030}]
    paths = pathways.run_scenarios(df, scenario, ["k"], "year", "v")
    sinks.write_scenarios(paths, ["k"], "year", str(tmp_path / "s"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "s")).filter("year = 2030").first().commitment_forecast_gtco2 == 0.0


def test_nested_columns_and_training_table(spark, tmp_path):
    nested = spark.sql("SELECT 1 AS id, map('a', 1.5D) AS slate, array('x', 'y') AS notes")
    sinks.write_table(nested, str(tmp_path / "n"), "csv")
    r = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "n")).first()
    assert (r.slate, r.notes) == ('{"a":1.5}', '["x","y"]')
    runs = spark.createDataFrame(
        [("Sabatier (methanation)", "Ni-based", 300, 10, 4.0, "Fixed-bed", 65.0, 95.0, "CH4 (methane)")],
        "pathway string, catalyst_family string, temperature_c int, pressure_bar int, h2_co2_ratio double, reactor_type string, X_CO2 double, S_product double, primary_product string",
    )
    table = features.add_features(features.align_literature(features.literature_runs(runs)))
    sinks.write_training_table(table, str(tmp_path / "t"))
    back = features.read_training_table(spark, str(tmp_path / "t"))
    r = back.first()
    assert r.metal is None and r.linker is None and r.is_thermal == 1 and r["1000_T_K"] == pytest.approx(1.7447439588240425)
    sinks.write_training_table(table, str(tmp_path / "p"), fmt="parquet")
    assert (tmp_path / "p" / "pathway=Sabatier (methanation)").exists()
    sinks.write_metrics(spark.createDataFrame([("X", 1.0)], "target string, r2 double"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first().target == "X"


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOAL, indent=2))
    (tmp_path / "b.json").write_text("{broken")
    docs = read_documents(spark, str(tmp_path))
    assert [tuple(r) for r in policy.list_countries(docs, "text", ["doc"]).collect()] == [("a.json", 0, "Arla")]
    assert len(policy.parse_commitments(docs, "text", ["doc"]).first().policy_actions) == 4
    with pytest.raises(AnalysisException):
        read_documents(spark, str(tmp_path / "none"))
    assert policy.list_countries(read_documents(spark, str(tmp_path / "none"), missing_ok=True), "text", ["doc"]).count() == 0


def test_run_logs(spark, tmp_path):
    (tmp_path / "runs.csv").write_text(
        "metal,linker,temperature_c,pressure_bar,h2_co2_ratio,reactor_type,X_CO2,S_MeOH,S_CO,S_CH4\n"
        "Hf,BA,240,30,3.0,Fixed-bed,5.28,25.01,65.71,8.98\n"
    )
    r = features.experimental_runs(features.read_runs(spark, str(tmp_path / "runs.csv"))).first()
    assert (r.catalyst_family, r.temperature_c) == ("Hf-UiO-67-BA-Pt", 240.0)
    assert r.Y_MeOH == pytest.approx(1.320528)


def test_search_runs_from_another_folder(tmp_path):
    """Workers find the package although neither the working folder nor the path names it."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from plumeline.operators import forecast
from plumeline.session import local_session, ship
spark = local_session(2, 2, "elsewhere")
ship(spark)
sys.path.pop(0)
df = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "k string, t int, v double")
print("ROWS", forecast.forecast_best(df, ["k"], "t", "v", 3, arima="search").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 3" in done.stdout, done.stderr[-2000:]
