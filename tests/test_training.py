import math

import pytest
from pyspark.sql import functions as F

from plumeline.operators import features, model, profile, ranks

EXPERIMENTAL = (
    "metal string, linker string, temperature_c int, pressure_bar int, h2_co2_ratio double, reactor_type string, "
    "X_CO2 double, S_MeOH double, S_CO double, S_CH4 double"
)
LITERATURE = (
    "pathway string, catalyst_family string, temperature_c int, pressure_bar int, h2_co2_ratio double, reactor_type string, "
    "X_CO2 double, S_product double, primary_product string"
)
FLOW = "Electrochemical (flow cell)"
T4 = (170, 190, 210, 240)
# Conversion and selectivities of the sixteen experimental runs, four temperatures per catalyst.
RUNS = {
    ("Hf", "BA"): [(0.75, 31.98, 68.02, 0.0), (1.35, 33.12, 65.58, 1.3), (2.49, 33.77, 60.75, 5.49), (5.28, 25.01, 65.71, 8.98)],
    ("Hf", "FA"): [(0.91, 28.83, 71.17, 0.0), (1.75, 30.2, 69.8, 0.0), (3.08, 32.25, 65.66, 2.1), (6.37, 25.63, 68.44, 5.79)],
    ("Zr", "FA"): [(0.83, 24.95, 75.05, 0.0), (1.55, 27.62, 72.38, 0.0), (2.86, 29.72, 66.9, 3.38), (5.94, 22.36, 71.35, 6.19)],
    ("Zr", "BA"): [(0.87, 27.26, 72.74, 0.0), (1.63, 26.45, 72.36, 1.19), (3.07, 29.67, 65.45, 4.88), (6.66, 22.05, 70.53, 7.25)],
}
# The sixteen literature runs.
SABATIER = [(300, 10, 4.0, 65.0, 95.0), (320, 10, 4.0, 75.0, 97.0), (350, 20, 4.0, 85.0, 96.0), (380, 30, 4.0, 90.0, 94.0)]
TROPSCH = [(320, 20, 2.0, 45.0, 50.0), (350, 30, 2.2, 55.0, 50.0), (380, 40, 2.5, 65.0, 50.0), (400, 50, 2.0, 70.0, 50.0)]
FORMATE = [(25, 1, 2.0, 35.0, 50.0), (25, 1, 2.5, 42.0, 50.0), (30, 1, 2.0, 38.0, 50.0), (30, 1, 3.0, 45.0, 50.0)]
CO_ROUTE = [(25, 1, 1.0, 55.0, 85.0), (25, 1, 1.5, 60.0, 88.0), (30, 1, 1.0, 58.0, 86.0), (30, 1, 1.2, 62.0, 90.0)]


@pytest.fixture(scope="module")
def table(spark):
    runs = [(m, k, t, 30, 3.0, "Fixed-bed", *v) for (m, k), vs in RUNS.items() for t, v in zip(T4, vs, strict=True)]
    groups = [
        ("Sabatier (methanation)", "Ni-based", "Fixed-bed", "CH4 (methane)", SABATIER),
        ("RWGS + Fischer-Tropsch", "Fe/Co (FT)", "Fixed-bed", "C5+ hydrocarbons (diesel/jet range)", TROPSCH),
        ("Electroreduction (formate route)", "Cu (electro)", FLOW, "HCOO− / HCOOH (formate/formic acid)", FORMATE),
        ("Electroreduction (CO route)", "Ag/Au (electro)", FLOW, "CO (syngas component)", CO_ROUTE),
    ]
    lit = [(p, c, t, b, h, r, x, s, prod) for p, c, r, prod, rows in groups for t, b, h, x, s in rows]
    return features.training_table(spark.createDataFrame(runs, EXPERIMENTAL), spark.createDataFrame(lit, LITERATURE)).cache()


def test_training_table(table):
    assert table.columns == [*features.RUN_COLUMNS, *features.DERIVED_COLUMNS]
    r = table.filter("catalyst_family = 'Zr-UiO-67-FA-Pt' AND temperature_c = 240").first()
    assert r.Y_MeOH == pytest.approx(1.328184) and (r.is_thermal, r.is_methanation, r.is_methanol) == (1, 0, 1)
    assert r["1000_T_K"] == pytest.approx(1.948747929455325) and r.temp_pressure == 7200
    assert r.ln_pressure == pytest.approx(3.4339872044851463)
    routed = {r.pathway: (r.S_MeOH, r.S_CO, r.S_CH4, r.Y_MeOH) for r in table.filter("data_source = 'literature' AND X_CO2 IN (65.0, 45.0, 55.0)").filter("temperature_c < 330").collect()}
    assert routed["Sabatier (methanation)"] == (0.0, 0.0, 95.0, 0.0)
    assert routed["RWGS + Fischer-Tropsch"] == routed["Electroreduction (formate route)"] == (0.0, 0.0, 0.0, 0.0)
    assert routed["Electroreduction (CO route)"] == (0.0, 85.0, 0.0, 0.0)
    assert features.methanol_subset(table).count() == 16


def test_profile(table):
    got = {r.pathway: r for r in profile.describe(table, ["pathway"], "X_CO2").collect()}
    assert (got["Methanol synthesis"].low, got["Methanol synthesis"].high) == (0.75, 6.66)
    assert got["Methanol synthesis"].mean == pytest.approx(2.8369, abs=1e-4)
    assert (got["Electroreduction (CO route)"].q25, got["Electroreduction (CO route)"].q50) == (57.25, 59.0)
    whole = profile.describe(table, [], "X_CO2").first()
    values = sorted(r.X_CO2 for r in table.collect())
    assert whole.n == 32 and whole.q50 == pytest.approx((values[15] + values[16]) / 2)
    s = profile.source_counts(table).first()
    assert tuple(s) == (32, 16, 16, 5, 8)
    assert {r.pathway: r.n_rows for r in profile.value_counts(table, "pathway").collect()}["Methanol synthesis"] == 16
    r = {r.column_name: (r.n, r.low, r.high) for r in profile.column_ranges(table, ["temperature_c", "pressure_bar"]).collect()}
    assert r == {"temperature_c": (32, 25.0, 400.0), "pressure_bar": (32, 1.0, 50.0)}


CATALYSTS = ["Ag/Au (electro)", "Cu (electro)", "Fe/Co (FT)", "Hf-UiO-67-BA-Pt", "Hf-UiO-67-FA-Pt", "Ni-based", "Zr-UiO-67-BA-Pt", "Zr-UiO-67-FA-Pt"]


def test_label_codes_and_unknown_rule(spark, table):
    codes = {(r.column_name, r.label): r.code for r in features.label_codes(table, list(features.LABELS)).collect()}
    assert [codes["catalyst_family", c] for c in CATALYSTS] == list(range(8))
    points = spark.createDataFrame(
        [("Methanol synthesis", "Ni-based", "Fixed-bed"), ("Methanol synthesis", "Cu/ZnO/Al2O3", "Fixed-bed")],
        "pathway string, catalyst_family string, reactor_type string",
    )
    coded = features.encode_labels(points, features.label_indexer(table)).orderBy("catalyst_family").collect()
    assert [tuple(r)[3:] for r in coded] == [(0, 0, 0), (2, 5, codes["reactor_type", "Fixed-bed"])]


def test_standardise(table):
    names = ["temperature_c", "pressure_bar"]
    z = features.standardise(table, names).agg(*[f(f"{n}_z") for n in names for f in (F.avg, F.stddev_pop)]).first()
    assert tuple(z) == pytest.approx((0, 1, 0, 1), abs=1e-12)


@pytest.mark.parametrize("n", [5, 32, 101])
def test_contiguous_folds(spark, n):
    sizes = {r.fold: r["count"] for r in ranks.contiguous_folds(spark.range(n), "id", 5).groupBy("fold").count().collect()}
    assert [sizes[i] for i in range(5)] == [n // 5 + (1 if i < n % 5 else 0) for i in range(5)]
    firsts = ranks.contiguous_folds(spark.range(n), "id", 5).groupBy("fold").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("fold").collect()
    assert all(x.b < y.a for x, y in zip(firsts, firsts[1:], strict=False))


def test_quantiles_with_a_hot_key_and_value(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 40)
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.where(rng.random(3000) < 0.4, 5.0, rng.normal(size=3000).round(3))]
    rows += [(f"k{i}", float(v)) for i in range(6) for v in rng.normal(size=i + 1)]
    got = ranks.quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.93})
    for r in got.collect():
        values = [x for k, x in rows if k == r.k]
        assert (r.a, r.b, r.c) == pytest.approx(tuple(np.quantile(values, [0.1, 0.5, 0.93])))


def test_split_is_stable(spark):
    def side(df):
        return {r.id: r.is_train for r in ranks.holdout_split(df, ["id"]).collect()}

    one, many = side(spark.range(2000).coalesce(1)), side(spark.range(2000).repartition(13))
    assert one == many and 0.75 < sum(one.values()) / 2000 < 0.85


@pytest.fixture(scope="module")
def models(table):
    return model.train_each({t: (table, t) for t in model.TARGETS}, trees=16, depth=3)


def test_training_metrics_and_curve(spark, table, models):
    scored = model.predict_raw(models["X_CO2"], table.withColumn("all", F.lit(1)), "predicted")
    m = model.regression_metrics(scored, ["all"], "X_CO2", "predicted").first()
    rows = scored.select("X_CO2", "predicted").collect()
    mean = sum(r.X_CO2 for r in rows) / 32
    sse, sst = sum((r.X_CO2 - r.predicted) ** 2 for r in rows), sum((r.X_CO2 - mean) ** 2 for r in rows)
    assert m.r2 == pytest.approx(1 - sse / sst) and m.rmse == pytest.approx(math.sqrt(sse / 32)) and m.r2 > 0.8
    curve = model.learning_curve(models["X_CO2"], table, "X_CO2")
    assert len(curve) == 16 and curve[-1] == pytest.approx(m.rmse) and curve[-1] < curve[0]
    top = model.feature_importance(models["X_CO2"], spark, "X_CO2", 8).collect()
    assert len(top) == 8 and all(a.importance >= b.importance for a, b in zip(top, top[1:], strict=False))


POINT = "pathway string, catalyst_family string, temperature_c double, pressure_bar double, h2_to_co2 double, reactor_type string, grid_ci_gco2_per_kwh double"


def test_routing_and_shape(spark, models):
    points = spark.createDataFrame(
        [
            ("Methanol synthesis", "Hf-UiO-67-BA-Pt", 190.0, 10.0, 3.0, "Fixed-bed", 0.0),
            ("Methanol synthesis", "Unknown", 300.0, 90.0, 9.0, "Fixed-bed", 0.0),
            ("Sabatier (methanation)", "Ni-based", 300.0, 10.0, 3.0, "Fixed-bed", 450.0),
        ],
        POINT,
    )
    got = {r.temperature_c * 100 + r.pressure_bar: r for r in model.route_predictions(points, models).collect()}
    near, far, ruled = got[19010.0], got[30090.0], got[30010.0]
    assert (near.model_used, ruled.model_used, ruled.yield_pct) == (model.ML_NAME, model.RULE_NAME, 32.1)
    assert near.suggestions == [model.MORE_HEAT, model.MORE_PRESSURE] and near.temperature_score == 1.0
    assert near.slate["CH4"] == 3.0 and near.slate["CO"] == pytest.approx(95 - near.slate["CH3OH"], abs=0.11)
    assert far.suggestions[0].startswith("⚠️ Prediction confidence: ") and model.LESS_HEAT in far.suggestions
    assert {r.model_used for r in model.route_predictions(points, {}).collect()} == {model.RULE_NAME}
    ml = model.add_ml_predictions(points, models).collect()
    assert all(0 <= r.X_CO2 <= 100 and 0 <= r.S_MeOH <= 100 for r in ml)
    other = model.shape_ml(model.add_ml_predictions(points, models), points.columns).filter("pathway LIKE 'Sab%'").first()
    raw = next(r for r in ml if r.pathway.startswith("Sab"))
    assert other.yield_pct == pytest.approx(raw.X_CO2 * 0.6, abs=0.051) and other.slate == {"others": 100.0}


def test_save_and_load(spark, table, models, tmp_path):
    assert model.load_models(spark, str(tmp_path)) == {}
    model.save_models(models, str(tmp_path))
    loaded = model.load_models(spark, str(tmp_path))
    assert sorted(loaded) == sorted(model.TARGETS)
    a = model.predict_raw(models["Y_MeOH"], table, "p").select("p").collect()
    assert model.predict_raw(loaded["Y_MeOH"], table, "p").select("p").collect() == a


def test_cross_validation(table):
    rows = table.withColumn("row", F.col("temperature_c") * 1000 + F.col("X_CO2"))
    folded = ranks.contiguous_folds(rows, "row", 3)
    folds = model.cross_validate(folded, "X_CO2", 3, trees=3, depth=2)
    r2 = [r.r2 for r in folds.collect()]
    s = model.cross_validation_summary(folds).first()
    assert len(r2) == 3 and s.cv_r2_mean == pytest.approx(sum(r2) / 3)
    assert s.cv_r2_std == pytest.approx(math.sqrt(sum((x - sum(r2) / 3) ** 2 for x in r2) / 3))


def test_training_report(spark):
    metrics = spark.createDataFrame([("X", True, 0.9, 1.0), ("X", False, 0.8, 2.0)], "target string, is_train boolean, r2 double, rmse double")
    cv = spark.createDataFrame([("X", 0.5, 0.1)], "target string, cv_r2_mean double, cv_r2_std double")
    assert tuple(model.training_report(metrics, cv).first()) == ("X", 0.9, 0.8, 1.0, 2.0, 0.5, 0.1)
