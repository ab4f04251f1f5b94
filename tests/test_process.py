import itertools

import pytest
from pyspark.sql import functions as F

from plumeline.functions import process_tables as consts
from plumeline.operators import explore, model, scoring

POINT = "pathway string, catalyst_family string, temperature_c double, pressure_bar double, h2_to_co2 double, reactor_type string, grid_ci_gco2_per_kwh double"
SABATIER = ("Sabatier (methanation)", "Ni-based", 300.0, 10.0, 3.0, "Fixed-bed", 450.0)


def score(spark, *points):
    return scoring.score_points(spark.createDataFrame(list(points), POINT))


def test_one_point(spark):
    r = score(spark, SABATIER).withColumn("slate", scoring.slate_map()).first()
    assert (r.temperature_score, r.pressure_score, r.h2_score) == (0.801, 1.0, 0.044)
    assert (r.yield_pct, r.yield_range, r.carbon_util_pct) == (32.1, "25.1–39.1%", 30.5)
    assert r.slate == {"CH4": 70.5, "CO": 2.0, "CH3OH": 0.1, "C5+": 2.0, "others": 25.4}
    assert r.suggestions == ["Adjust H₂:CO₂ toward ~4.0:1 (±0.4)."]
    assert r.operating_score == round((0.801 + 1.0 + 0.044) / 3, 3)


def test_defaults_and_messages(spark):
    unknown, electro, cold = score(
        spark,
        ("Plasma", "Hf-UiO-67-BA-Pt", 300.0, 10.0, 2.0, "Tube", 0.0),
        ("Electroreduction (CO route)", "Cu (electro)", 100.0, 1.0, 1.5, "Other", 650.0),
        ("Methanol synthesis", "Ni-based", 20.0, 1.0, 1.0, "Slurry", 650.0),
    ).withColumn("slate", scoring.slate_map()).collect()
    assert (unknown.primary_product, unknown.yield_pct, unknown.slate) == ("Unknown", 40.0, {"others": 100.0})
    assert unknown.suggestions == [scoring.NOMINAL] and unknown.notes == [scoring.DEFAULT_NOTE]
    assert electro.notes == [scoring.HIGH_GRID_NOTE]
    assert electro.suggestions == ["Increase temperature toward ~25°C (±7°C).", scoring.CLEANER]
    assert cold.suggestions == [
        "Increase temperature toward ~250°C (±20°C).",
        "Increase pressure toward ~50 bar (±10 bar).",
        "Adjust H₂:CO₂ toward ~3.0:1 (±0.4).",
    ]


def test_selectivities_stay_in_bounds():
    """The linear terms are non-negative and at most 1 in total wherever both scores lie in 0..1."""
    for pathway in {row[0] for row in consts.SELECTIVITY}:
        terms = [row[2:] for row in consts.SELECTIVITY if row[0] == pathway]
        for st, sh in itertools.product((0.0, 1.0), repeat=2):
            parts = [c + a * st + b * (1 - st) + h * sh for c, a, b, h in terms]
            assert all(0 <= p <= 1 for p in parts) and sum(parts) <= 1 + 1e-12


def test_slate_sums_to_one_hundred(spark):
    points = [
        (p[0], "Other", 20.0 + 40 * t, 1.0 + 7 * t, 1.0 + h, "Other", 0.0) for p in consts.PATHWAYS for t in range(10) for h in range(4)
    ]
    total = sum((F.coalesce(f"sel_{s}", F.lit(0.0)) for s in [*consts.PRODUCTS.values(), "others"]), F.lit(0.0))
    for r in score(spark, *points).select(total.alias("t")).collect():
        assert r.t == pytest.approx(100.0, abs=0.3)


MATRIX = {
    "Sabatier (methanation)": [72.0, 75.6, 79.2, None, None, 72.0],
    "RWGS + Fischer-Tropsch": [54.0, 56.7, 59.4, None, None, 54.0],
    "Methanol synthesis": [60.0, 63.0, 66.0, None, None, 60.0],
    "Electroreduction (formate route)": [None, None, None, 46.2, 52.6, 48.7],
    "Electroreduction (CO route)": [None, None, None, 51.4, 58.4, 54.1],
}


def test_catalog_matrix_and_conditions(spark):
    cells = explore.best_cells(explore.catalog_points(spark))
    got = {r.pathway: list(r)[1:] for r in explore.matrix(cells).collect()}
    assert got == MATRIX
    s = explore.matrix_summary(cells).first()
    assert (s.best_pathway, s.best_catalyst, s.best_yield) == ("Sabatier (methanation)", "Fe/Co (FT)", 79.2)
    assert (s.valid_cells, s.total_cells) == (18, 30) and s.mean_yield == pytest.approx(60.1833, abs=1e-4)
    conditions = explore.optimal_conditions(cells)
    best = {r.pathway: r for r in conditions.collect()}
    assert sorted(r.best_catalyst for r in best.values()) == ["Cu (electro)"] * 2 + ["Fe/Co (FT)"] * 3
    assert best["Methanol synthesis"].temperature_range == "250±20"
    assert best["Electroreduction (CO route)"].h2_ratio_range == "1.5±0.3"
    ends = {r.which: r.pathway for r in explore.conditions_extremes(conditions).collect()}
    assert ends == {"highest": "Sabatier (methanation)", "lowest": "Electroreduction (formate route)"}


def test_validity(spark):
    pairs = [(p, c) for p in ("Sabatier (methanation)", "Electroreduction (CO route)") for c in [*explore.CATALYST_COLUMNS, "Hf"]]
    df = spark.createDataFrame(pairs, "p string, c string").filter(scoring.is_valid_pair(F.col("p"), F.col("c")))
    assert {(r.p[0], r.c) for r in df.collect()} == {
        ("S", "Ni-based"), ("S", "Cu/ZnO/Al2O3"), ("S", "Fe/Co (FT)"), ("S", "Other"),
        ("E", "Ag/Au (electro)"), ("E", "Cu (electro)"), ("E", "Other"),
    }


UNIT = "unit string, pathway string, catalyst_family string, reactor_type string, grid_ci_gco2_per_kwh double, t_min double, t_max double, p_min double, p_max double, h_min double, h_max double"


def test_grid(spark):
    units = spark.createDataFrame(
        [("u", "Sabatier (methanation)", "Ni-based", "Fixed-bed", 450.0, 250.0, 380.0, 1.0, 60.0, 1.0, 5.0)], UNIT
    )
    grid = explore.grid_search(units, ["unit"])
    assert grid.count() == 343
    top = explore.best_overall(grid, ["unit"], 3).collect()
    assert [(r.temperature_c, r.pressure_bar, r.h2_to_co2, r.yield_pct) for r in top] == [
        (315.0, 10.833, 4.333, 60.5),
        (315.0, 10.833, 3.667, 59.5),
        (336.667, 10.833, 4.333, 56.6),
    ]
    assert [r.yield_pct for r in explore.best_points(grid, ["unit"], 3).orderBy("rank").collect()] == [60.5, 59.5, 56.6]
    heat = explore.heatmap(grid, ["unit"]).collect()
    middle = {(r.t_index, r.p_index): r.yield_pct for r in grid.filter("h_index = 3").collect()}
    assert len(heat) == 7 and all(r[f"p_{j}"] == middle[r.t_index, j] for r in heat for j in range(7))
    no_c5 = explore.grid_search(units, ["unit"], (3, 3, 3), "Maximize HCOO/HCOOH selectivity")
    assert {r.objective_score for r in no_c5.collect()} == {0.0}


def test_units_alike_share_one_grid(spark):
    """The best points of all units follow from one grid per kind, ties and missing values included."""
    kinds = [("Sabatier (methanation)", "Ni-based", "Fixed-bed", 250.0), ("Electro (CO route)", "Ag/Au", "Electrochemical (flow cell)", 20.0), (None, "Ni-based", None, 300.0)]
    rows = []
    for i in range(60):
        pathway, catalyst, reactor, t = kinds[i % 3]
        rows.append((f"u{59 - i:02}", pathway, catalyst, reactor, (None, 50.0, 450.0, 700.0, 900.0)[i // 3 % 5], t if i % 12 else None, t + 80, 1.0, 60.0, 1.0, 5.0))
    units = spark.createDataFrame(rows, UNIT)
    whole = explore.grid_search(units, ["unit"])
    assert explore.kinds_of(explore.with_kinds(units), ["unit"]).count() < 15 < 60
    for top in (3, 25, 400):
        want = explore.best_overall(whole, ["unit"], top).collect()
        assert explore.top_points(units, ["unit"], top=top).collect() == want


def test_confidence(spark):
    df = spark.createDataFrame([(250.0, 40.0, 3.0), (200.0, 30.0, 3.0), (170.0, 0.5, 3.0), (200.0, 10.0, 6.0)], "t double, p double, h double")
    got = [r[0] for r in df.select(model.confidence(F.col("t"), F.col("p"), F.col("h"))).collect()]
    import math

    assert got == pytest.approx([math.exp(-(10 / 240)), 1.0, math.exp(-0.2), math.exp(-0.5)])
    assert round(got[0], 3) == 0.959


def test_scoring_runs_on_a_stream(spark, tmp_path):
    points = spark.createDataFrame([SABATIER] * 5, POINT)
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = scoring.score_points(stream).select("yield_pct").writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert [r.yield_pct for r in spark.table("scored").collect()] == [32.1] * 5
