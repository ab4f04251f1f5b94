import math

import pytest
from fixtures import LONG
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeline.operators import pathways

CASES = [(target, year) for target in (0.0, 5.2) for year in (2026, 2030, 2038, 2050)]


def test_shapes(spark):
    start, current, end = 2025, 26.0, 2050
    df = spark.createDataFrame([(start, current, end, t, y) for t, y in CASES], "s int, c double, tp int, t double, y int")
    args = [F.col(c) for c in ("s", "c", "tp", "t", "y")]
    got = df.select(pathways.linear_pathway(*args), pathways.exponential_pathway(*args), pathways.scurve_pathway(*args)).collect()
    for row, (target, year) in zip(got, CASES, strict=True):
        gone = (year - start) / (end - start)
        line = current + (target - current) * gone
        decay = current * ((target or 0.01) / current) ** gone
        curve = target + (current - target) / (1 + math.exp(8 * (gone - 0.5)))
        assert tuple(row) == pytest.approx((line, decay, curve), abs=1e-9)
    assert got[0][0] == pytest.approx(24.96) and got[1][0] == pytest.approx(20.8)  # 26 less a 25th, and less a fifth
    assert got[3][1] == pytest.approx(0.01) and got[7][1] == pytest.approx(5.2)


def smooth(spark, paths):
    rows = [(k, i, v) for k, path in enumerate(paths) for i, v in enumerate(path)]
    out = pathways.smooth_declining(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], "t", "v").collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.k, r.t)):
        found.setdefault(r.k, []).append(r.v)
    return [found[k] for k in range(len(paths))]


def test_smoothing_uses_smoothed_values(spark):
    a, b = smooth(spark, [[3.0, 4.0, 2.0], [3.0, 4.0, 5.0]])
    assert a == pytest.approx([3.0, 2.985, 2.0])
    assert b == pytest.approx([3.0, 2.985, 2.970075])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(0, 1e6), min_size=1, max_size=12), min_size=1, max_size=20))
def test_smoothing_never_rises(spark, paths):
    for before, after in zip(paths, smooth(spark, paths), strict=True):
        assert after[0] == before[0]
        assert all(y <= x for x, y in zip(after, after[1:], strict=False))


def long_series(spark):
    return spark.createDataFrame([("g", 1990 + i, v) for i, v in enumerate(LONG)], "k string, year int, v double")


SCENARIOS = [
    {"scenario": "lin", "pathway": "linear", "target_kind": "net_zero", "target_period": 2050},
    {"scenario": "exp", "pathway": "exponential", "target_kind": "percent", "target_amount": 80.0, "target_period": 2050},
    {"scenario": "abs", "pathway": "scurve", "target_kind": "absolute", "target_amount": 5.2, "target_period": 2050},
    {"scenario": "none", "pathway": "milestones", "target_kind": "percent", "target_amount": 80.0, "target_period": 2050},
    {"scenario": "steps", "pathway": "milestones", "target_kind": "net_zero", "target_period": 2050, "milestones": {2030: 25.0, 2040: 12.0}},
    {"scenario": "policy", "pathway": "policy_driven", "target_kind": "net_zero", "target_period": 2030},
    {"scenario": "late", "pathway": "linear", "target_kind": "net_zero", "target_period": 2025},
]


def test_scenarios(spark):
    import numpy as np

    df = long_series(spark)
    rows = pathways.run_scenarios(df, SCENARIOS, ["k"], "year", "v").collect()
    got = {(r.scenario, r.year): r for r in rows}
    assert got["lin", 2050].commitment == pytest.approx(0.0, abs=1e-9)
    assert got["exp", 2050].commitment == pytest.approx(LONG[-1] * 0.2)
    assert got["abs", 2038].commitment == pytest.approx(5.2 + (LONG[-1] - 5.2) / (1 + math.exp(8 * (13 / 25 - 0.5))))
    assert got["none", 2038].commitment == pytest.approx(got["exp", 2038].commitment)
    assert ("late", 2026) not in got and ("policy", 2031) not in got
    assert got["policy", 2030].commitment == pytest.approx(0.01)
    for r in rows:
        assert r.gap == pytest.approx(r.bau - r.commitment)
    x = np.array([*range(1990, 2026), 2030, 2040, 2050]) - 2020.0
    cubic = np.polyfit(x, np.array([*LONG, 25.0, 12.0, 0.0]), 3)
    for year in (2027, 2035, 2050):
        assert got["steps", year].commitment == pytest.approx(max(0.0, np.polyval(cubic, year - 2020.0)), abs=1e-8)

    summary = {r.scenario: r for r in pathways.scenario_summary(pathways.run_scenarios(df, SCENARIOS, ["k"], "year", "v"), ["k"]).collect()}
    assert summary["exp"].reduction_pct == pytest.approx(80.0)
    assert summary["lin"].total_gap == pytest.approx(sum(r.gap for r in rows if r.scenario == "lin"))
    assert summary["lin"].mean_yearly_gap == pytest.approx(summary["lin"].total_gap / 25)


def test_scenario_table_equals_list(spark):
    df = long_series(spark)
    listed = pathways.run_scenarios(df, SCENARIOS, ["k"], "year", "v")
    table = pathways.scenario_list(spark.createDataFrame([("g",), ("other",)], "k string"), SCENARIOS)
    tabled = pathways.run_scenarios(df, table, ["k"], "year", "v")

    def key(d):
        return sorted((r.scenario, r.year, round(r.commitment, 9), round(r.gap, 9)) for r in d.collect())

    assert key(listed) == key(tabled)
    _, rejected = pathways.split_scenarios(df, table, ["k"], "year", "v")
    reasons = {(r.k, r.scenario): r.reason for r in rejected.collect()}
    assert reasons["g", "late"] == "Target year must be > 2025"
    assert reasons["other", "lin"] == "Unknown series"


def test_policy_path_is_used(spark):
    path = spark.createDataFrame([("g", y, 30.0 - (y - 2025)) for y in range(2026, 2031)], "k string, year int, path double")
    rows = pathways.run_scenarios(long_series(spark), SCENARIOS, ["k"], "year", "v", policy_path=path).collect()
    got = {r.year: r.commitment for r in rows if r.scenario == "policy"}
    assert got == {y: 30.0 - (y - 2025) for y in range(2026, 2031)}
