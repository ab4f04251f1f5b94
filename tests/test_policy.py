import json

import pytest
from fixtures import GOAL, OPEN, PAIR, action, commitment, fraction, reduction
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeline.operators import pathways, policy, validation

KEYS = ["doc"]
DOCS = {"goal": GOAL, "open": OPEN, "pair": PAIR}
COUNTRIES = {(d, e): c for d, doc in DOCS.items() for e, c in doc.items()}


@pytest.fixture(scope="module")
def actions(spark):
    rows = [(name, json.dumps(doc)) for name, doc in DOCS.items()]
    docs = spark.createDataFrame(rows, "doc string, text string")
    return policy.commitment_actions(policy.parse_commitments(docs, "text", KEYS), KEYS).cache()


def test_shares(actions):
    shares = {(r.doc, r.entry, r.sector): r.share_pct for r in policy.action_shares(actions, KEYS).collect()}
    want = {"Power": 60.0, "Roads": 30.0, "Cement": 10.0, "Wetland": 0.0}
    assert {s: shares["goal", "Arla", s] for s in want} == pytest.approx(want)
    assert shares["pair", "Cole", "Power"] == 100.0  # the other country of the document does not count
    assert (shares["pair", "Dune", "Roads"], shares["pair", "Dune", "Cement"]) == (25.0, 75.0)
    quality = {(r.doc, r.entry): (r.share_sum, r.manual_shares) for r in policy.share_quality(policy.action_shares(actions, KEYS), KEYS).collect()}
    assert quality == {("goal", "Arla"): (100.0, 0), ("open", "Bree"): (100.0, 0), ("pair", "Cole"): (100.0, 0), ("pair", "Dune"): (100.0, 2)}


def test_annual_fraction(actions):
    found = policy.annual_fraction(policy.action_shares(actions, KEYS), KEYS, 2020, 2050).collect()
    got = {(r.doc, r.entry, r.year): r.fraction for r in found}
    assert len(got) == 4 * 31
    for (doc, entry), country in COUNTRIES.items():
        for year in range(2020, 2051):
            assert got[doc, entry, year] == pytest.approx(fraction(country, year), abs=1e-9), (entry, year)
    # by hand, Arla in 2024: 60 % x 12 %, 30 % x 6 %, 10 % x 5.5 %, and 8 Mt x 15 % of 92 Mt
    assert got["goal", "Arla", 2024] == pytest.approx(0.072 + 0.018 + 0.0055 + 8 * 0.15 / 92)
    # Dune in 2027: 25 % x 22 % and 75 % x 8 %
    assert got["pair", "Dune", 2027] == pytest.approx(0.115)


def test_reduction_in_2040(actions):
    def at(use):
        rows = policy.reductions_by_year(actions, 2040, 2040, use).collect()
        return {(r.entry, r.sector): r.reduction_pct for r in rows}

    aimed, free = at(True), at(False)
    for (_, entry), country in COUNTRIES.items():
        for a in country["policy_actions"]:
            assert aimed[entry, a["sector"]] == pytest.approx(reduction(a, 2040, country["target_year"]))
            assert free[entry, a["sector"]] == pytest.approx(reduction(a, 2040))
    assert aimed["Arla", "Power"] == pytest.approx(20 + 60 * 14 / 19)  # 2026 to 2045
    assert free["Arla", "Power"] == 80.0  # ten years after the last knot
    assert aimed["Cole", "Power"] == pytest.approx(50 + 40 * 6 / 11)


def test_reduction_branches(spark):
    plain = {
        "passed": action("passed", 10.0, 10.0, {2026: 5.0, 2030: 20.0}, since=2025),
        "single": action("single", 10.0, 0, {2026: 7.0}),
        "empty": action("empty", 10.0, 50.0, {}),
        "unsorted": action("unsorted", 10.0, 50.0, {2030: 20.0, 2026: 5.0}),
        "no target": {**action("no target", 10.0, 0, {2026: 5.0, 2027: 10.0}), "reduction_target_pct": None},
        "falling": action("falling", 10.0, 0, {2026: 90.0, 2030: 10.0}),
        "rising": action("rising", 10.0, 0, {2026: 10.0, 2030: 140.0}),
    }
    twice = {**action("one year", 10.0, 0, {}), "implementation_years": [2026, 2026], "yearly_improvement_pct": [20.0, 20.0]}
    cases = {**plain, "one year": twice}
    doc = {"A": commitment("A", 0.45, list(cases.values()), until=2050, target_reduction_pct=10)}
    docs = spark.createDataFrame([("d", json.dumps(doc))], "doc string, text string")
    rows = policy.commitment_actions(policy.parse_commitments(docs, "text", KEYS), KEYS)
    got = {(r.sector, r.year): r.reduction_pct for r in policy.reductions_by_year(rows, 2024, 2060).collect()}
    assert got["passed", 2024] == got["passed", 2025] == 0.0
    assert got["passed", 2028] == pytest.approx(12.5)
    assert got["passed", 2030] == 20.0 and got["passed", 2031] == 10.0
    assert got["single", 2026] == got["single", 2050] == 7.0
    assert got["empty", 2040] == 0.0
    assert got["unsorted", 2028] == pytest.approx(12.5)
    assert got["no target", 2028] == pytest.approx(10 + 5 / 1.05)
    assert got["falling", 2050] == 0.0 and got["rising", 2060] == 150.0
    assert got["one year", 2026] == got["one year", 2040] == 20.0  # no slope, so it stays
    assert [r.sector for r in validation.unsorted_years(rows, KEYS).collect()] == ["unsorted"]


def test_zero_baseline_is_null(spark):
    doc = {"A": commitment("A", 0.0, [action("Power", 5.0, 50.0, {2022: 5.0}), action("Wetland", -1.0, 50.0, {2022: 5.0})], target_reduction_pct=10)}
    docs = spark.createDataFrame([("d", json.dumps(doc))], "doc string, text string")
    rows = policy.commitment_actions(policy.parse_commitments(docs, "text", KEYS), KEYS)
    assert {r.fraction for r in policy.annual_fraction(policy.action_shares(rows, KEYS), KEYS, 2022, 2024).collect()} == {None}


def test_sector_tables(actions):
    base = {(r.entry, r.sector): r.baseline_mtco2 for r in policy.sector_breakdown(actions, KEYS).collect()}
    assert base["Arla", "Wetland"] == -8.0 and base["Cole", "Power"] == 200.0
    amount = {(r.entry, r.sector): r.contribution_mtco2 for r in policy.sector_contributions(actions, KEYS).collect()}
    assert amount["Arla", "Cement"] == pytest.approx(5.0)
    assert amount["Arla", "Wetland"] == pytest.approx(-12.0)
    gap = {r.entry: r for r in policy.data_horizon(actions, KEYS).collect()}
    assert (gap["Arla"].gap_years, gap["Arla"].gap_class) == (19, "large")
    assert (gap["Cole"].gap_years, gap["Cole"].gap_class) == (0, "none")
    report = {(r.entry, r.sector): r for r in policy.sector_report(policy.action_shares(actions, KEYS), KEYS).collect()}
    assert report["Arla", "Wetland"].target_label == "Removal Increase"
    assert report["Arla", "Power"].yearly_change_pct == pytest.approx(8.0)
    progress = {(r.entry, r.sector, r.year): r for r in policy.progress_table(actions, KEYS).collect()}
    assert progress["Arla", "Power", 2022].change_pct is None
    assert progress["Arla", "Power", 2024].change_pct == pytest.approx(8.0)


def test_targets_and_modes(spark):
    docs = spark.createDataFrame([(n, json.dumps(d)) for n, d in DOCS.items()], "doc string, text string")
    parsed = policy.parse_commitments(docs, "text", KEYS)
    got = {r.entry: r for r in policy.commitment_targets(parsed).collect()}
    assert got["Cole"].target_emissions_gtco2 == pytest.approx(0.18)
    assert got["Bree"].forecast_mode and got["Bree"].target_emissions_gtco2 == 0.092
    assert got["Arla"].mode == "target" and not got["Arla"].forecast_mode
    assert [r.entry for r in policy.mode_mismatch(parsed, "target").collect()] == ["Bree"]
    assert policy.find_commitment(parsed, "Dune").count() == 1
    with pytest.raises(KeyError, match="'X' not found. Available: \\['Arla', 'Bree', 'Cole', 'Dune'\\]"):
        policy.find_commitment(parsed, "X")
    with pytest.raises(KeyError, match="\\['Arla'\\] and 3 more"):
        policy.find_commitment(parsed, "X", most_names=1)


NOW = {"Arla": 0.1, "Bree": 0.08, "Cole": 0.36, "Dune": 0.5}  # current values: above, below and at the baseline


def test_policy_pathway(spark, actions):
    keys = ["doc", "entry"]
    future = range(2026, 2046)
    bau = {(d, e, y): NOW[e] * (1.01 + 0.01 * (y - 2026)) for d, e in COUNTRIES for y in future}
    fractions = policy.annual_fraction(policy.action_shares(actions, KEYS), KEYS, 2026, 2045)
    starts = spark.createDataFrame([(d, e, NOW[e]) for d, e in COUNTRIES], "doc string, entry string, current double")
    frame = spark.createDataFrame([(*k, v) for k, v in bau.items()], "doc string, entry string, year int, bau double")
    found = policy.policy_pathway(frame, fractions, starts, keys, "year").collect()
    got = {(r.entry, r.year): r for r in found}
    for (doc, entry), country in COUNTRIES.items():
        base, end = country["baseline_emissions_gtco2"], country["target_year"]
        years = [y for y in future if y <= end]
        target = base * (1 - country["target_reduction_pct"] / 100) if "target_reduction_pct" in country else None
        path = []
        for y in years:
            v = NOW[entry] * (1 - fraction(country, y))
            v = min(v if target is None else max(v, target), bau[doc, entry, y])
            path.append(path[-1] * 0.995 if path and v > path[-1] else v)
        if target is not None:
            path[-1] = target
        assert [got[entry, y].path for y in years] == pytest.approx(path)
        assert (entry, end + 1) not in got
        projected = base * (1 - fraction(country, end))
        assert [got[entry, y].target for y in years] == pytest.approx([projected if target is None else target] * len(years))
    assert got["Arla", 2045].path == pytest.approx(0.092 * 0.3)  # from the baseline, not from the current 0.1
    assert got["Bree", 2045].path != pytest.approx(got["Bree", 2045].target)  # the path starts from the current value


def test_policy_pathway_for_given_targets(spark, actions):
    keys = ["doc", "entry"]
    fractions = policy.annual_fraction(policy.action_shares(actions, KEYS), KEYS, 2026, 2045).filter("entry = 'Arla'")
    starts = spark.createDataFrame([("goal", "Arla", 0.1)], "doc string, entry string, current double")
    bau = spark.createDataFrame([("goal", "Arla", y, 0.2) for y in range(2026, 2046)], "doc string, entry string, year int, bau double")
    kinds = [("net_zero", 0.0, 0.0), ("absolute", 0.05, 0.05), ("percent", 25.0, 0.075), ("forecast", 0.4, 0.06)]
    for kind, amount, want in kinds:
        asked = starts.selectExpr("*", f"'{kind}' AS target_kind", f"CAST({amount} AS DOUBLE) AS target_amount")
        path = policy.policy_pathway(bau, fractions, starts, keys, "year", targets=pathways.resolve_targets(asked)).collect()
        assert {r.year: r.path for r in path}[2045] == pytest.approx(want)
        assert min(r.path for r in path) >= want - 1e-12


def test_listing_and_comments(spark):
    commented = json.dumps(GOAL)[:-1] + '// note\n, "B": {}}'
    docs = spark.createDataFrame([("good", json.dumps({"A": 1, "B": 2})), ("bad", "{"), ("list", "[1]"), ("note", commented)], "doc string, text string")
    listed = {(r.doc, r.country_pos): r.entry for r in policy.list_countries(docs, "text", KEYS).collect()}
    assert listed == {("good", 0): "A", ("good", 1): "B"}
    strict = policy.parse_commitments(docs.filter("doc = 'note'"), "text", KEYS)
    assert strict.count() == 0
    assert policy.parse_commitments(docs.filter("doc = 'note'"), "text", KEYS, allow_comments=True).count() == 2


def check(spark, *docs):
    rows = [(f"{i:03d}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = validation.validate(spark.createDataFrame(rows, "doc string, text string"), "text", KEYS).orderBy("doc").collect()
    return [(r.is_valid, r.message) for r in out]


def test_years_written_as_decimals(spark):
    text = json.dumps(GOAL).replace("2045", "2045.0").replace("[2022, 2024, 2026]", "[2022.0, 2024, 2026.0]")
    rows = policy.parse_commitments(spark.createDataFrame([("d", text)], "doc string, text string"), "text", KEYS)
    row = rows.first()
    assert row.target_year == 2045 and row.policy_actions[0].implementation_years == [2022, 2024, 2026]


def without(d, field):
    return {k: v for k, v in d.items() if k != field}


def test_validation(spark):
    good = GOAL["Arla"]
    one = good["policy_actions"][0]

    def with_action(a):
        return {"A": {**good, "policy_actions": [one, a]}}

    got = check(
        spark,
        GOAL,
        OPEN,
        "{",
        "[1]",
        {},
        {"A": good, "_comments": {"description": "x"}},
        {"A": without(good, "target_year")},
        {"A": without(good, "target_reduction_pct")},
        {"A": {**good, "target_reduction_pct": None}},
        {"A": {**good, "mode": "goal"}},
        {"A": {**good, "mode": None}},
        {"A": {**good, "policy_actions": {"x": 1}}},
        with_action(without(one, "status")),
        with_action(without(one, "reduction_target_pct")),
        with_action({**one, "baseline_emissions_mtco2": -3}),
        with_action({**one, "yearly_improvement_pct": [1]}),
        {"B": {**good, "mode": "goal"}, "A": without(good, "country")},
        {"A": {**good, "policy_actions": "[abc"}},
        with_action({**one, "baseline_emissions_mtco2": None}),
        with_action({**one, "baseline_emissions_mtco2": "-5"}),
        with_action({**one, "implementation_years": None, "yearly_improvement_pct": None}),
        with_action({**one, "implementation_years": 2030}),
        with_action({**one, "implementation_years": "abc"}),
    )
    action_1 = "Country 'A' action 1"
    wrong = "Validation error: country 'A' action 1:"
    assert got == [
        (True, "JSON is valid"),
        (True, "JSON is valid"),
        (False, "Invalid JSON syntax"),
        (False, "JSON must be an object with country names as keys"),
        (True, "JSON is valid"),
        (False, "Country '_comments' missing required field: country"),
        (False, "Country 'A' missing required field: target_year"),
        (False, "Country 'A' in target mode must have 'target_reduction_pct'"),
        (True, "JSON is valid"),
        (False, "Country 'A' has invalid mode 'goal' (must be 'forecast' or 'target')"),
        (False, "Country 'A' has invalid mode 'None' (must be 'forecast' or 'target')"),
        (False, "Country 'A' policy_actions must be an array"),
        (False, f"{action_1} missing field: status"),
        (False, f"{action_1} (Power): must have either 'reduction_target_pct' or 'removal_increase_pct'"),
        (False, f"{action_1} (Power): sink sectors should use 'removal_increase_pct' instead of 'reduction_target_pct'"),
        (False, f"{action_1} (Power): implementation_years and yearly_improvement_pct must have same length"),
        (False, "Country 'B' has invalid mode 'goal' (must be 'forecast' or 'target')"),
        (False, "Country 'A' policy_actions must be an array"),
        (False, f"{wrong} baseline_emissions_mtco2 is not a number"),
        (False, f"{wrong} baseline_emissions_mtco2 is not a number"),
        (False, f"{wrong} implementation_years is not a list"),
        (False, f"{wrong} implementation_years is not a list"),
        (True, "JSON is valid"),
    ]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.1, 1e5), min_size=1, max_size=30))
def test_shares_sum_to_one_hundred(spark, baselines):
    rows = spark.createDataFrame([("d", b) for b in baselines] + [("d", -5.0)], "doc string, baseline_emissions_mtco2 double")
    shares = policy.action_shares(rows.withColumn("manual_share_pct", F.lit(None).cast("double")), KEYS)
    assert shares.agg(F.sum("share_pct")).first()[0] == pytest.approx(100.0)
