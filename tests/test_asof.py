import random

import pytest
from pyspark.sql import functions as F

from plumeline.operators import asof, policy
from plumeline.operators.asof import asof_join


def plain(asked, knots):
    out = []
    for key, time, name in asked:
        own = sorted((t, v) for k, t, v in knots if k == key and t is not None) if key is not None and time is not None else []
        before = [x for x in own if x[0] <= time]
        after = [x for x in own if x[0] > time]
        out.append((key, time, name, before[-1] if before else None, after[0] if after else None))
    return sorted(out, key=repr)


def joined(spark, asked, knots):
    left = spark.createDataFrame(asked, "k string, t int, name string")
    right = spark.createDataFrame(knots, "k string, t int, v double")
    found = asof_join(left, right, ["k"], "t", ["v"]).collect()
    return sorted([(r.k, r.t, r.name, r.before and tuple(r.before), r.after and tuple(r.after)) for r in found], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_search(spark, seed):
    r = random.Random(seed)
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    asked = [(key(), r.randint(0, 300) if r.random() > 0.03 else None, str(i)) for i in range(900)] + [("hot", 77, "same")] * 200 + [("alone", 5, "x")]
    knots = [(key(), r.randint(0, 300) if r.random() > 0.03 else None, float(r.randint(0, 5))) for _ in range(700)] + [("never", 1, 1.0)]
    assert joined(spark, asked, knots) == plain(asked, knots)


def test_empty_sides(spark):
    assert joined(spark, [], [("a", 1, 1.0)]) == []
    assert joined(spark, [("a", 1, "x")], []) == [("a", 1, "x", None, None)]


def test_neighbours_in_other_ranges(spark):
    """One knot far before and one far after hundreds of asked times: ranges in between have no knot of their own."""
    asked = [("k", t, "") for t in range(10, 900)]
    got = joined(spark, asked, [("k", 0, 1.0), ("k", 1000, 2.0)])
    assert {g[3:] for g in got} == {((0, 1.0), (1000, 2.0))}


@pytest.mark.parametrize("use_target_year", [True, False])
def test_policy_rows_equal_arrays(spark, use_target_year):
    r = random.Random(9)
    rows = []
    for i in range(60):
        years = sorted(r.sample(range(2000, 2025), r.randint(0, 6)))
        rows.append((i, "s", 2000 + r.randint(0, 3), 50.0 * (1 if i % 7 else -1), r.choice([None, 0.0, 40.0]), None, years, [r.random() * 60 for _ in years], 2035))
    actions = spark.createDataFrame(
        rows,
        "id int, sector string, action_baseline_year int, baseline_emissions_mtco2 double, reduction_target_pct double, removal_increase_pct double, "
        "implementation_years array<int>, yearly_improvement_pct array<double>, target_year int",
    )
    want = policy.reductions_by_year(actions, 1998, 2045, use_target_year).select("id", "year", "reduction_pct", "absolute_reduction_mtco2")
    years = actions.select("id", F.explode(F.sequence(F.lit(1998), F.lit(2045))).alias("year"))
    got = policy.reductions_from_rows(actions, policy.knot_rows(actions, ["id"]), years, ["id"], use_target_year).select(want.columns)
    a = {(x[0], x[1]): x[2:] for x in want.collect()}
    b = {(x[0], x[1]): x[2:] for x in got.collect()}
    assert set(a) == set(b)
    for k in a:
        assert b[k] == pytest.approx(a[k], abs=1e-9), k


def test_more_rows_are_more_tasks(spark, monkeypatch):
    """A task has a bounded share of the rows, whatever the session's number of partitions, and the answer stays."""
    asked = [(k, t, f"{k}{t}") for k in ("hot", "a") for t in range(300)]
    knots = [(k, t, float(t)) for k in ("hot", "a") for t in range(0, 300, 3)]
    monkeypatch.setattr(asof, "TASK_ROWS", 20)
    assert joined(spark, asked, knots) == plain(asked, knots)
    left, right = spark.createDataFrame(asked, "k string, t int, name string"), spark.createDataFrame(knots, "k string, t int, v double")
    text = asof_join(left, right, ["k"], "t", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert ", 40), REPARTITION_BY_NUM" in text
