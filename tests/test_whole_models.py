import duckdb
import numpy as np
import pytest

from plumeline.operators import model
from plumeline.operators.boosting import Trees
from plumeline.operators.features import FEATURES, label_indexer
from plumeline.plans import queries as named

BASE, STEP = 1.0, 0.1  # what a model of these tests says before its trees, and what each of them adds
METHANOL, OTHER = 6002, 6000  # parts whose points are of two pathways
WHOLE = BASE + STEP * model.TREES


@pytest.fixture
def lines(tmp_path):
    duckdb.sql(
        f"""COPY (SELECT i // 4 AS l_orderkey, (i % 4)::INTEGER AS l_linenumber, 7::BIGINT AS l_suppkey, (CASE i % 2 WHEN 0 THEN {METHANOL} ELSE {OTHER} END)::BIGINT AS l_partkey,
  25.0::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount, 0.04::DOUBLE AS l_tax, 'A' AS l_returnflag FROM range(40) r(i)) TO '{tmp_path}/lineitem.parquet'"""
    )
    return str(tmp_path)


@pytest.fixture
def asked(monkeypatch):
    """Models come untrained, with as many trees as are asked for; returns what was asked."""
    out = []

    def untrained(table, jobs, trees, depth, keys):
        out.append((trees, depth))
        shape = (trees, (1 << (depth + 1)) - 1)
        one = Trees(FEATURES, BASE, np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.full(shape, STEP), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.ones(shape, dtype=bool))
        codes = label_indexer(table)
        return {name: model.Model(one, codes) for name in jobs}

    monkeypatch.setattr(model, "train_jobs", untrained)
    return out


def test_predictions_add_up_all_trees_of_whole_models(spark, lines, asked):
    got = named.boost_predict(spark, lines).collect()
    assert asked == [(150, 5)] and len(got) == 40
    for r in got:
        assert (r.X_CO2, r.Y_MeOH) == pytest.approx((WHOLE, WHOLE))


def test_routed_methanol_is_answered_by_all_trees_of_whole_models(spark, lines, asked):
    got = {r.model_used: r for r in named.boost_route(spark, lines).collect()}
    assert asked == [(150, 5)] and set(got) == {model.ML_NAME, model.RULE_NAME}
    assert got[model.ML_NAME].n_points == got[model.RULE_NAME].n_points == 20
    assert (got[model.ML_NAME].mean_yield, got[model.ML_NAME].mean_carbon) == pytest.approx((WHOLE, round(WHOLE * model.CARBON_FACTOR, 1)))
