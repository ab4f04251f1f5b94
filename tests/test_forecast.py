import pytest
from fixtures import LONG, SHORT, holdout_error, least_squares
from pyspark.sql import functions as F

from plumeline.operators import forecast, series
from plumeline.operators.arima import _search_one

KEYS = ["key"]


@pytest.fixture(scope="module")
def two(spark):
    rows = [("long", 1990 + i, v) for i, v in enumerate(LONG)] + [("short", 2000 + i, v) for i, v in enumerate(SHORT)]
    return series.prepare(spark.createDataFrame(rows, "key string, year int, v double"), KEYS, "year", "v").select("key", "year", "v").cache()


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_polynomial_and_its_error(two, degree):
    future = {(r.key, r.year): r.forecast for r in forecast.poly_forecast(two, KEYS, "year", "v", 20, degree).collect()}
    errors = {r.key: r for r in forecast.backtest(two, KEYS, "year", "v", degree).collect()}
    for key, values, n_test in (("long", LONG, 6), ("short", SHORT, 4)):
        first, last = least_squares(values, degree, [1, 20])
        assert errors[key].n_test == n_test
        assert errors[key].poly_mape == pytest.approx(holdout_error(values, degree, n_test), abs=1e-9)
        assert future[key, 2026] == pytest.approx(first, rel=1e-9)
        assert future[key, 2045] == pytest.approx(last, rel=1e-9)


def test_degree_one_equals_regression(two):
    line = {r.key: (r.a, r.b) for r in two.groupBy("key").agg(F.regr_slope("v", "year").alias("a"), F.regr_intercept("v", "year").alias("b")).collect()}
    for r in forecast.poly_forecast(two, KEYS, "year", "v", 5, 1).collect():
        a, b = line[r.key]
        assert r.forecast == pytest.approx(a * r.year + b, rel=1e-9)


def test_best_model_rule(two):
    for r in forecast.forecast_best(two, KEYS, "year", "v", 3).collect():
        assert r.model == ("Poly(deg=2)" if r.poly_mape < r.arima_mape else "ARIMA")


def test_short_series_uses_arima(spark):
    short = spark.createDataFrame([("s", 2000 + i, float(i * i)) for i in range(7)], "key string, year int, v double")
    rows = forecast.forecast_best(short, KEYS, "year", "v", 2).collect()
    assert {r.model for r in rows} == {"ARIMA"}
    assert all(r.poly_mape is None and r.arima_mape is None for r in rows)


def test_too_few_periods_lower_the_degree(spark):
    one = spark.createDataFrame([("a", 2000, 5.0), ("b", 2000, 1.0), ("b", 2001, 3.0)], "key string, year int, v double")
    got = {(r.key, r.year): r for r in forecast.poly_forecast(one, KEYS, "year", "v", 1, 4).collect()}
    assert (got["a", 2001].forecast, got["a", 2001].effective_degree) == (5.0, 0)
    assert got["b", 2002].forecast == pytest.approx(5.0)
    assert got["b", 2002].effective_degree == 1


def test_partitioning_does_not_change_results(spark, two):
    def run():
        return sorted((r.key, r.year, round(r.forecast, 9), r.model) for r in forecast.forecast_best(two, KEYS, "year", "v", 4).collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    many = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run() == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_closed_form_models(spark):
    walk = [("drift", i, 10.0 + 2.0 * i + (0.01 if i % 2 else -0.01)) for i in range(30)]
    flat = [("flat", i, 5.0 + (1.0 if i % 3 == 0 else -0.5)) for i in range(30)]
    df = spark.createDataFrame(walk + flat, "key string, t int, v double")
    frame = forecast.scored_frame(df, KEYS, "t", "v", 10, 1).filter("_future")
    got = {(r.key, r.t): (r.arima_order, r.arima_pred) for r in frame.collect()}
    assert got["drift", 39][1] == pytest.approx(10 + 2 * 39, abs=0.5)
    assert got["flat", 39][1] == pytest.approx(6.0, abs=1.1)  # the cycle's next value; its mean is 5.0


def test_search_follows_an_autoregression():
    import numpy as np

    rng = np.random.default_rng(7)
    y = [0.0]
    for _ in range(300):
        y.append(0.8 * y[-1] + rng.normal())
    ahead, order = _search_one(np.array(y) + 50.0, 40)
    assert order.split(",")[1] == "0"
    assert abs(ahead[-1] - 50.0) < 3.0


def test_search_follows_a_trend():
    import numpy as np

    y = 3.0 * np.arange(60) + np.sin(np.arange(60))
    ahead, order = _search_one(y, 5)
    assert int(order.split(",")[1]) >= 1
    assert ahead[-1] == pytest.approx(3.0 * 64, abs=4.0)


def test_search_runs_on_every_series(two):
    rows = forecast.forecast_best(two, KEYS, "year", "v", 3, arima="search").collect()
    assert len(rows) == 6 and all(r.forecast is not None for r in rows)


def test_unknown_method(two):
    with pytest.raises(ValueError):
        forecast.scored_frame(two, KEYS, "year", "v", arima="other")
