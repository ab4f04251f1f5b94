import numpy as np
import pytest

from plumeline.operators import arima, forecast, likelihood, series
from plumeline.operators.likelihood import MOST, Filter, partials


def simulated(phi, theta, n, seed):
    e = np.random.default_rng(seed).normal(size=n + 200)
    x = np.zeros(n + 200)
    for t in range(MOST, n + 200):
        x[t] = sum(p * x[t - 1 - i] for i, p in enumerate(phi)) + e[t] + sum(q * e[t - 1 - i] for i, q in enumerate(theta))
    return x[200:]


def covariance(phi, theta, n):
    """Autocovariances of an ARMA process by its moving-average form, as one matrix."""
    psi = np.zeros(3000)
    for k in range(3000):
        psi[k] = (k == 0) + (theta[k - 1] if 0 < k <= len(theta) else 0) + sum(p * psi[k - 1 - i] for i, p in enumerate(phi) if k > i)
    g = np.array([psi[: 3000 - h] @ psi[h:] for h in range(n)])
    return g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def row(phi, theta):
    out = np.zeros((1, 2 * MOST))
    out[0, :MOST] = partials(np.r_[phi, np.zeros(MOST - len(phi))])
    out[0, MOST:] = partials(-np.r_[theta, np.zeros(MOST - len(theta))])
    return out


def dense(y, v, lift):
    """Log-likelihood, constant and variance by the whole covariance matrix."""
    n, inverse = len(y), np.linalg.inv(v)
    mean = (lift @ inverse @ y) / (lift @ inverse @ lift) if lift is not None else 0.0
    r = y - (mean * lift if lift is not None else 0.0)
    s2 = r @ inverse @ r / n
    return -0.5 * (n * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1]), mean, s2


MODELS = [([0.5, -0.3], [0.4]), ([], [0.6, 0.2]), ([0.95], []), ([], []), ([0.2, 0.1, 0.1, -0.2, 0.3], [0.5, 0.1, 0, 0, 0.2])]


@pytest.mark.parametrize(("phi", "theta"), MODELS)
@pytest.mark.parametrize("missing", [False, True])
def test_filter_equals_the_whole_covariance(phi, theta, missing):
    n = 70
    at = np.array([t for t in range(n) if not missing or (t % 7 not in (3, 4) and not 30 < t < 50)])
    y = simulated(phi, theta, n, 3)[at] + 2.0
    want = dense(y, covariance(phi, theta, n)[np.ix_(at, at)], np.ones(len(at)))
    got = Filter(y, at, 0).likelihood(row(phi, theta), np.array([True]))
    assert [float(g[0]) for g in got[:3]] == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize("d", [1, 2])
@pytest.mark.parametrize("missing", [False, True])
def test_differences_and_gaps(d, missing):
    n, phi, theta = 60, [0.6], [0.3]
    z = simulated(phi, theta, n, 5) + (0.5 if d == 1 else 0.0)
    y = z.copy()
    sums = np.eye(n)
    for _ in range(d):
        y, sums = np.cumsum(y), np.tril(np.ones((n, n))) @ sums
    y, sums = np.r_[0.0, y], np.vstack([np.zeros(n), sums])  # a first value that is known
    at = np.array([t for t in range(n + 1) if not missing or t < 2 or (t % 5 != 2 and not 20 < t < 33)])
    if d == 2:  # and with two differences, a second one
        sums = sums - np.arange(n + 1)[:, None] * sums[1]
        held, y = at[2:], y - np.arange(n + 1) * y[1]
    else:
        held = at[1:]
    v = sums[held] @ covariance(phi, theta, n) @ sums[held].T
    want = dense(y[held], v, held.astype(float) if d == 1 else None)
    got = Filter(y[at], at, d).likelihood(row(phi, theta), np.array([d == 1]))
    assert [float(g[0]) for g in got[:3]] == pytest.approx(want, rel=2e-4, abs=2e-4)


def test_stationary_start_and_partials_round_trip():
    phi = np.array([0.5, -0.3, 0.2, 0.1, -0.2])
    assert likelihood.coefficients(partials(phi)[None])[0] == pytest.approx(phi)


@pytest.mark.parametrize(("phi", "theta"), [([0.8], []), ([], [0.6]), ([0.6], [0.3]), ([1.2, -0.5], [])])
def test_parameters_of_simulated_processes(phi, theta):
    y = 4.0 + simulated(phi, theta, 1500, 11)
    candidates = [(len(phi), len(theta), True)]
    model = likelihood.fit(y, np.arange(len(y)), 0, candidates, np.zeros((1, 2 * MOST)))
    assert model.phi[: len(phi)] == pytest.approx(phi, abs=0.08)
    assert model.theta[: len(theta)] == pytest.approx(theta, abs=0.08)
    assert model.sigma2 == pytest.approx(1.0, abs=0.08) and model.mean * model.scale + model.origin == pytest.approx(4.0, abs=0.7)


@pytest.mark.parametrize("seed", range(6))
def test_never_below_the_regression(seed):
    phi, theta = MODELS[seed % len(MODELS)]
    y = simulated(phi, theta, 90, seed)
    orders = [(p, q, True) for p in range(3) for q in range(3)]
    starts = arima._regressions(y, [(p, q) for p, q, _ in orders])
    for order, start in zip(orders, starts, strict=True):
        model = likelihood.fit(y, np.arange(90), 0, [order], start[None])
        scaled = Filter((y - y.mean()) / y.std(), np.arange(90), 0)
        before = scaled.likelihood(start[None], np.array([True]))[0][0] - 90 * np.log(y.std())
        assert model.loglik >= before - 1e-6


def test_search_finds_the_order():
    model = arima.fit_one(np.cumsum(simulated([0.6], [0.3], 300, 7)) + 0.5 * np.arange(300))
    assert model.order == (1, 1, 1)


@pytest.mark.parametrize("n", range(1, 24))
def test_one_method_for_every_length(n):
    y = 10.0 + 2.0 * np.arange(n) + np.random.default_rng(n).normal(size=n) * 0.05
    ahead, order = arima._search_one(y, 3)
    assert np.isfinite(ahead).all() and order.count(",") == 2
    if n >= 7:
        assert ahead == pytest.approx(10.0 + 2.0 * (n + np.arange(3)), abs=2.5)


def test_constant_series_and_scales():
    assert arima._search_one(np.full(30, 7.5), 4)[0] == pytest.approx([7.5] * 4)
    y = simulated([0.7], [], 80, 2)
    small, large = arima._search_one(y, 3), arima._search_one(y * 1e12 + 1e15, 3)
    assert small[1] == large[1] and (large[0] - 1e15) / 1e12 == pytest.approx(small[0], rel=1e-3, abs=1e-3)


def test_forecast_is_the_conditional_mean():
    y = simulated([0.5, -0.3], [0.4], 50, 9)
    model = likelihood.fit(y, np.arange(50), 0, [(2, 1, True)], np.zeros((1, 2 * MOST)))
    v = covariance(model.phi, model.theta, 54)
    mean = model.origin + model.scale * model.mean
    assert model.ahead(4) == pytest.approx(mean + v[50:, :50] @ np.linalg.inv(v[:50, :50]) @ (y - mean), rel=1e-6)


def test_missing_years_of_a_series(spark):
    y = [100.0 + 3.0 * t for t in range(40)]
    rows = [("whole", 1980 + t, v) for t, v in enumerate(y)] + [("gaps", 1980 + t, v) for t, v in enumerate(y) if t % 6 not in (2, 3) and t != 35]
    df = series.prepare(spark.createDataFrame(rows, "key string, year int, v double"), ["key"], "year", "v").select("key", "year", "v")
    frame = forecast.scored_frame(df, ["key"], "year", "v", 5, 1, "search")
    got = {(r.key, r.year): r.arima_pred for r in frame.where("_future or _test").collect()}
    for (_, year), v in got.items():
        assert v == pytest.approx(100.0 + 3.0 * (year - 1980), abs=0.5)
    assert {k for k, year in got if year > 2019} == {"whole", "gaps"}


@pytest.mark.parametrize("d", [0, 1, 2])
@pytest.mark.parametrize("gone", [(), (9,), (7, 8, 30)])
def test_side_by_side_equals_the_filter(d, gone):
    """Series of several lengths, each row with its own series, against the filter of one series."""
    random, parts = np.random.default_rng(4), []
    for n in (60, 41, 75):
        at = np.array([t for t in range(n) if t not in gone])
        parts.append((np.cumsum(random.normal(size=n))[at] if d else random.normal(size=n)[at], 1990 + at))
    partial, which = random.uniform(-0.8, 0.8, (30, 2 * MOST)), np.arange(30) % 3
    constant = (np.arange(30) % 2 == 0) & (d < 2)
    got = likelihood.Together(parts, d).likelihood(partial, constant, which)
    for s, (y, at) in enumerate(parts):
        want = Filter(y, at, d).likelihood(partial[which == s], constant[which == s])[0]
        assert got[which == s] == pytest.approx(want, rel=1e-5 if d else 1e-10)


def test_many_series_share_the_time_steps(monkeypatch):
    """A series alone and among others of several lengths and gaps has the same forecasts, and its own filter runs for the model that is chosen only."""
    runs, inner = [], Filter.run
    monkeypatch.setattr(Filter, "run", lambda *a: runs.append(1) or inner(*a))
    parts = []
    for k in range(8):
        y, at = np.cumsum(simulated([0.5], [0.2], 50 + k % 3, k)) + 3.0 * k, np.array([t for t in range(50 + k % 3) if k < 6 or t != 20])
        parts.append((y[at], 5, at))
    many = arima._search_all(parts)
    assert len(runs) == len(parts)
    for part, (ahead, order) in zip(parts, many, strict=True):
        alone = arima._search_one(*part)
        assert alone[1] == order and ahead == pytest.approx(alone[0], rel=1e-9)


def test_series_are_cut_apart_in_a_partition(spark):
    """Null keys, text keys and large numbers as keys; more rows than an Arrow batch holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = [(k, w, t, float(10 * j + 2 * t)) for j, (k, w) in enumerate([(None, "a"), (2**60 + 1, "a"), (2**60 + 1, None), (5, "b")]) for t in range(12 + j)]
    df = spark.createDataFrame(rows, "k long, w string, t int, v double")
    try:
        spark.conf.set(name, "7")
        got = forecast.scored_frame(df, ["k", "w"], "t", "v", 3, 1, "search").where("_future").collect()
    finally:
        spark.conf.set(name, before)
    found = {(r.k, r.w, r.t): r.arima_pred for r in got if r.k is not None and r.w is not None}
    assert len(found) == 6 and {k for k, _, _ in found} == {2**60 + 1, 5}
    for (k, _, t), v in found.items():
        assert v == pytest.approx((10 if k > 5 else 30) + 2.0 * t, abs=0.5)
