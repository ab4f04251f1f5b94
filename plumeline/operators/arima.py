"""ARIMA forecasts for every series at once.

`closed_form_arima` fits five small models by conditional least squares with window aggregates only
and keeps the one with the lowest AIC on a common set of one-step errors. `search_arima` searches the
non-seasonal orders p, q up to 5 by exact likelihood with a level test for d; many series are searched side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.operators.likelihood import MOST, Fitted, fit_all, partials
from plumeline.session import spread

# The closed-form candidates in tie-break order, with their parameter counts (variance included).
CANDIDATES = [("mean", 2), ("random_walk", 1), ("random_walk_drift", 2), ("ar1", 3), ("arima110", 3)]

VARIANCE_FLOOR = 1e-12


def closed_form_arima(frame: DataFrame, keys: list[str], time: str, value: str, scopes: dict[str, str]) -> DataFrame:
    """Adds the fitted parameters of the chosen model to every row of each series.

    `scopes` maps a boolean column (a leading part of the series) to a prefix. Columns added per
    prefix: `<prefix>_model` and the parameters that `arima_prediction` reads.
    """
    per_key = "PARTITION BY " + ", ".join(f"`{k}`" for k in keys)
    y = f"`{value}`"
    out = frame.selectExpr(
        "*",
        f"lag({y}, 1) OVER ({per_key} ORDER BY `{time}`) AS _y1",
        f"lag({y}, 2) OVER ({per_key} ORDER BY `{time}`) AS _y2",
    ).selectExpr("*", f"{y} - _y1 AS _d1", "_y1 - _y2 AS _d2")

    fitted, errors, chosen = [], [], []
    for mark, p in scopes.items():

        def used(x: str, mark: str = mark) -> str:
            return f"CASE WHEN `{mark}` THEN {x} END"

        parameters = {
            "n": f"count({used(y)})",
            "mean": f"avg({used(y)})",
            "last": f"max_by({used(y)}, {used('_pos')})",
            "last_step": f"max_by({used('_d1')}, {used('_pos')})",
            "drift": f"avg({used('_d1')})",
            "ar": f"regr_slope({used(y)}, {used('_y1')})",
            "ar_c": f"regr_intercept({used(y)}, {used('_y1')})",
            "ari": f"regr_slope({used('_d1')}, {used('_d2')})",
            "ari_c": f"regr_intercept({used('_d1')}, {used('_d2')})",
        }
        fitted += [f"{aggregate} OVER ({per_key}) AS {p}_{name}" for name, aggregate in parameters.items()]

        step_errors = {
            "mean": f"{y} - {p}_mean",
            "random_walk": "_d1",
            "random_walk_drift": f"_d1 - {p}_drift",
            "ar1": f"{y} - {p}_ar_c - {p}_ar * _y1",
            "arima110": f"_d1 - {p}_ari_c - {p}_ari * _d2",
        }
        errors += [
            f"sum(CASE WHEN `{mark}` AND _pos >= 3 THEN ({e}) * ({e}) END) OVER ({per_key}) AS {p}_sse_{name}"
            for name, e in step_errors.items()
        ]

        admissible = {"ar1": f"abs({p}_ar) < 1 AND {p}_n >= 4", "arima110": f"abs({p}_ari) < 1 AND {p}_n >= 5"}
        scored = []
        for rank, (model, parameter_count) in enumerate(CANDIDATES):
            variance = f"greatest({p}_sse_{model} / ({p}_n - 2), {VARIANCE_FLOOR}D)"
            aic = f"round(({p}_n - 2) * ln({variance}) + {2 * parameter_count}D, 9)"
            scored.append(
                f"CASE WHEN {p}_n > 2 AND {admissible.get(model, 'TRUE')} "
                f"THEN named_struct('aic', {aic}, 'rank', {rank}, 'model', '{model}') END"
            )
        best = f"array_min(filter(array({', '.join(scored)}), s -> s IS NOT NULL))"
        chosen.append(f"coalesce({best}.model, 'random_walk') AS {p}_model")

    return (
        out.selectExpr("*", *fitted)
        .selectExpr("*", *errors)
        .selectExpr(*[f"`{c}`" for c in frame.columns], *[c for p in scopes.values() for c in parameter_columns(p)[:-1]], *chosen)
    )


def parameter_columns(prefix: str) -> list[str]:
    names = ["n", "mean", "last", "last_step", "drift", "ar", "ar_c", "ari", "ari_c", "model"]
    return [f"{prefix}_{name}" for name in names]


def arima_prediction(prefix: str, steps: str) -> Column:
    """The forecast `steps` periods past the end of the fitted part, rolled forward in closed form."""
    p, h = prefix, f"CAST({steps} AS DOUBLE)"

    def geometric(phi: str) -> str:
        return f"((1D - pow({phi}, {h})) / (1D - {phi}))"

    ar, ari = f"{p}_ar", f"{p}_ari"
    moved = (
        f"{p}_last_step * {ari} * {geometric(ari)} + {p}_ari_c * (({h} - {ari} * {geometric(ari)}) / (1D - {ari}))"
    )
    return F.expr(
        f"CASE {p}_model WHEN 'mean' THEN {p}_mean WHEN 'random_walk' THEN {p}_last "
        f"WHEN 'random_walk_drift' THEN {p}_last + {h} * {p}_drift "
        f"WHEN 'ar1' THEN pow({ar}, {h}) * {p}_last + {p}_ar_c * {geometric(ar)} "
        f"ELSE {p}_last + {moved} END"
    )


def _level_statistic(z: np.ndarray) -> float:
    """KPSS statistic of a level-stationary series (Kwiatkowski et al. 1992). The window is at most an eighth of the series, or a short one would hide its own trend."""
    n = len(z)
    e = z - z.mean()
    lags = min(int(4 * (n / 100) ** 0.25), n // 8)
    spread = e @ e / n + 2 / n * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * spread)) if spread > 0 else 0.0


def _lagged(v: np.ndarray, count: int, start: int) -> np.ndarray:
    """The values 1..count steps before each position from `start` on, one column per step."""
    return np.column_stack([v[start - j : len(v) - j] for j in range(1, count + 1)])


def _regressions(z: np.ndarray, orders: list[tuple[int, int]]) -> np.ndarray:
    """Estimates of every order by regression (Hannan and Rissanen), as partial autocorrelations: where the likelihood search begins.

    The errors of a long autoregression stand in for the shocks. All orders use the same rows, so their normal equations are blocks of one small matrix. A series
    too short for that begins at zero."""
    n, out = len(z), np.zeros((len(orders), 2 * MOST))
    most = max(1, min(n // 6, 20))
    start = most + MOST
    rows = n - start
    if rows < 4:
        return out
    z = z - z.mean()
    past = _lagged(z, most, most)
    shocks = np.r_[np.zeros(most), z[most:] - past @ np.linalg.lstsq(past, z[most:], rcond=None)[0]]
    target = z[start:]
    design = np.hstack([np.ones((rows, 1)), _lagged(z, MOST, start), _lagged(shocks, MOST, start)])
    gram, cross = design.T @ design, design.T @ target
    for k, (p, q) in enumerate(orders):
        used = [0, *range(1, 1 + p), *range(1 + MOST, 1 + MOST + q)]
        if len(used) + 2 > rows:
            continue
        b = np.linalg.lstsq(gram[np.ix_(used, used)], cross[used], rcond=None)[0]
        out[k, :p], out[k, MOST : MOST + q] = partials(b[1 : 1 + p]), partials(-b[1 + p :])
    return out


def _asked(y: np.ndarray, at: np.ndarray | None = None) -> tuple:
    """What `fit` needs for one series: d by the level test (5 % point 0.463), and all candidates with where their search begins."""
    y = np.asarray(y, dtype=float)
    at = np.arange(len(y)) if at is None else np.asarray(at)
    z, d = y, 0
    while d < 2 and len(z) > 4 and _level_statistic(z) > 0.463:
        z, d = np.diff(z), d + 1
    constants = {0: (True,), 1: (False, True), 2: (False,)}[d]
    orders = [(p, q) for p in range(MOST + 1) for q in range(MOST + 1)]
    starts = np.tile(_regressions(z, orders), (len(constants), 1))
    return y, at, d, [(p, q, c) for c in constants for p, q in orders], starts


def fit_one(y: np.ndarray, at: np.ndarray | None = None) -> Fitted:
    """The model of one series: d by the level test, p, q up to 5 and the constant by exact likelihood and corrected AIC.

    One method for every length; `at` are the whole-numbered periods of the values, and periods between them are missing, not closed up. A mean belongs to every model without
    differences, a drift is a candidate with one difference, and two differences have no constant."""
    return fit_all([_asked(y, at)])[0]


def _search_all(parts: list[tuple[np.ndarray, int, np.ndarray | None]]) -> list[tuple[np.ndarray, str]]:
    """For each `(y, steps, at)` the forecasts of the `steps` periods behind the series, and the order."""
    models = fit_all([_asked(y, at) for y, _, at in parts])
    return [(m.ahead(steps), "({},{},{})".format(*m.order)) for m, (_, steps, _) in zip(models, parts, strict=True)]


def _search_one(y: np.ndarray, steps: int, at: np.ndarray | None = None) -> tuple[np.ndarray, str]:
    return _search_all([(y, steps, at)])[0]


def _searched_rows(table: pa.Table, keys: list[str]) -> pa.Table:
    """The result rows of whole series that lie one after another."""
    column = {c: table.column(c).to_numpy() for c in ("_pos", "_n", "_n_test", "_train", "_at", "_y", "_steps")}
    parts, places = [], []
    for low in np.flatnonzero(column["_pos"] == 1):
        n, n_test, steps = (int(column[c][low]) for c in ("_n", "_n_test", "_steps"))
        y, at = column["_y"][low : low + n], column["_at"][low : low + n]
        if column["_train"][low : low + n].any():
            past = n - n_test
            parts.append((y[:past], int(at[-1] - at[past - 1]), at[:past]))
            places.append((low, np.arange(past + 1, n + 1), at[past:] - at[past - 1] - 1))
        if steps > 0:
            parts.append((y, steps, at))
            places.append((low, np.arange(n + 1, n + steps + 1), np.arange(steps)))
    found = _search_all(parts)
    sizes = [len(pos) for _, pos, _ in places]
    out = table.select(keys).take(pa.array(np.repeat(np.array([low for low, _, _ in places], dtype=np.int64), sizes)))
    out = out.append_column("_pos", pa.array(np.concatenate([np.zeros(0), *[pos for _, pos, _ in places]]), pa.float64()).cast(pa.int32()))
    out = out.append_column("arima_pred", pa.array(np.concatenate([np.zeros(0), *[f[0][own] for f, (_, _, own) in zip(found, places, strict=True)]])))
    return out.append_column("arima_order", pa.array(np.repeat([f[1] for f in found], sizes).tolist(), pa.string()))


def search_arima(frame: DataFrame, keys: list[str], time: str, value: str, horizon: str) -> DataFrame:
    """Rows `(keys..., _pos, arima_pred, arima_order)` for the test rows (fitted on the training rows)
    and for the future positions (fitted on all rows). `frame` comes from `holdout_frame`; the column
    `horizon` holds the number of future periods. Periods without a row are missing values. The series of a partition lie one after another; those of an
    Arrow batch are searched side by side."""
    source = frame.select(
        *keys, "_pos", "_n", "_n_test", "_train", F.col(time).cast("long").alias("_at"), F.col(value).cast("double").alias("_y"),
        F.col(horizon).cast("int").alias("_steps"),
    )
    schema = source.select(*keys).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            starts = np.flatnonzero(rest.column("_pos").to_numpy() == 1)
            last = int(starts[-1]) if len(starts) else 0
            if last:
                yield from _searched_rows(rest.slice(0, last), keys).to_batches()
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield from _searched_rows(rest, keys).to_batches()

    placed = spread(source, *keys).sortWithinPartitions(*keys, "_pos")
    return placed.mapInArrow(run, f"{schema}, _pos int, arima_pred double, arima_order string")
