"""Exact Gaussian likelihood of ARIMA models by a Kalman filter, for many parameter vectors of one series at a time.

The model is in state-space form: `d` levels with a wide start (the first `d` observations carry no likelihood), then an ARMA state whose start is its
stationary distribution. Missing periods are steps without an observation, so a gap costs no refit and needs no filling in. The constant (a mean without differences, a
drift with one) is estimated by generalised least squares inside the filter, and the variance is concentrated out. Parameters are partial
autocorrelations, so every point of the search is stationary and invertible.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MOST = 5  # largest p and q
STATE = MOST + 1
EDGE = 0.999  # largest absolute partial autocorrelation
WIDE = 1e6  # variance of a level before the first observation, the series being scaled
VARIANCE_FLOOR = 1e-12
SCREENED = 12  # candidates that are optimised, the best by likelihood at the regression's estimates
ROUNDS = 40
ROWS = 1024  # candidates' parameters that go through the time steps at once
MOST_GONE = 4  # missing periods of a series that is fitted side by side with others; one with more has a filter of its own


def coefficients(partial: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions from partial autocorrelations, row by row (Durbin and Levinson)."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        last = partial[:, k : k + 1]
        out[:, :k] -= last * out[:, :k][:, ::-1].copy()
        out[:, k] = last[:, 0]
    return out


def partials(coefs: np.ndarray) -> np.ndarray:
    """The partial autocorrelations of one autoregression, held inside the stationary region."""
    a, out = coefs.astype(float).copy(), np.zeros(len(coefs))
    for k in reversed(range(len(a))):
        out[k] = np.clip(a[k], -0.97, 0.97)
        if k:
            head = a[:k].copy()
            a = (head + out[k] * head[::-1]) / (1 - out[k] ** 2)
    return out


def _moved(phi: np.ndarray, x: np.ndarray, d: int) -> np.ndarray:
    """The transition applied to columns of states."""
    out = np.empty_like(x)
    arma = out[:, d:]
    np.multiply(phi[:, :, None], x[:, d : d + 1], out=arma)
    arma[:, :-1] += x[:, d + 1 :]
    if d:
        out[:, d - 1] = x[:, d - 1] + x[:, d]
    if d == 2:
        out[:, 0] = out[:, 1] + x[:, 0]
    return out


def _stationary(phi: np.ndarray, shock: np.ndarray) -> np.ndarray:
    """Covariance of the ARMA state, as the sum of all its past shocks by doubling."""
    step = np.zeros((len(phi), STATE, STATE))
    step[:, :, 0] = phi
    step[:, np.arange(STATE - 1), np.arange(1, STATE)] = 1
    total = shock[:, :, None] * shock[:, None, :]
    for _ in range(16):
        total = total + step @ total @ step.transpose(0, 2, 1)
        step = step @ step
        if np.abs(step).max() < 1e-8:
            break
    return total


class Filter:
    """The filter over one series for rows of parameters. `y` are the observed values, `at` their periods, and `lift` the regressor of the constant."""

    def __init__(self, y: np.ndarray, at: np.ndarray, d: int):
        self.d, self.n = d, len(y)
        self.gaps = np.diff(at)
        self.data = np.column_stack([y, (at - at[0]).astype(float) ** d if d < 2 else np.zeros(len(y))])

    def run(self, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the products of the scaled innovations of series and regressor, the sum of the log variances, and the state for the period behind the last."""
        d, rows = self.d, len(phi)
        shock = np.concatenate((np.ones((rows, 1)), theta), axis=1)
        phi = np.concatenate((phi, np.zeros((rows, STATE - phi.shape[1]))), axis=1)
        size = d + STATE
        p = np.zeros((rows, size, size))
        p[:, d:, d:] = _stationary(phi, shock)
        p[:, np.arange(d), np.arange(d)] = WIDE
        noise = np.zeros((rows, size, size))
        noise[:, d:, d:] = shock[:, :, None] * shock[:, None, :]
        a = np.zeros((rows, size, 2))
        products, logs = np.zeros((rows, 2, 2)), np.zeros(rows)
        gain = variance = None
        steady = False
        for t in range(self.n):
            if not steady:
                seen = p[:, :, : d + 1].sum(axis=2)
                variance = np.maximum(seen[:, : d + 1].sum(axis=1), 1.0)  # the newest shock is in every innovation
                gain = seen / variance[:, None]
            v = self.data[t] - a[:, : d + 1].sum(axis=1)
            if t >= d:
                products += v[:, :, None] * (v / variance[:, None])[:, None, :]
                logs += np.log(variance)
            a = _moved(phi, a + gain[:, :, None] * v[:, None, :], d)
            gap = int(self.gaps[t]) if t < self.n - 1 else 1
            if not steady:
                before = p
                p = p - gain[:, :, None] * seen[:, None, :]
                p = _moved(phi, _moved(phi, p, d).transpose(0, 2, 1), d) + noise
                steady = gap == 1 and t > size and float(np.abs(p - before).max()) < 1e-9
            if gap > 1:
                a, p = self._over(phi, noise, a, p, gap - 1)
                steady = False
        return products, logs, a

    def _over(self, phi: np.ndarray, noise: np.ndarray, a: np.ndarray, p: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """States and covariances after `gap` more periods without an observation, by doubling the step."""
        step = _moved(phi, np.broadcast_to(np.eye(a.shape[1]), p.shape).copy(), self.d)
        while gap:
            if gap & 1:
                a, p = step @ a, step @ p @ step.transpose(0, 2, 1) + noise
            noise = noise + step @ noise @ step.transpose(0, 2, 1)
            step, gap = step @ step, gap >> 1
        return a, p

    def likelihood(self, partial: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row of (AR, MA) partial autocorrelations: the log-likelihood, the constant, the variance and the last state."""
        phi, theta = coefficients(partial[:, :MOST]), -coefficients(partial[:, MOST:])
        products, logs, state = self.run(phi, theta)
        m = max(self.n - self.d, 1)
        has = constant & (products[:, 1, 1] > 1e-12)
        mean = np.where(has, products[:, 0, 1] / np.where(has, products[:, 1, 1], 1.0), 0.0)
        variance = np.maximum((products[:, 0, 0] - mean * products[:, 0, 1]) / m, VARIANCE_FLOOR)
        return -0.5 * (m * (np.log(2 * np.pi * variance) + 1) + logs), mean, variance, state


class Together:
    """The same likelihood for many series side by side, each a `(y, at)` with equally many missing periods and `d` differences that its first `d + 1` periods allow.

    A filter whose state starts stationary and sees every period needs no covariance matrices: gain and variance follow from one vector each (Levinson's recursion on the
    state). Levels are differenced away, and a missing value is one more unknown: its unit vector is filtered like the regressor and integrated out."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], d: int):
        self.d, self.seen = d, np.array([len(y) for y, _ in parts])
        spans = [int(at[-1] - at[0]) + 1 for _, at in parts]
        self.lift = 1 if d < 2 else 0
        self.gone = spans[0] - len(parts[0][0])
        width = 1 + self.lift + self.gone
        self.data = np.zeros((max(spans) - d, width, len(parts)))
        self.weight = np.zeros((max(spans) - d, len(parts)))
        for s, ((y, at), span) in enumerate(zip(parts, spans, strict=True)):
            x, held = np.zeros((span, width)), at - at[0]
            x[held, 0] = y
            if self.lift:
                x[:, 1] = np.arange(span, dtype=float) ** d
            for k, t in enumerate(np.setdiff1d(np.arange(span), held)):
                x[t, 1 + self.lift + k] = 1.0
            self.data[: span - d, :, s] = np.diff(x, n=d, axis=0)
            self.weight[: span - d, s] = 1.0

    def likelihood(self, partial: np.ndarray, constant: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The log-likelihood per row of partial autocorrelations; `which` is the row's series."""
        out = [self._block(partial[i : i + ROWS].T, constant[i : i + ROWS], which[i : i + ROWS]) for i in range(0, len(partial), ROWS)]
        return np.concatenate(out) if out else np.zeros(0)

    def _block(self, partial: np.ndarray, constant: np.ndarray, which: np.ndarray) -> np.ndarray:
        phi, variance, gain = _stationary_gain(partial[:MOST], partial[MOST:])
        step, data, weight = gain.copy(), self.data[:, :, which], self.weight[:, which]
        a = np.zeros((STATE, data.shape[1], data.shape[2]))
        products, logs = np.zeros((data.shape[1], *a.shape[1:])), np.zeros(a.shape[2])
        steady = False
        for t in range(len(data)):
            v = (data[t] - a[0]) * weight[t]
            products += v[:, None] * (v / variance)[None]
            logs += weight[t] * np.log(variance)
            moved = phi[:, None] * a[0]
            moved[:-1] += a[1:]
            moved += gain[:, None] * v
            a = moved
            if not steady:
                first = step[0].copy()
                left = 1.0 - first * first
                moved = phi * first
                moved[:-1] += step[1:]
                gain = (gain - moved * first) / left
                step = moved - gain * first
                variance = np.maximum(variance * left, 1.0)
                steady = t % 8 == 7 and float(np.abs(step).max()) < 1e-10
        kept = 1 + self.lift
        whole = np.moveaxis(products, 2, 0)
        if self.gone:
            inner = whole[:, kept:, kept:]
            logs = logs + np.linalg.slogdet(inner)[1]
            whole = whole[:, :kept, :kept] - whole[:, :kept, kept:] @ np.linalg.solve(inner, whole[:, kept:, :kept])
        total = whole[:, 0, 0]
        if self.lift:
            has = constant & (whole[:, 1, 1] > 1e-12)
            mean = np.where(has, whole[:, 0, 1] / np.where(has, whole[:, 1, 1], 1.0), 0.0)
            total = total - mean * whole[:, 0, 1]
        m = np.maximum(self.seen[which] - self.d, 1)
        return -0.5 * (m * (np.log(2 * np.pi * np.maximum(total / m, VARIANCE_FLOOR)) + 1) + logs)


def _stationary_gain(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column of partial autocorrelations: the autoregression, the variance of the first observation and the gain that carries it into the next state."""
    rows = ar.shape[1]
    phi, theta = np.zeros((STATE, rows)), np.ones((STATE, rows))
    theta[1:] = -coefficients(ma.T).T
    free = np.zeros((2 * STATE, rows))  # autocovariances of the autoregression alone
    free[0] = left = 1.0 / np.prod(1.0 - ar * ar, axis=0)
    for k in range(MOST):
        free[k + 1] = ar[k] * left + (phi[:k] * free[1 : k + 1][::-1]).sum(axis=0)
        left = left * (1.0 - ar[k] * ar[k])
        phi[:k] -= ar[k] * phi[:k][::-1].copy()
        phi[k] = ar[k]
    for h in range(STATE, 2 * STATE):
        free[h] = (phi[:MOST] * free[h - MOST : h][::-1]).sum(axis=0)
    spread = [(theta[: STATE - k] * theta[k:]).sum(axis=0) for k in range(STATE)]
    own = [sum(spread[abs(k)] * free[abs(h + k)] for k in range(1 - STATE, STATE)) for h in range(STATE)]
    answer = [np.ones(rows)]  # of the series to a shock
    for k in range(1, STATE):
        answer.append(theta[k] + sum(phi[i] * answer[k - 1 - i] for i in range(k)))
    shared = np.zeros((STATE + 1, rows))  # covariances of the state with the observation
    shared[0] = own[0]
    for j in range(1, STATE):
        shared[j] = sum((phi[i] * own[1 + i - j] if i < MOST else 0.0) + theta[i] * answer[i - j] for i in range(j, STATE))
    return phi, np.maximum(own[0], 1.0), (phi * own[0] + shared[1:]) / own[0]


@dataclass
class Fitted:
    """A fitted model: its order, log-likelihood, criterion, AR and MA coefficients, the constant, the innovations' variance, and what a forecast needs."""

    order: tuple[int, int, int]
    constant: bool
    loglik: float
    aicc: float
    phi: np.ndarray
    theta: np.ndarray
    mean: float
    sigma2: float
    state: np.ndarray
    origin: float
    scale: float
    span: int

    def ahead(self, steps: int) -> np.ndarray:
        """Forecasts of the periods behind the last one."""
        d, x, out = self.order[1], self.state[None], []
        phi = np.concatenate((self.phi, np.zeros(STATE - len(self.phi))))[None]
        for h in range(1, steps + 1):
            series, regressor = x[0, : d + 1].sum(axis=0)
            lift = float(self.span + h) ** d if d < 2 else 0.0
            out.append(series + self.mean * (lift - regressor))
            x = _moved(phi, x, d)
        return self.origin + self.scale * np.array(out)


def _searched(worths_of: Callable[[np.ndarray, np.ndarray], np.ndarray], sizes: np.ndarray, start: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The partial autocorrelations of largest likelihood, for all candidates side by side: quasi-Newton steps on their inverse hyperbolic tangents.

    `worths_of` gives the log-likelihood of rows of parameters and of the candidates that they belong to, `sizes` the length of each candidate's series."""

    def worth(z: np.ndarray, which: np.ndarray) -> np.ndarray:
        return -worths_of(EDGE * np.tanh(z) * free[which], which)

    def slopes(z: np.ndarray, which: np.ndarray) -> np.ndarray:
        row, column = np.nonzero(free[which])
        out = np.zeros(z.shape)
        if len(row):
            moved = np.repeat(z[row][None], 2, axis=0)
            moved[0, np.arange(len(row)), column] += 1e-4
            moved[1, np.arange(len(row)), column] -= 1e-4
            both = worth(moved.reshape(-1, z.shape[1]), np.tile(which[row], 2)).reshape(2, -1)
            out[row, column] = (both[0] - both[1]) / 2e-4
        return out

    n, width = start.shape
    z = np.arctanh(np.clip(start / EDGE, -0.99, 0.99)) * free
    every = np.arange(n)
    value, slope = worth(z, every), slopes(z, every)
    bend = np.eye(width)[None] / np.maximum(1.0, sizes / 4)[:, None, None]
    lengths = np.array([2.0, 1.0, 0.5, 0.2, 0.05])
    active = np.flatnonzero(free.any(axis=1))
    for _ in range(ROUNDS):
        if not len(active):
            break
        step = -np.einsum("nij,nj->ni", bend[active], slope[active]) * free[active]
        step *= np.minimum(1.0, 1.5 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))
        tried = z[active][:, None] + lengths[None, :, None] * step[:, None]
        worths = worth(tried.reshape(-1, width), np.repeat(active, len(lengths))).reshape(len(active), -1)
        best = worths.argmin(axis=1)
        gain = value[active] - worths[np.arange(len(active)), best]
        better = gain > 1e-7
        moved, old = active[better], slope[active[better]].copy()
        s = lengths[best[better]][:, None] * step[better]
        z[moved] += s
        value[moved] = worths[np.arange(len(worths)), best][better]
        active = active[gain > 1e-5]
        if len(moved):
            slope[moved] = slopes(z[moved], moved)
            y = slope[moved] - old
            curve = (s * y).sum(axis=1)
            good = curve > 1e-10
            s, y, curve, moved = s[good], y[good], curve[good, None, None], moved[good]
            left = np.eye(width) - s[:, :, None] * y[:, None, :] / curve
            bend[moved] = left @ bend[moved] @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / curve
    return EDGE * np.tanh(z) * free


class _Task:
    """One series to be fitted: its values scaled, its candidates and what they may use."""

    def __init__(self, y: np.ndarray, at: np.ndarray, d: int, candidates: list[tuple[int, int, bool]], starts: np.ndarray):
        self.at, self.d, self.candidates, self.starts = at, d, candidates, starts
        self.origin = float(y[0]) if d else float(y.mean())
        steps = np.diff(y, n=d) if len(y) > d else y - self.origin
        spread = float(np.abs(steps).max()) if len(steps) else 0.0
        scale = float((steps / spread).std() * spread) if spread > 0 else 0.0
        self.scale = scale if scale > 1e-9 * spread and scale > 0 else (spread or 1.0)
        self.y = (y - self.origin) / self.scale
        self.m = max(len(y) - d, 1)
        self.count = np.array([p + q + c + 1 for p, q, c in candidates])
        self.room = self.m - self.count - 1
        self.usable = np.flatnonzero(self.room > 0)
        if not len(self.usable):
            self.usable = np.flatnonzero(self.count == self.count.min())
        self.free = np.array([[*(k < p for k in range(MOST)), *(k < q for k in range(MOST))] for p, q, _ in candidates])
        self.constant = np.array([c for _, _, c in candidates])

    @property
    def kind(self) -> tuple[int, int] | None:
        """Tasks of one kind are fitted side by side."""
        gone = int(self.at[-1] - self.at[0]) + 1 - len(self.at)
        begins = len(self.at) > self.d and int(self.at[self.d] - self.at[0]) == self.d
        return (self.d, gone) if gone <= MOST_GONE and begins else None

    def criterion(self, loglik: np.ndarray, which: np.ndarray) -> np.ndarray:
        left = np.maximum(self.room[which], 0.5)
        return -2 * loglik + 2 * self.count[which] + 2 * self.count[which] * (self.count[which] + 1) / left

    def fitted(self, loglik: np.ndarray, partial: np.ndarray) -> Fitted:
        score = self.criterion(loglik, self.usable)
        # Among models that tell nothing apart the smallest is taken.
        best = min(np.flatnonzero(score < score.min() + 1e-4), key=lambda i: (self.count[self.usable[i]], self.usable[i]))
        p, q, c = self.candidates[self.usable[best]]
        partial = partial[best : best + 1]
        loglik, mean, sigma2, state = Filter(self.y, self.at, self.d).likelihood(partial, np.array([c]))
        score, units = self.criterion(loglik, self.usable[best : best + 1]), -self.m * np.log(self.scale)
        return Fitted(
            (p, self.d, q), c, float(loglik[0] + units), float(score[0] - 2 * units), coefficients(partial[:, :MOST])[0], -coefficients(partial[:, MOST:])[0],
            float(mean[0]), float(sigma2[0]) * self.scale * self.scale, state[0], self.origin, self.scale, int(self.at[-1] - self.at[0]),
        )


def _fit_alike(tasks: list[_Task], together: bool) -> list[Fitted]:
    """Fits tasks of one kind; `together` tells whether they are filtered side by side (if not, there is one task)."""
    if together:
        run = Together([(t.y, t.at) for t in tasks], tasks[0].d)
    else:
        alone = Filter(tasks[0].y, tasks[0].at, tasks[0].d)

    def likelihood(partial: np.ndarray, constant: np.ndarray, which: np.ndarray) -> np.ndarray:
        return run.likelihood(partial, constant, which) if together else alone.likelihood(partial, constant)[0]

    def gathered(of: Callable[[_Task], np.ndarray]) -> np.ndarray:
        return np.concatenate([of(t) for t in tasks])

    def owners() -> np.ndarray:
        return np.repeat(np.arange(len(tasks)), [len(t.usable) for t in tasks])

    def cuts() -> np.ndarray:
        return np.cumsum([len(t.usable) for t in tasks])[:-1]

    first = likelihood(gathered(lambda t: t.starts[t.usable] * t.free[t.usable]), gathered(lambda t: t.constant[t.usable]), owners())
    for t, own in zip(tasks, np.split(first, cuts()), strict=True):
        t.usable = t.usable[np.argsort(t.criterion(own, t.usable), kind="stable")[:SCREENED]]
    owner, constant = owners(), gathered(lambda t: t.constant[t.usable])
    sizes = np.array([len(t.y) for t in tasks])[owner]
    starts, free = gathered(lambda t: t.starts[t.usable]), gathered(lambda t: t.free[t.usable])
    partial = _searched(lambda z, which: likelihood(z, constant[which], owner[which]), sizes, starts, free)
    loglik = likelihood(partial, constant, owner)
    return [t.fitted(a, b) for t, a, b in zip(tasks, np.split(loglik, cuts()), np.split(partial, cuts()), strict=True)]


def fit_all(series: list[tuple[np.ndarray, np.ndarray, int, list[tuple[int, int, bool]], np.ndarray]]) -> list[Fitted]:
    """`fit` for many series, given as its arguments. Those of one kind go through the search side by side; no result depends on which others are there."""
    tasks = [_Task(*s) for s in series]
    kinds: dict[tuple, list[int]] = {}
    for i, t in enumerate(tasks):
        kinds.setdefault(t.kind or (i,), []).append(i)
    out: list = [None] * len(tasks)
    for kind, members in kinds.items():
        for i, model in zip(members, _fit_alike([tasks[i] for i in members], len(kind) > 1), strict=True):
            out[i] = model
    return out


def fit(y: np.ndarray, at: np.ndarray, d: int, candidates: list[tuple[int, int, bool]], starts: np.ndarray) -> Fitted:
    """The best of some `(p, q, constant)` with `d` differences by corrected AIC. `starts` has (AR, MA) partial autocorrelations of each, from which the search
    begins, so no model ends below them. `y` are the observed values in order and `at` their whole-numbered periods."""
    return fit_all([(y, at, d, candidates, starts)])[0]
