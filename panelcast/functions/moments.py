"""Sums of products over time, and regressions read off them.

A series enters as its values and regressors over time and becomes one symmetric matrix: the sums of products of
z = (1, y now and 1 to 3 steps back, every regressor now and 1 to 3 steps back) over the steps whose value is known.
Such matrices add up over disjoint steps. Every candidate regression is a set of linear combinations of z, so it
is read off that one matrix.
"""

from __future__ import annotations

import numpy as np

#: Steps back that z holds, and the first step that has them all, those of lagged regressors included.
LAGS, FIRST = 3, 4
#: A regressor of which others explain all but this share is left out.
DEAD = 1e-7
#: Both roots of an autoregression stay this far inside the unit circle.
EDGE = 0.995
#: (order, differences), in the order in which ties are settled.
ORDERS = tuple((p, d) for d in (0, 1) for p in (0, 1, 2))


def width(regressors: int) -> int:
    return (LAGS + 1) * (1 + regressors) + 1


def products(y: np.ndarray, known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix of one series: y (filled), which of it counts, x (steps x regressors; unknown is 0)."""
    n, k = x.shape
    at = np.arange(FIRST, n)
    at = at[known[FIRST:]] if n > FIRST else at[:0]
    z = np.empty((len(at), width(k)))
    z[:, 0] = 1.0
    for lag in range(LAGS + 1):
        z[:, 1 + lag] = y[at - lag]
        z[:, 1 + LAGS + 1 + lag * k : 1 + LAGS + 1 + (lag + 1) * k] = x[at - lag]
    return z.T @ z


def sweep(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual sum and which regressors live, from stacked matrices whose last row is the response.

    Pivots go in order; one that those before it explain is dropped.
    """
    m = m.copy()
    size = m.shape[1] - 1
    start = np.einsum("skk->sk", m).copy()
    alive = np.zeros((len(m), size), bool)
    for s in range(size):
        pivot = m[:, s, s]
        live = pivot > DEAD * start[:, s]
        alive[:, s] = live
        row = np.where(live[:, None], m[:, s, :] / np.where(live, pivot, 1.0)[:, None], 0.0)
        column = np.where(live[:, None], m[:, :, s], 0.0)
        m -= column[:, :, None] * row[:, None, :]
        m[:, s, :] = row
        m[:, :, s] = 0.0
    return m[:, :size, -1] * alive, np.maximum(m[:, -1, -1], 0.0), alive


def _differenced(lag: int, d: int, start: int, stride: int, size: int) -> np.ndarray:
    """Weights on z of one quantity `lag` steps back, differenced d times."""
    out = np.zeros(size)
    out[start + lag * stride] = 1.0
    if d:
        out[start + (lag + 1) * stride] -= 1.0
    return out


def fit(m: np.ndarray, k: int, uses: list[int], lagged: list[bool], p: int, d: int) -> dict[str, np.ndarray]:
    """Regression on the regressors `uses` with autoregressive errors of order p, for stacked matrices.

    First an unrestricted regression on lags of the response and of the regressors gives the autoregression (the
    lags of a regressor that isn't `lagged` are combinations of others); then response and regressors, filtered by
    it, give the effects. Both are least squares over the same steps.
    """
    size, n = m.shape[1], m[:, 0, 0]
    base = 1 + LAGS + 1
    y = [_differenced(lag, d, 1, 1, size) for lag in range(p + 1)]
    x = {(c, lag): _differenced(lag, d, base + c, k, size) for c in uses for lag in range(p + 1)}
    one = np.eye(size)[0]
    phi = np.zeros((len(m), 2))
    ok = n > 0
    if p:
        free = [x[c, lag] for c in uses for lag in range(p + 1) if lag == 0 or lagged[c]]
        rows = np.array(([] if d else [one]) + y[1:] + free + [y[0]])
        coef, _, alive = sweep(rows @ m @ rows.T)
        phi[:, :p] = coef[:, 1 - d : 1 - d + p]
        ok = ok & (n - alive.sum(1) > 1) & (np.abs(phi[:, 1]) < EDGE) & (phi[:, 1] + np.abs(phi[:, 0]) < EDGE)
        phi = np.where(ok[:, None], phi, 0.0)
    taps = np.concatenate([np.ones((len(m), 1)), -phi[:, :p]], 1)
    rows = [taps @ np.array([x[c, lag] for lag in range(p + 1)]) for c in uses]
    rows = ([] if d else [taps.sum(1)[:, None] * one]) + rows + [taps @ np.array(y)]
    a = np.stack(rows, 1)
    coef, rss, alive = sweep(a @ m @ a.transpose(0, 2, 1))
    rank = alive.sum(1)
    params = rank + d + p + 1  # a difference stands for the constant: the level it starts from
    room = n - params - 1
    ok = ok & (room > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.maximum(rss / n, 1e-12)
        aicc = n * (np.log(2 * np.pi * variance) + 1) + 2 * params + 2 * params * (params + 1) / room
    beta = np.zeros((len(m), k))
    beta[:, uses] = coef[:, 1 - d :]
    return {
        "const": coef[:, 0] if not d else np.zeros(len(m)),
        "beta": beta,
        "phi": phi,
        "sigma2": rss / np.maximum(n - rank - p, 1),
        "aicc": np.where(ok, aicc, np.nan),
    }
