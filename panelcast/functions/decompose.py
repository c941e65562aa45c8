"""Seasonal-trend decomposition by loess.

Without robustness weights the decomposition is linear in the data: for a given
length it is one pair of matrices, shared by every series of that length.
"""

from __future__ import annotations

import numpy as np

PERIOD = 52
SEASON_WINDOW = 13


def _next_odd(v):
    v = int(np.ceil(v))
    return v + 1 - v % 2


def loess_matrix(n, window, degree, at):
    """Rows of weights: smoothed value at each position of `at` from values at 0..n-1."""
    j = np.arange(n, dtype=float)
    r = np.abs(np.asarray(at, float)[:, None] - j)
    ranked = np.sort(r, 1)
    reach = ranked[:, min(window, n) - 1] * max(1.0, window / n)
    u = np.clip(r / np.maximum(reach, 1e-9)[:, None], 0, 1)
    w = (1 - u**3) ** 3
    w /= w.sum(1, keepdims=True)
    if degree:
        centre = (w * j).sum(1, keepdims=True)
        spread = (w * (j - centre) ** 2).sum(1, keepdims=True)
        slope = (np.asarray(at, float)[:, None] - centre) / np.where(spread > 1e-6, spread, np.inf)
        w = w * (1 + slope * (j - centre))
    return w


def _moving_average(n, width):
    m = np.zeros((n - width + 1, n))
    for i in range(len(m)):
        m[i, i : i + width] = 1.0 / width
    return m


def stl_matrices(n, period=PERIOD, season_window=SEASON_WINDOW, passes=2):
    """(trend, seasonal) matrices for length `n`; seasonal is zero below two full periods."""
    trend_window = _next_odd(1.5 * period / (1 - 1.5 / season_window))
    eye = np.eye(n)
    smooth = loess_matrix(n, trend_window, 1, np.arange(n))
    if n < 2 * period:
        return smooth, np.zeros((n, n))
    # Each calendar week's own values, smoothed and stretched one cycle both ways.
    cycle = np.zeros((n + 2 * period, n))
    for phase in range(period):
        at = np.arange(phase, n, period)
        w = loess_matrix(len(at), season_window, 0, np.arange(-1, len(at) + 1))
        cycle[np.ix_(np.arange(len(at) + 2) * period + phase, at)] = w
    low = _moving_average(n + 2, 3) @ _moving_average(n + 1 + period, period)
    low = low @ _moving_average(n + 2 * period, period)
    low = loess_matrix(n, _next_odd(period), 1, np.arange(n)) @ low
    trend = np.zeros((n, n))
    for _ in range(passes):
        c = cycle @ (eye - trend)
        seasonal = c[period : period + n] - low @ c
        trend = smooth @ (eye - seasonal)
    return trend, seasonal
