"""Seeded panels with known parameters (square-root scale)."""

import datetime as dt

import numpy as np
import pandas as pd

MONDAY = dt.date(2009, 1, 5)
EFFECTS = (1.5, 0.8, 0.4)


def weeks(n):
    return [MONDAY + dt.timedelta(days=7 * i) for i in range(n)]


def _table(root, flags):
    n, series = root.shape
    frames = []
    for s in range(series):
        frame = pd.DataFrame(
            {
                "week": weeks(n),
                "store_id": str(s % 7),
                "upc_id": f"U{s:03d}",
                "units": np.maximum(root[:, s], 0.0) ** 2,
            }
        )
        for i, name in enumerate(("feature", "display", "tpr_only")):
            frame[name] = flags[:, s, i].astype("int32")
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


def ar1_promo(series=60, n=156, lag_effect=0.0, seed=7):
    rng = np.random.default_rng(seed)
    flags = (rng.random((n, series, 3)) < 0.2).astype(float)
    noise = np.zeros((n, series))
    for t in range(1, n):
        noise[t] = 0.6 * noise[t - 1] + rng.normal(0, 0.5, series)
    lagged = np.concatenate([np.zeros((1, series)), flags[:-1].sum(-1)])
    return _table(8 + flags @ np.array(EFFECTS) + lag_effect * lagged + noise, flags)


def seasonal(series=20, n=156, seed=8):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None]
    root = 10 + 2 * np.sin(2 * np.pi * t / 52) + 0.01 * t + rng.normal(0, 0.3, (n, series))
    return _table(root, np.zeros((n, series, 3)))


def level_only(series=40, n=156, alpha=0.3, seed=9):
    rng = np.random.default_rng(seed)
    level = np.full(series, 20.0)
    root = np.zeros((n, series))
    for t in range(n):
        shock = rng.normal(0, 0.5, series)
        root[t] = level + shock
        level = level + alpha * shock
    return _table(root, np.zeros((n, series, 3)))


def punch_gaps(table, share=0.08, seed=3):
    """Drop interior rows at random; first and last weeks stay."""
    rng = np.random.default_rng(seed)
    edge = table["week"].isin([table["week"].min(), table["week"].max()])
    return table[edge | (rng.random(len(table)) > share)].reset_index(drop=True)
