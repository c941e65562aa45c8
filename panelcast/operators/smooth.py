"""Exponential smoothing as folds over each series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.spec import WEEKLY, PanelSpec, deal_series

ALPHA_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
# Level gains, slope gains as shares of them, and dampings that are tried; 1 is undamped (fixed grid).
COARSE = tuple(round(0.05 + 0.1 * i, 2) for i in range(10))
SHARES = (0.02, 0.1, 0.3)
DAMPINGS = (0.8, 0.9, 0.98)
#: Steps of the level gain around the best coarse one.
FINE = tuple(round(0.01 * i, 2) for i in range(-5, 6))
#: Values that give the first slope.
OPENING = 10
#: Series that are searched at once.
LANES = 512
#: Parameters that each form estimates, its starting values and variance among them.
PARAMS = {"level": 3, "trend": 5, "damped": 6}


def _ordered(df: DataFrame, value: str, spec: PanelSpec) -> DataFrame:
    point = F.struct(F.col(spec.index).alias("t"), F.col(value).cast("double").alias("y"))
    known = df.where(F.col(value).isNotNull())
    rows = known.groupBy(*spec.keys).agg(F.array_sort(F.collect_list(point)).alias("s"))
    values = rows.select(*spec.keys, F.transform("s", lambda p: p["y"]).alias("y"))
    return deal_series(values, cost=F.size("y"), keys=spec.keys)


def _smooth(alpha: Column) -> Column:
    """(level, sse) after folding the ordered values; the first value is the first level."""
    start = F.struct(F.get("y", F.lit(0)).alias("level"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        error = y - s["level"]
        return F.struct(
            (s["level"] + alpha * error).alias("level"), (s["sse"] + error * error).alias("sse")
        )

    return F.aggregate("y", start, step)


def simple_smoothing(
    df: DataFrame, value: str, alpha: float, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """Final level and squared one-step error per series at a given alpha; NULLs are skipped."""
    rows = _ordered(df, value, spec).withColumn("_f", _smooth(F.lit(float(alpha))))
    return rows.select(
        *spec.keys, F.size("y").alias("n_obs"), F.col("_f.level").alias("level"), F.col("_f.sse").alias("sse")
    )


def best_smoothing(
    df: DataFrame,
    value: str,
    alphas: Sequence[float] = ALPHA_GRID,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """The alpha of the grid with the smallest squared error; the smallest alpha wins a tie."""
    grid = F.array(*[F.lit(float(a)) for a in alphas])

    def trial(alpha: Column) -> Column:
        f = _smooth(alpha)
        return F.struct(f["sse"].alias("sse"), alpha.alias("alpha"), f["level"].alias("level"))

    best = F.array_min(F.transform(grid, trial))
    return (
        _ordered(df, value, spec)
        .withColumn("_b", best)
        .select(*spec.keys, F.size("y").alias("n_obs"), "_b.alpha", "_b.level", "_b.sse")
    )


def grid(forms: Sequence[str] = tuple(PARAMS)) -> list[tuple[float, float, float, int]]:
    """(alpha, slope gain, damping, parameters) of every coarse candidate of the forms."""
    rows = []
    if "level" in forms:
        rows += [(a, 0.0, 0.0, PARAMS["level"]) for a in COARSE]
    if "trend" in forms:
        rows += [(a, a * s, 1.0, PARAMS["trend"]) for a in COARSE for s in SHARES]
    if "damped" in forms:
        rows += [(a, a * s, f, PARAMS["damped"]) for a in COARSE for s in SHARES for f in DAMPINGS]
    return rows


def _first(y: str) -> tuple[Column, Column]:
    """First level and first slope."""
    level = F.get(y, F.lit(0))
    span = F.least(F.size(y), F.lit(OPENING)) - 1
    return level, (F.get(y, span) - level) / F.greatest(span, F.lit(1))


def _rest(y: str) -> Column:
    return F.slice(y, F.lit(2), F.greatest(F.size(y) - 1, F.lit(0)))


def fold(y: str, alpha: Column, gain: Column, damping: Column) -> Column:
    """(level, slope, sse) of an array without NULLs, all three carried in one fold."""
    level, slope = _first(y)
    start = F.struct(level.alias("level"), F.when(damping > 0, slope).otherwise(0.0).alias("slope"), F.lit(0.0).alias("sse"))

    def step(s: Column, v: Column) -> Column:
        ahead = s["level"] + damping * s["slope"]
        error = v - ahead
        return F.struct(
            (ahead + alpha * error).alias("level"),
            (damping * s["slope"] + gain * error).alias("slope"),
            (s["sse"] + error * error).alias("sse"),
        )

    return F.aggregate(_rest(y), start, step)


def one_step_ahead(y: str, alpha: Column, gain: Column, damping: Column) -> Column:
    """What was expected of every value from those before it; NULL for the first."""
    level, slope = _first(y)
    start = F.struct(
        level.alias("level"),
        F.when(damping > 0, slope).otherwise(0.0).alias("slope"),
        F.array(F.lit(None).cast("double")).alias("path"),
    )

    def step(s: Column, v: Column) -> Column:
        ahead = s["level"] + damping * s["slope"]
        error = v - ahead
        return F.struct(
            (ahead + alpha * error).alias("level"),
            (damping * s["slope"] + gain * error).alias("slope"),
            F.concat(s["path"], F.array(ahead)).alias("path"),
        )

    return F.aggregate(_rest(y), start, step, lambda s: s["path"])


def _criteria(y: np.ndarray, alpha, gain, damping, params) -> np.ndarray:
    """AICc (series x candidates) of y (series x steps); the same recursion as `fold`, candidates side by side."""
    used = y.shape[1] - 1
    span = min(used + 1, OPENING) - 1
    shape = np.broadcast_shapes((len(y), 1), np.shape(alpha))
    level = np.broadcast_to(y[:, :1], shape).copy()
    slope = np.where(damping > 0, (y[:, span] - y[:, 0])[:, None] / max(span, 1), 0.0) + np.zeros(shape)
    sse = np.zeros(shape)
    for t in range(1, used + 1):
        ahead = level + damping * slope
        error = y[:, t : t + 1] - ahead
        level = ahead + alpha * error
        slope = damping * slope + gain * error
        sse += error * error
    room = used - params - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        score = used * np.log(np.maximum(sse / max(used, 1), 1e-12)) + 2 * params + 2 * params * (params + 1) / room
    return np.where(room > 0, score, np.inf)


def _search(forms: Sequence[str]) -> Callable:
    """The gains and the damping with the least criterion for each array, the first of equals."""
    cases = np.array(grid(forms)).reshape(-1, 4).T

    def block(y: np.ndarray) -> np.ndarray:
        first = _criteria(y, *cases).argmin(1)
        alpha, gain, damping, params = (c[first][:, None] for c in cases)
        near = np.clip(np.round(alpha + np.array(FINE), 4), 0.005, 0.995)
        gains = np.minimum(gain, near)
        scores = _criteria(y, near, gains, damping, params)
        best, lane = scores.argmin(1), np.arange(len(y))
        return np.stack([scores[lane, best], near[lane, best], gains[lane, best], damping[:, 0], params[:, 0]], 1)

    @F.pandas_udf("aicc double, alpha double, slope_gain double, damping double, params double")
    def search(y: pd.Series) -> pd.DataFrame:
        out = np.full((len(y), 5), np.inf)
        sizes = y.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            for lanes in np.array_split(at, -(-len(at) // LANES)):
                out[lanes] = block(np.stack(y.iloc[lanes].to_numpy()).astype(float))
        out[~np.isfinite(out[:, 0])] = np.nan
        return pd.DataFrame(out, columns=["aicc", "alpha", "slope_gain", "damping", "params"])

    return search


def with_best_form(rows: DataFrame, y: str, name: str = "form", forms: Sequence[str] = tuple(PARAMS)) -> DataFrame:
    """Add the best of level, trend and damped trend for the array `y`, by AICc.

    A coarse grid of gains and dampings is searched, then the level gain is refined around its best
    candidate, for blocks of series at once; the state comes from one fold with what was chosen.
    `name` is a struct (aicc, alpha, slope_gain, damping, params, level, slope, sse), NULL where `y` is NULL or
    too short for any form.
    """
    found = rows.withColumn("_found", _search(forms)(y))
    picked = [F.nanvl(f"_found.{c}", F.lit(None).cast("double")).alias(c) for c in ("aicc", "alpha", "slope_gain", "damping", "params")]
    found = found.withColumn("_found", F.struct(*picked))
    state = fold(y, F.col("_found.alpha"), F.col("_found.slope_gain"), F.col("_found.damping"))
    found = found.withColumn("_state", F.when(F.col("_found.aicc").isNotNull(), state))
    return found.withColumn(name, F.when(F.col("_state").isNotNull(), F.struct("_found.*", "_state.*"))).drop("_found", "_state")


def best_forms(df: DataFrame, value: str, forms: Sequence[str] = tuple(PARAMS), spec: PanelSpec = WEEKLY) -> DataFrame:
    """Per series, the best form of smoothing and its state at the end; NULLs are skipped."""
    rows = with_best_form(_ordered(df, value, spec), "y", "form", forms)
    kind = F.when(F.col("form.damping") == 0, "level").when(F.col("form.damping") == 1, "trend").otherwise("damped")
    picked = [F.col(f"form.{c}").alias(c) for c in ("alpha", "slope_gain", "damping", "level", "slope", "sse", "aicc")]
    return rows.select(*spec.keys, F.size("y").alias("n_obs"), F.when(F.col("form").isNotNull(), kind).alias("form"), *picked)
