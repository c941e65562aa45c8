"""Least squares per group from covariances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.spec import WEEKLY


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(moments: pd.Series, cross: pd.Series) -> pd.Series:
    b = np.stack(cross.to_numpy()).astype(float)
    a = np.stack(moments.to_numpy()).astype(float).reshape(len(b), b.shape[1], b.shape[1])
    coef = (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b[..., None])[..., 0]
    return pd.Series(list(coef))


def least_squares(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = WEEKLY.keys
) -> DataFrame:
    """Intercept and slopes of `y` on `xs` per group, over rows where all are known.

    Rows are reduced to covariances, which combine map-side, so a group may be of
    any size; only the small solve per group leaves the JVM. A regressor that does
    not move in a group has slope 0 there.
    """
    columns = [F.col(c).cast("double") for c in xs]
    target = F.col(y).cast("double")
    known = df.where(F.col(y).isNotNull())
    for c in xs:
        known = known.where(F.col(c).isNotNull())
    k = len(columns)
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg(target).alias("y_mean"),
        *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(columns)],
        *[
            F.covar_pop(columns[i], columns[j]).alias(f"m{i}_{j}")
            for i in range(k)
            for j in range(i, k)
        ],
        *[F.covar_pop(c, target).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    moments = F.array(*[f"m{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)])
    slopes = _solve(moments, F.array(*[f"c{i}" for i in range(k)])).alias("slopes")
    means = [f"mean{i}" for i in range(k)]
    intercept = F.col("y_mean")
    for i, m in enumerate(means):
        intercept = intercept - F.col("slopes")[i] * F.col(m)
    return sums.select(*by, "n_obs", "y_mean", *means, slopes).select(
        *by,
        "n_obs",
        intercept.alias("intercept"),
        *[F.col("slopes")[i].alias(f"b_{c}") for i, c in enumerate(xs)],
    )


def one_regressor(
    df: DataFrame, y: str, x: str, by: Sequence[str] = WEEKLY.keys
) -> DataFrame:
    """Slope and intercept of `y` on one `x` per group, in built-in aggregates."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n_obs"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )
