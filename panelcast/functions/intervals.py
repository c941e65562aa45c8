"""Forecast distributions on the square-root scale, read back on the unit scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided normal quantiles for 80 % and 95 % (fixed values).
Z = {80: 1.2815515655, 95: 1.9599639845}


def square_bound(root: Column) -> Column:
    """Undo the square root. A bound below zero is zero: squaring would fold it upward."""
    return F.when(root.isNotNull(), F.pow(F.greatest(root, F.lit(0.0)), F.lit(2.0)))


def back_transform(mu: Column, sigma: Column) -> dict[str, Column]:
    """Point forecast (the mean) and 80 / 95 % bounds; NULL where mu or sigma is NULL."""
    known = mu.isNotNull() & sigma.isNotNull()
    out = {"p_units": F.when(known, mu * mu + sigma * sigma)}
    for level, z in Z.items():
        out[f"low{level}"] = F.when(known, square_bound(mu - F.lit(z) * sigma))
        out[f"up{level}"] = F.when(known, square_bound(mu + F.lit(z) * sigma))
    return out
