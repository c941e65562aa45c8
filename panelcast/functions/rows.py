"""Across-column arithmetic for one row, skipping NULLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_mean(columns: Sequence[str]) -> Column:
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(known))


def row_argmin(columns: Sequence[str]) -> Column:
    """Name of the smallest column; the first listed wins a tie, NULL if all are NULL."""
    values = F.array(*columns)
    names = F.array(*[F.lit(c) for c in columns])
    at = F.array_position(values, F.array_min(values)).cast("int")
    return F.when(F.array_min(values).isNotNull(), F.element_at(names, at))


def strict(aggregate: Column, value: Column) -> Column:
    """The aggregate, or NULL if any input was NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def round_scaled(x: Column, digits: int) -> Column:
    """Round the scaled value, then scale back.

    The built-in rounds the shortest decimal form instead, which differs from most
    SQL engines where a double lies next to a tie.
    """
    scale = F.lit(float(10**digits))
    return F.round(x * scale) / scale
