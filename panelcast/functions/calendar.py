"""Week arithmetic. A week is the DATE of its ISO Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Monday, and the mean number of weeks in a year (fixed values).
WEEK_ZERO = "1970-01-05"
WEEKS_PER_YEAR = 52.18


def week_start(c: Column) -> Column:
    day = c.cast("date")
    return F.date_sub(day, F.weekday(day))


def week_number(c: Column) -> Column:
    """Weeks since a fixed Monday, so seasonal terms do not depend on where a series starts."""
    return F.datediff(c, F.lit(WEEK_ZERO).cast("date")) / F.lit(7)


def fourier(c: Column, k: int = 6, period: float = WEEKS_PER_YEAR) -> dict[str, Column]:
    terms: dict[str, Column] = {}
    for i in range(1, k + 1):
        angle = F.lit(2.0) * F.pi() * F.lit(float(i)) * week_number(c) / F.lit(float(period))
        terms[f"s{i}"] = F.sin(angle)
        terms[f"c{i}"] = F.cos(angle)
    return terms
