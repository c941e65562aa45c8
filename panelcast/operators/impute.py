"""Filling missing weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.gaps import interpolate
from panelcast.spec import WEEKLY, PanelSpec, by_series


def carry_forward(
    df: DataFrame, columns: Sequence[str] = ("units",), spec: PanelSpec = WEEKLY
) -> DataFrame:
    """Replace NULL by the last known value of the series; leading NULLs stay."""
    so_far = spec.in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def mark_incomplete(df: DataFrame, value: str = "units", spec: PanelSpec = WEEKLY) -> DataFrame:
    """Note on every row whether its series misses any value."""
    gaps = F.count_if(F.col(value).isNull()).over(spec.over_series())
    return df.withColumn("incomplete", gaps > 0)


def incomplete_series(df: DataFrame, value: str = "units", spec: PanelSpec = WEEKLY) -> DataFrame:
    """All rows of the series that miss at least one value."""
    return mark_incomplete(df, value, spec).where("incomplete").drop("incomplete")


def impute(df: DataFrame, spec: PanelSpec = WEEKLY, tasks: int | None = None) -> DataFrame:
    """Fill missing units from both sides of their gap, by the memory of the series (`operators/gaps.py`).

    One pass of windows on the partitioning that filled the gaps, or on one of `tasks` parts by
    series; observed values never change, a series without any value stays as it is, and no row
    leaves the JVM.
    """
    rows = df.select(*[c for c in df.columns if c != "n_na"])
    return interpolate(by_series(rows, spec, tasks) if tasks else rows, "units", spec)
