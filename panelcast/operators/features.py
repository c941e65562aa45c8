"""Regressors for the models, and the promotion scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import WEEKS_PER_YEAR, fourier
from panelcast.spec import FLAGS, WEEKLY, PanelSpec

# (feature, display, tpr_only): a price reduction alone excludes the other two (fixed values).
SCENARIOS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0))


def fill_flags(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Flags of filled weeks are unknown; models read them as 0."""
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags})


def lag_features(
    df: DataFrame, columns: Sequence[str] = FLAGS, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """Last week's value within the series. Run on a filled panel."""
    return df.withColumns({f"lag_{c}": F.lag(c, 1).over(spec.in_order()) for c in columns})


def fourier_features(
    df: DataFrame, k: int = 6, period: float = WEEKS_PER_YEAR, spec: PanelSpec = WEEKLY
) -> DataFrame:
    return df.withColumns(fourier(F.col(spec.index), k, period))


def add_scenarios(
    future: DataFrame, scenarios: Sequence[tuple[int, ...]] = SCENARIOS, flags: Sequence[str] = FLAGS
) -> DataFrame:
    """Every future row under every scenario, numbered from 1 in `fc_ind`.

    The scenarios are literals in the plan: rows multiply in place, with no join.
    """
    cases = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(f) for f, v in zip(flags, case, strict=True)],
                F.lit(i).alias("fc_ind"),
            )
            for i, case in enumerate(scenarios, 1)
        ]
    )
    return future.withColumn("_case", F.explode(cases)).select(*future.columns, "_case.*")
