"""Fits that follow a growing panel: what a regression needs of a series is kept, and new weeks are added to it.

The state of a series is its sums of products and its last `moments.FIRST` rows, which are the lags of the weeks
to come. Adding weeks reads the state and the new rows, never the history: the sums of both parts add up to those
of the whole panel, and so do the fits. A state is bounded: one matrix and a few rows for each series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import moments
from panelcast.operators import fit
from panelcast.operators.panel import fill_gaps
from panelcast.spec import FLAGS, WEEKLY, PanelSpec


def _flags(design: Sequence[str]) -> tuple[str, ...]:
    """The flags that a state keeps: without regressors it needs none."""
    return FLAGS if design else ()


def fit_state(
    panel: DataFrame, design: Sequence[str] = fit.PROMOTION, spec: PanelSpec = WEEKLY, tasks: int | None = None
) -> DataFrame:
    """keys, n_obs, moments and tail (week, units, filled root, flags if any regressor needs them) of every series
    of a gap-free panel.

    The panel is read once: all three come from one grouping. A series without one of its keys has no state.
    `design` may hold flags and lagged flags; seasonal terms would need the calendar of the tail.
    """
    if any(c not in fit.PROMOTION for c in design):
        raise ValueError(f"a state keeps the regressors {fit.PROMOTION}")
    fresh = F.col("units").isNotNull()
    if fit.STORED_ROOT in panel.columns:
        fresh = fresh & F.col(fit.STORED_ROOT).isNull()
    # Regressors read a flag that is unknown as 0; the tail keeps it unknown.
    raw = [F.col(f"_raw_{f}").alias(f) for f in _flags(design)]
    point = F.struct(spec.index, F.col("units").cast("double").alias("units"), F.col("filled_root").alias(fit.STORED_ROOT), *raw)
    points = F.array_sort(F.collect_list(point))
    tail = F.slice(points, F.greatest(F.size(points) - moments.FIRST + 1, F.lit(1)), F.lit(moments.FIRST))
    keyed = panel.withColumns({f"_raw_{f}": F.col(f) for f in _flags(design)})
    for key in spec.keys:
        keyed = keyed.where(F.col(key).isNotNull())
    rows = fit.series_rows(keyed, design, spec, tasks, {"n_obs": F.count_if(fresh), "tail": tail})
    return fit.series_moments(rows, len(design)).select(*spec.keys, "moments", "n_obs", "tail")


def extend_state(
    state: DataFrame,
    new: DataFrame,
    design: Sequence[str] = fit.PROMOTION,
    spec: PanelSpec = WEEKLY,
    tasks: int | None = None,
) -> DataFrame:
    """The state with later weeks added; series that it doesn't hold start anew.

    The job fails on a row that isn't later than what the state of its series holds: such a week is in
    the sums already, or its gap has been filled.
    """
    tail = state.select(*spec.keys, F.inline("tail")).withColumn("_old", F.lit(True))
    later = new.select(*spec.row_id, F.col("units").cast("double").alias("units"), *_flags(design)).withColumn("_old", F.lit(False))
    both = tail.unionByName(later, allowMissingColumns=True)
    until = F.max(F.when(F.col("_old"), F.col(spec.index))).over(spec.over_series())
    message = F.concat_ws(" ", F.lit("a row is not later than the state of its series:"), *spec.row_id)
    early = ~F.col("_old") & (F.col(spec.index) <= F.col("_until"))
    both = both.withColumn("_until", until).where(F.when(early, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    added = fit_state(fill_gaps(both.drop("_old", "_until"), spec), design, spec, tasks)
    before = state.select(*spec.keys, F.col("n_obs").alias("_n"), F.col("moments").alias("_moments"))
    return added.join(before, spec.key_list, "left").select(
        *spec.keys,
        fit.merge_moments(F.col("_moments"), F.col("moments")).alias("moments"),
        (F.col("n_obs") + F.coalesce("_n", F.lit(0))).alias("n_obs"),
        "tail",
    )


def fits_of_state(
    state: DataFrame,
    models: dict[str, fit.ModelSpec],
    design: Sequence[str] = fit.PROMOTION,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """The fit table of a state: parameters and what forecasting starts from; its residual columns cover the tail.

    Equal to the fits of the whole panel.
    """
    lagged = F.transform("tail", lambda t, i: F.get("tail", i - 1))

    def regressors(t, before):
        known = {c: F.coalesce(t[c].cast("double"), F.lit(0.0)) for c in _flags(design)}
        earlier = {f"lag_{c}": F.coalesce(before[c].cast("double"), F.lit(0.0)) for c in _flags(design)}
        return F.array(*[(known | earlier)[c] for c in design]).cast("array<double>")

    rows = state.select(
        *spec.keys,
        "n_obs",
        "moments",
        F.element_at("tail", 1)[spec.index].alias("first_week"),
        F.element_at("tail", -1)[spec.index].alias("last_week"),
        F.transform("tail", lambda t: t["units"]).alias("units"),
        F.transform("tail", lambda t: t[fit.STORED_ROOT]).alias("z"),
        F.flatten(F.zip_with("tail", lagged, regressors)).alias("x"),
    )
    plan = {name: (m,) for name, m in models.items()}
    return fit.fits_from(rows, plan, design, spec, n_obs=F.col("n_obs"))
