"""The lookups a sales dashboard asks of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.panel import last_rows
from panelcast.operators.profile import histogram
from panelcast.operators.score import acf, models_wide, rmse, with_actuals
from panelcast.spec import WEEKLY, PanelSpec

BANDS = ("p_units", "low80", "up80", "low95", "up95")
NOT_MEASURES = ("upc_id", "store_id", "week", "week_end_date")


def label_models(df: DataFrame) -> DataFrame:
    return df.withColumn("model", F.upper("model"))


def store_products(panel: DataFrame, store_id: str | None = None) -> DataFrame:
    """Products sold by a store, in order (by every store when none is named)."""
    rows = panel if store_id is None else panel.where(F.col("store_id") == str(store_id))
    return rows.select("store_id", "upc_id").distinct().orderBy("store_id", "upc_id")


def store_choices(store: DataFrame) -> DataFrame:
    return store.select("store_id").orderBy("store_id")


def measure_choices(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in NOT_MEASURES]


def series(df: DataFrame, store_id: str, upc_id: str) -> DataFrame:
    """Rows of one series. Keys are text; the filter reaches the Parquet scan."""
    return df.where((F.col("store_id") == str(store_id)) & (F.col("upc_id") == str(upc_id)))


def history_and_holdout(
    panel: DataFrame, forecasts: DataFrame | None, column: str = "units"
) -> DataFrame:
    """Observed values and, for units, the holdout forecasts with their bands, long."""
    history = panel.select(
        "store_id",
        "upc_id",
        "week",
        F.lit("HISTORY").alias("line"),
        F.col(column).cast("double").alias("value"),
        *[F.lit(None).cast("double").alias(b) for b in BANDS[1:]],
    )
    if column != "units" or forecasts is None:
        return history
    fc = label_models(forecasts).select(
        "store_id",
        "upc_id",
        "week",
        F.col("model").alias("line"),
        F.col("p_units").alias("value"),
        *BANDS[1:],
    )
    return history.unionByName(fc)


def holdout_rmse(
    panel: DataFrame, forecasts: DataFrame, models: tuple[str, ...] = ("ARIMA", "STL")
) -> DataFrame:
    """RMSE per series, one column per model."""
    scored = with_actuals(label_models(forecasts), panel)
    return models_wide(rmse(scored), "rmse", models)


def scenario_reason(feature: int, display: int, tpr_only: int) -> str | None:
    """Why a flag combination has no scenario; None if it has one."""
    if tpr_only == 1 and (feature == 1 or display == 1):
        return "tpr_only excludes feature and display"
    return None


def scenario_view(
    panel: DataFrame,
    fc_arima: DataFrame,
    fc_stl: DataFrame,
    feature: int = 0,
    display: int = 0,
    tpr_only: int = 0,
    recent: int = 10,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """Recent history with the chosen scenario's forecast beside the seasonal one.

    An impossible combination gives the whole history, and why in `reason`.
    """
    why = scenario_reason(feature, display, tpr_only)
    if why:
        return history_and_holdout(panel, None).withColumn("reason", F.lit(why))
    history = history_and_holdout(last_rows(panel, recent, spec), None)
    chosen = fc_arima.where(
        (F.col("feature") == feature)
        & (F.col("display") == display)
        & (F.col("tpr_only") == tpr_only)
    )
    lines = [
        label_models(fc).select(
            "store_id",
            "upc_id",
            "week",
            F.col("model").alias("line"),
            F.col("p_units").alias("value"),
            *BANDS[1:],
        )
        for fc in (chosen, fc_stl)
    ]
    shown = history.unionByName(lines[0]).unionByName(lines[1])
    return shown.withColumn("reason", F.lit(None).cast("string"))


def residual_acf(residuals: DataFrame, lag_max: int = 55, spec: PanelSpec = WEEKLY) -> DataFrame:
    return acf(residuals, "innov", [*spec.keys, "model"], spec.index, lag_max)


def residual_histogram(
    residuals: DataFrame, bins: int = 50, by: tuple[str, ...] = ("model",)
) -> DataFrame:
    return histogram(residuals, "innov", by, bins)
