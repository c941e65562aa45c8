"""Batch training and forecasting: model inputs to fit tables to forecast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.fit import residuals, train_models
from panelcast.operators.forecast import (
    add_intervals,
    forecast,
    forecast_next,
    forecast_scenarios,
)
from panelcast.operators.panel import full_panel
from panelcast.sources.fits import read_fits, write_fits
from panelcast.sources.tables import write_table
from panelcast.spec import WEEKLY, PanelSpec


def holdout_forecast(fits: DataFrame, test: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Both models on the held-out weeks, however many, with the flags seen in them."""
    out = add_intervals(forecast(fits, test, spec=spec))
    return out.select(*spec.keys, "model", spec.index, "p_units", "low80", "up80", "low95", "up95")


def write_training(spark: SparkSession, train: DataFrame, test: DataFrame, out: str) -> None:
    """Fit on the training half, then on everything; keep both fit tables and the residuals.

    A fit table is written before anything reads it, so no series is fitted twice.
    """
    write_fits(train_models(train), f"{out}/fit_train.parquet")
    write_fits(train_models(full_panel(train, test)), f"{out}/fit.parquet")
    fits = read_fits(spark, f"{out}/fit.parquet")
    write_table(residuals(fits), f"{out}/residuals.parquet")


def write_forecasts(spark: SparkSession, test: DataFrame, out: str) -> None:
    """Forecast tables from the written fits: holdout, seasonal and scenario.

    Only the holdout needs rows beside the fits; the others start from the fit table.
    """
    fit_train = read_fits(spark, f"{out}/fit_train.parquet")
    write_table(holdout_forecast(fit_train, test), f"{out}/fc_train.parquet")

    fits = read_fits(spark, f"{out}/fit.parquet")
    seasonal = forecast_next(fits.where(F.col("model") == "stl"))
    write_table(seasonal.drop("feature", "display", "tpr_only"), f"{out}/fc_stl.parquet")
    scenarios = forecast_scenarios(fits.where(F.col("model") == "arima"))
    write_table(scenarios, f"{out}/fc_arima.parquet")
