"""Batch validation: every candidate model on the sample, scored and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.fit import (
    SEASONAL,
    VALIDATION_MODELS,
    fit_models,
    information_criteria,
)
from panelcast.operators.forecast import add_intervals, forecast
from panelcast.operators.score import (
    aicc_leaderboard,
    models_wide,
    rmse,
    rmse_leaderboard,
    with_actuals,
)
from panelcast.sources.fits import read_fits, write_fits
from panelcast.sources.tables import write_decimal_comma_csv
from panelcast.spec import WEEKLY, PanelSpec

ARIMA_MODELS = tuple(m for m in VALIDATION_MODELS if "arima" in m)
# The models kept after the comparison of information criteria.
FINALISTS = ("arima_lagged", "stl")


def validation_fits(sample_train: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    return fit_models(sample_train, VALIDATION_MODELS, SEASONAL, spec)


def aicc_table(fits: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    return models_wide(information_criteria(fits, spec), "aicc", ARIMA_MODELS, spec.key_list)


def rmse_table(fits: DataFrame, sample_val: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """RMSE of the finalists on the held-out month, one column per model."""
    kept = fits.where(F.col("model").isin(*FINALISTS))
    fc = add_intervals(forecast(kept, sample_val, SEASONAL, spec))
    return models_wide(rmse(with_actuals(fc, sample_val, spec)), "rmse", FINALISTS, spec.key_list)


def write_validation(
    spark: SparkSession, sample_train: DataFrame, sample_val: DataFrame, out: str
) -> tuple[DataFrame, DataFrame]:
    """Write fits and both score tables; return the two leaderboards."""
    write_fits(validation_fits(sample_train), f"{out}/fit.parquet")
    fits = read_fits(spark, f"{out}/fit.parquet")
    aicc, scores = aicc_table(fits), rmse_table(fits, sample_val)
    write_decimal_comma_csv(aicc, f"{out}/aicc.csv")
    write_decimal_comma_csv(scores, f"{out}/rmse.csv")
    return aicc_leaderboard(aicc, ARIMA_MODELS), rmse_leaderboard(scores, FINALISTS)
