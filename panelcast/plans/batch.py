"""The two batch runs in one call each: from landing tables to forecasts, and to leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.plans import prepare, training, validation


def _prepare(
    spark: SparkSession, store: DataFrame, products: DataFrame, transactions: DataFrame, out: str, options: dict
) -> None:
    """Clean, write, and write the model inputs from what was written."""
    tables = prepare.clean(store, products, transactions)
    prepare.write_clean(tables, out)
    written = spark.read.schema(tables.transactions.schema).parquet(f"{out}/transactions.parquet")
    sizes = spark.read.schema(tables.products.schema).parquet(f"{out}/products.parquet")
    prepare.write_model_inputs(written, sizes, out, **options)


def train(
    spark: SparkSession, store: DataFrame, products: DataFrame, transactions: DataFrame, out: str, **options
) -> None:
    """Everything from landing tables to fit, residual and forecast tables under `out`.

    `options` are those of `prepare.write_model_inputs` (spec, seed, below, min_obs, holdout).
    """
    _prepare(spark, store, products, transactions, out, options)
    halves = [prepare.read_split(spark, out, "panel", s) for s in ("train", "test")]
    training.write_training(spark, *halves, out)
    training.write_forecasts(spark, halves[1], out)


def validate(
    spark: SparkSession, store: DataFrame, products: DataFrame, transactions: DataFrame, out: str, **options
) -> tuple[DataFrame, DataFrame]:
    """Everything from landing tables to both score tables under `out`; returns the leaderboards."""
    _prepare(spark, store, products, transactions, out, options)
    halves = [prepare.read_split(spark, out, "sample", s) for s in ("train", "val")]
    return validation.write_validation(spark, *halves, out)
