"""Batch preparation: landing tables to cleaned tables to model inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.clean import convert_sizes, format_transactions, merge_repeated_stores
from panelcast.operators.impute import impute
from panelcast.operators.panel import (
    calendar_split,
    filter_series,
    holdout_split,
    label_calendar_split,
    label_holdout_split,
    missing_ratio_by_span,
)
from panelcast.operators.sampling import sample_series, sampled_rows
from panelcast.sources.buckets import open_bucketed, write_bucketed
from panelcast.sources.tables import clean_names, rename_keys, write_panel, write_table
from panelcast.spec import WEEKLY, PanelSpec


@dataclass(frozen=True)
class Cleaned:
    store: DataFrame
    products: DataFrame
    transactions: DataFrame


@dataclass(frozen=True)
class ModelInputs:
    sample_train: DataFrame
    sample_val: DataFrame
    train: DataFrame
    test: DataFrame


def clean(store: DataFrame, products: DataFrame, transactions: DataFrame) -> Cleaned:
    return Cleaned(
        store=merge_repeated_stores(rename_keys(clean_names(store))),
        products=convert_sizes(rename_keys(clean_names(products))),
        transactions=format_transactions(rename_keys(clean_names(transactions))),
    )


def write_clean(tables: Cleaned, out: str) -> None:
    write_table(tables.store, f"{out}/store.parquet")
    write_table(tables.products, f"{out}/products.parquet")
    write_panel(tables.transactions, f"{out}/transactions.parquet")


def model_inputs(
    transactions: DataFrame,
    products: DataFrame,
    spec: PanelSpec = WEEKLY,
    seed: int = 42,
    below: float = 0.25,
    min_obs: int = 12,
    holdout: int = 4,
) -> ModelInputs:
    """The imputed validation sample with its calendar split, and the full holdout split."""
    ratio = missing_ratio_by_span(transactions, spec=spec)
    picked = sample_series(ratio, products, below, seed, spec)
    sample = sampled_rows(picked, transactions, spec)
    sample_train, sample_val = calendar_split(impute(sample, spec), spec=spec)
    train, test = holdout_split(filter_series(transactions, min_obs, spec), holdout, spec)
    return ModelInputs(sample_train, sample_val, train, test)


SPLITS = {"sample": ("train", "val"), "panel": ("train", "test")}


def write_model_inputs(
    transactions: DataFrame,
    products: DataFrame,
    out: str,
    spec: PanelSpec = WEEKLY,
    seed: int = 42,
    below: float = 0.25,
    min_obs: int = 12,
    holdout: int = 4,
) -> None:
    """Write the imputed sample and the filled panel, each once, bucketed by series, its split as folders.

    `read_split` gives a half, `read_model_table` the whole.
    """
    ratio = missing_ratio_by_span(transactions, spec=spec)
    picked = sample_series(ratio, products, below, seed, spec)
    sample = label_calendar_split(impute(sampled_rows(picked, transactions, spec), spec), spec=spec)
    write_bucketed(sample, f"{out}/sample.parquet", spec, split_by="split")
    panel = label_holdout_split(filter_series(transactions, min_obs, spec), holdout, spec)
    write_bucketed(panel, f"{out}/panel.parquet", spec, split_by="split")


def read_model_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """`sample` or `panel` as written: windows, groupings and joins by series on it move no rows."""
    return open_bucketed(spark, f"{out}/{name}.parquet")


def read_split(spark: SparkSession, out: str, name: str, split: str) -> DataFrame:
    """One half of `sample` (train, val) or `panel` (train, test): the scan opens its folders only."""
    if split not in SPLITS[name]:
        raise ValueError(f"{name} has the splits {SPLITS[name]}")
    return read_model_table(spark, out, name).where(F.col("split") == split).drop("split")
