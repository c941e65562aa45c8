"""The fit table on disk: one row per (series, model), bucketed by series like the panel it is joined to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.sources.buckets import open_bucketed, write_bucketed
from panelcast.spec import WEEKLY, PanelSpec


def write_fits(fits: DataFrame, path: str, spec: PanelSpec = WEEKLY, buckets: int | None = None) -> DataFrame:
    return write_bucketed(fits, path, spec, buckets, order=("model",))


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    return open_bucketed(spark, path)
