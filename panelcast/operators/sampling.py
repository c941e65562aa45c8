"""One complete series per (store, category) for model validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.panel import count_missing
from panelcast.spec import WEEKLY, PanelSpec


def sample_series(
    ratio: DataFrame,
    products: DataFrame,
    below: float = 0.25,
    seed: int = 42,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """Pick a series per (store, category) among those missing less than `below`.

    `ratio` has one row per series with its `missingness`. The draw orders series
    by a seeded hash of their keys, so it repeats on any cluster. It is a minimum,
    which combines map-side: a cell holding most of the series is never gathered.
    """
    store, upc = spec.keys
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(store), F.col(upc)))
    series = ratio.where(F.col("missingness") < below).join(
        products.select(upc, "category"), upc, "left"
    )
    return (
        series.groupBy(store, "category")
        .agg(F.min(F.struct(draw.alias("draw"), F.col(upc), F.col("missingness"))).alias("pick"))
        .select(store, f"pick.{upc}", "category", "pick.missingness")
    )


def sampled_rows(
    samples: DataFrame, transactions: DataFrame, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """The gap-filled rows of the picked series. Others are left out before filling."""
    picked = transactions.join(samples.select(*spec.keys), spec.key_list, "left_semi")
    return samples.join(count_missing(picked, spec=spec), on=spec.key_list, how="inner")
