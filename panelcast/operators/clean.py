"""Cleaning of landing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import sizes
from panelcast.functions.calendar import week_start
from panelcast.operators.panel import declare_panel
from panelcast.spec import WEEKLY, PanelSpec

# The segment of merged stores (fixed value).
MERGED_SEGMENT = "MAINSTREAM_UPSCALE"


def merge_repeated_stores(store: DataFrame) -> DataFrame:
    """Give every store listed more than once one merged segment, then drop equal rows.

    The repeat count is a grouped aggregate joined back, not a window, so a store
    id that fills a large share of the table is counted map-side.
    """
    repeated = (
        store.groupBy("store_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("store_id").alias("repeated_id"))
    )
    return (
        store.join(repeated, F.col("store_id").eqNullSafe(F.col("repeated_id")), "left")
        .withColumn(
            "seg_value_name",
            F.when(F.col("repeated_id").isNotNull(), MERGED_SEGMENT).otherwise(
                F.col("seg_value_name")
            ),
        )
        .select(*store.columns)
        .distinct()
        .withColumn("store_id", F.col("store_id").cast("string"))
    )


def format_transactions(transactions: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Date the rows by ISO week, key them by text, and declare the panel (week first)."""
    dated = transactions.withColumns(
        {
            "week": week_start(F.col("week_end_date")),
            "upc_id": F.col("upc_id").cast("string"),
            "store_id": F.col("store_id").cast("string"),
        }
    )
    return declare_panel(dated, spec)


def convert_sizes(products: DataFrame, count_as_mass: bool = True) -> DataFrame:
    """Split the textual product size into a volume and a mass."""
    size = F.col("product_size")
    return products.withColumns(
        {
            "upc_id": F.col("upc_id").cast("string"),
            "volume_ml": sizes.volume_ml(size),
            "mass_oz": sizes.mass_oz(size, count_as_mass),
            "size_is_count": sizes.size_is_count(size),
        }
    )
