"""Category roll-ups and long forms of promotional measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.spec import FLAGS


def with_products(transactions: DataFrame, products: DataFrame) -> DataFrame:
    return transactions.join(products, "upc_id", "left")


def category_weekly(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Sales per (week, category); a flag is 1 if any product carried it.

    Sales are first summed per (week, product): the grouping combines map-side
    and leaves the product join one row per product and week.
    """
    by_product = transactions.groupBy("week", "upc_id").agg(
        F.sum("units").alias("units"),
        F.sum("visits").alias("visits"),
        F.sum("base_price").alias("base_sum"),
        F.count("base_price").alias("base_n"),
        *[F.max(f).alias(f) for f in FLAGS],
    )
    return (
        with_products(by_product, products.select("upc_id", "category"))
        .groupBy("week", "category")
        .agg(
            F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
            F.coalesce(F.sum("visits"), F.lit(0).cast("bigint")).alias("visits"),
            F.try_divide(F.sum("base_sum"), F.sum("base_n")).alias("base_price"),
            *[F.max(f).cast("int").alias(f) for f in FLAGS],
        )
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    ids = [F.col(c) for c in ("week", "category")]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["week", "category"], columns, "col", "value"
    )


def product_long(weekly: DataFrame, category: str | None = None) -> DataFrame:
    """Units, base price and flags per week, one measure per row."""
    rows = weekly if category is None else weekly.where(F.col("category") == category)
    return _long(rows, ["units", "base_price", *FLAGS])


def promotion_long(weekly: DataFrame, category: str | None = None) -> DataFrame:
    """Units per visit beside the flags, one measure per row. No visits gives NULL."""
    rows = weekly if category is None else weekly.where(F.col("category") == category)
    ratio = F.try_divide(F.col("units"), F.col("visits"))
    return _long(rows.withColumn("units_visits", ratio), ["units_visits", *FLAGS])
