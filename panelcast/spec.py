"""The panel contract: which columns identify a series, and what orders it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

FLAGS = ("feature", "display", "tpr_only")
MEASURES = ("units", "visits", "hhs", "spend", "price", "base_price")


@dataclass(frozen=True)
class PanelSpec:
    """Key columns, date index and step of a regular panel.

    Rows are unique per (keys, index), so one series holds at most one row per
    step of the calendar. That bound is what makes a per-series window or array
    safe however the rows are spread over the series.
    """

    keys: tuple[str, ...] = ("store_id", "upc_id")
    index: str = "week"
    step_days: int = 7

    @property
    def key_list(self) -> list[str]:
        return list(self.keys)

    @property
    def row_id(self) -> list[str]:
        return [*self.keys, self.index]

    def over_series(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def in_order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.index)

    def newest_first(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.col(self.index).desc())


WEEKLY = PanelSpec()


def fit_tasks(spark: SparkSession) -> int:
    """Tasks for work that costs time per series rather than per byte."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def deal_series(
    df: DataFrame, tasks: int | None = None, cost: Column | None = None, keys: tuple[str, ...] | list[str] = ()
) -> DataFrame:
    """Spread one-row-per-series arrays evenly before costly work on each.

    Adaptive execution sizes partitions by bytes and would put a small panel's
    series in one task. With `cost`, rows are dealt like cards, the dearest first and every
    other lap backwards, so tasks get like sums of cost and not only like numbers of rows; each
    part of the input starts with another task. `keys` settle the order among equal costs, so that a
    part that is computed again deals the same cards.
    """
    n = tasks or fit_tasks(df.sparkSession)
    if cost is None:
        return df.repartition(n)
    slot = F.monotonically_increasing_id()
    card = df.withColumn("_cost", cost).sortWithinPartitions(F.col("_cost").desc(), *keys).withColumn("_slot", slot)
    row, part = F.col("_slot").bitwiseAND(F.lit(2**33 - 1)), F.shiftright("_slot", 33)
    at, lap = row % n, F.floor(row / n)
    turn = F.when(lap % 2 == 0, at).otherwise(n - 1 - at)
    return card.withColumn("_task", ((turn + part) % n).cast("int")).repartitionById(n, "_task").drop("_cost", "_slot", "_task")


def by_series(df: DataFrame, spec: PanelSpec = WEEKLY, tasks: int | None = None) -> DataFrame:
    """Hash-partition by series; the windows and groupings that follow reuse the exchange."""
    return df.repartition(tasks or fit_tasks(df.sparkSession), *spec.keys)
