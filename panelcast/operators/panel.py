"""Keyed, ordered panels: checks, gaps, counts, splits, future rows.

All windows here share one partitioning, the series keys, so a chain of them
costs a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import week_start
from panelcast.spec import WEEKLY, PanelSpec


def key_duplicates(df: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """(keys, index) values that occur more than once, with their count."""
    return df.groupBy(*spec.row_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def declare_panel(df: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Index column first; the job fails on the first repeated (keys, index), and on a NULL index."""
    repeated = F.lag(spec.index).over(spec.in_order()) == F.col(spec.index)
    repeated = repeated | F.col(spec.index).isNull()
    message = F.concat_ws(
        " ",
        F.lit("repeated row in panel, or one without an index:"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in spec.row_id],
    )
    checked = df.withColumn("_repeated", F.coalesce(repeated, F.lit(False))).where(
        F.when(F.col("_repeated"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    )
    return checked.select(spec.index, *[c for c in df.columns if c != spec.index])


def relocate(df: DataFrame, columns: list[str], after: str | None = None) -> DataFrame:
    """Move columns to the front, or behind `after`."""
    rest = [c for c in df.columns if c not in columns]
    at = 0 if after is None else rest.index(after) + 1
    return df.select(*rest[:at], *columns, *rest[at:])


def fill_gaps(df: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Turn missing steps between a series' first and last row into rows of NULL.

    Each row looks at the next one and emits itself plus the steps in between:
    no calendar table and no self-join. A row without an index has no place in its
    series: the job fails on it.
    """
    step = F.expr(f"interval {spec.step_days} days")
    missing = F.raise_error(F.lit(f"a panel row has no {spec.index}")).cast("date")
    here = F.coalesce(F.col(spec.index), missing)
    last_missing = F.date_sub("_next", spec.step_days)
    spread = df.withColumn("_next", F.lead(spec.index).over(spec.in_order())).withColumn(
        "_at", F.explode(F.sequence(here, F.coalesce(last_missing, here), step))
    )

    def value(name: str) -> Column:
        if name == spec.index:
            return F.col("_at").alias(name)
        if name in spec.keys:
            return F.col(name)
        return F.when(F.col("_at") == here, F.col(name)).alias(name)

    return spread.select(*[value(c) for c in df.columns])


def count_missing(df: DataFrame, value: str = "units", spec: PanelSpec = WEEKLY) -> DataFrame:
    """Fill gaps and note on every row how many steps of its series lack a value."""
    missing = F.col(value).isNull().cast("bigint")
    return fill_gaps(df, spec).withColumn("n_na", F.sum(missing).over(spec.over_series()))


def missing_ratio(df: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """One row per series: missing steps and their share of all steps after filling."""
    return df.groupBy(*spec.keys).agg(
        F.max("n_na").alias("n_na"),
        (F.max("n_na") / F.count(F.lit(1))).alias("missingness"),
    )


def missing_ratio_by_span(
    df: DataFrame, value: str = "units", spec: PanelSpec = WEEKLY
) -> DataFrame:
    """The same from the unfilled panel: the span of a series tells how many steps it has.

    One grouped aggregate; nothing is filled to be counted.
    """
    span = F.datediff(F.max(spec.index), F.min(spec.index))
    steps = (span / spec.step_days).cast("bigint") + 1
    n_na = steps - F.count(value)
    return df.groupBy(*spec.keys).agg(n_na.alias("n_na"), (n_na / steps).alias("missingness"))


def keep_long_series(df: DataFrame, more_than: int = 12, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Series with more than `more_than` observed rows. Run before gap filling."""
    return (
        df.withColumn("_n", F.count(F.lit(1)).over(spec.over_series()))
        .where(F.col("_n") > more_than)
        .drop("_n")
    )


def filter_series(df: DataFrame, more_than: int = 12, spec: PanelSpec = WEEKLY) -> DataFrame:
    return fill_gaps(keep_long_series(df, more_than, spec), spec)


def last_rows(df: DataFrame, n: int, spec: PanelSpec = WEEKLY) -> DataFrame:
    """The last `n` rows of every series."""
    return (
        df.withColumn("_back", F.row_number().over(spec.newest_first()))
        .where(F.col("_back") <= n)
        .drop("_back")
    )


def drop_last_rows(df: DataFrame, n: int, spec: PanelSpec = WEEKLY) -> DataFrame:
    """All but the last `n` rows of every series."""
    return (
        df.withColumn("_back", F.row_number().over(spec.newest_first()))
        .where(F.col("_back") > n)
        .drop("_back")
    )


def future_rows(df: DataFrame, n: int, spec: PanelSpec = WEEKLY) -> DataFrame:
    """The next `n` steps after the end of every series, numbered by horizon `h`."""
    ends = df.groupBy(*spec.keys).agg(F.max(spec.index).alias("_end"))
    ahead = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return ahead.select(
        F.date_add("_end", F.col("h") * spec.step_days).alias(spec.index), *spec.keys, "h"
    )


def label_calendar_split(df: DataFrame, months: int = 1, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Mark rows `train` up to the week holding (last date - months), else `val`.

    A day missing from the earlier month clamps to its end, so no series is lost.
    """
    end = F.max(spec.index).over(spec.over_series())
    cutoff = week_start(F.add_months(end, -months))
    return df.withColumn("_cutoff", cutoff).select(
        *df.columns,
        F.when(F.col(spec.index) <= F.col("_cutoff"), "train").otherwise("val").alias("split"),
    )


def calendar_split(
    df: DataFrame, months: int = 1, spec: PanelSpec = WEEKLY
) -> tuple[DataFrame, DataFrame]:
    marked = label_calendar_split(df, months, spec)
    return tuple(marked.where(F.col("split") == s).drop("split") for s in ("train", "val"))


def label_holdout_split(df: DataFrame, n: int = 4, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Mark the last `n` rows of a gap-free series `test` and the others `train`.

    A series of `n` rows or fewer has nothing to train on and leaves both halves.
    """
    back = F.row_number().over(spec.newest_first())
    size = F.count(F.lit(1)).over(spec.over_series())
    return (
        df.withColumns({"_back": back, "_size": size})
        .where(F.col("_size") > n)
        .select(*df.columns, F.when(F.col("_back") > n, "train").otherwise("test").alias("split"))
    )


def holdout_split(
    df: DataFrame, n: int = 4, spec: PanelSpec = WEEKLY
) -> tuple[DataFrame, DataFrame]:
    marked = label_holdout_split(df, n, spec)
    return tuple(marked.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def holdout_from_join(
    train: DataFrame, df: DataFrame, n: int = 4, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """The `n` steps after `train`, filled from `df` where it has them.

    The general form of the test half: it also serves panels that still have gaps.
    """
    return (
        future_rows(train, n, spec)
        .drop("h")
        .join(df, on=[spec.index, *spec.keys], how="left")
        .select(*df.columns)
    )


def full_panel(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)
