"""Values of missing weeks from both sides of a gap, in windows over the series.

On the square-root scale a series is taken as a first-order autoregression. Given the last known value before a
gap and the next one after it, the best value at each step between has a closed form: each side counts by how
fast the series forgets it. So a gap of any length needs one look back, one look ahead and two sums over the
series, all on one partitioning and one ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.intervals import square_bound
from panelcast.spec import WEEKLY, PanelSpec

#: From here on a series is taken to forget nothing: gaps are filled in a straight line.
NO_DECAY = 0.995
#: Pairs of neighbouring known weeks that an estimate of the decay takes.
LEAST_PAIRS = 3


def bridge(before: Column, after: Column, back: Column, ahead: Column, decay: Column) -> Column:
    """Expected deviation from the mean, `back` steps after `before` and `ahead` steps before `after`.

    Either side may be NULL (past an end of the series), which leaves the other's decayed value.
    """
    a, b = F.pow(decay, back), F.pow(decay, ahead)
    straight = (before * ahead + after * back) / (back + ahead)
    both = (before * a * (1 - b * b) + after * b * (1 - a * a)) / (1 - a * a * b * b)
    return (
        F.when(before.isNull(), after * b)
        .when(after.isNull(), before * a)
        .when(decay >= NO_DECAY, straight)
        .otherwise(both)
    )


def with_interpolated(
    df: DataFrame, value: str = "units", spec: PanelSpec = WEEKLY, name: str = "filled_root", straight: bool = False
) -> DataFrame:
    """Add the square root of `value`, interpolated where it is NULL; run on a gap-free panel.

    The decay of a series is the regression of neighbouring known weeks on each other, held to 0 and NO_DECAY;
    with fewer than LEAST_PAIRS of them, or without spread, gaps are filled in a straight line and ends are carried.
    `straight` does that everywhere: then a gap depends on its two neighbours only, and weeks that are added later
    change nothing before them. A series without any value stays NULL.
    """
    ordered, whole = spec.in_order(), spec.over_series()
    past = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coming = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    root = F.sqrt(F.col(value).cast("double"))
    known = F.when(F.col("_root").isNotNull(), F.struct(F.col("_root").alias("y"), F.col(spec.index).alias("t")))
    pair = F.col("_root").isNotNull() & F.col("_prior").isNotNull()
    x, y = (F.when(pair, F.col(c)) for c in ("_prior", "_root"))
    rows = df.withColumn("_root", root).withColumns(
        {
            "_prior": F.lag("_root", 1).over(ordered),
            "_last": F.last(known, ignorenulls=True).over(past),
            "_next": F.first(known, ignorenulls=True).over(coming),
            "_mean": F.avg("_root").over(whole),
        }
    )
    slope = F.try_divide(F.covar_pop(y, x).over(whole), F.var_pop(x).over(whole))
    decay = F.lit(1.0) if straight else F.when(F.count(x).over(whole) >= LEAST_PAIRS, F.greatest(F.lit(0.0), F.least(slope, F.lit(1.0))))
    # Without an estimate the series keeps its level.
    rows = rows.withColumn("_decay", F.coalesce(F.when(decay >= NO_DECAY, F.lit(1.0)).otherwise(decay), F.lit(1.0)))
    back = (F.datediff(spec.index, F.col("_last.t")) / spec.step_days).cast("double")
    ahead = (F.datediff(F.col("_next.t"), spec.index) / spec.step_days).cast("double")
    between = bridge(F.col("_last.y") - F.col("_mean"), F.col("_next.y") - F.col("_mean"), back, ahead, F.col("_decay"))
    filled = F.coalesce("_root", F.col("_mean") + between)
    return rows.select(*df.columns, filled.alias(name))


def interpolate(df: DataFrame, value: str = "units", spec: PanelSpec = WEEKLY) -> DataFrame:
    """Replace NULLs of `value` by their interpolation; known values stay as they are."""
    out = with_interpolated(df, value, spec, "_filled")
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), square_bound(F.col("_filled")))).drop("_filled")
