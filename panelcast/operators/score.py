"""Scores, leaderboards and residual diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.rows import row_argmin, row_mean, strict
from panelcast.operators.quantiles import exact_quantiles
from panelcast.spec import WEEKLY, PanelSpec, deal_series


def with_actuals(forecasts: DataFrame, actuals: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Forecast rows with the observed value beside them, matched on (keys, index)."""
    seen = actuals.select(*spec.row_id, "units")
    return forecasts.drop("units").join(seen, on=spec.row_id, how="left")


def rmse(
    scored: DataFrame,
    by: Sequence[str] = ("store_id", "upc_id", "model"),
    point: str = "p_units",
    strict_nulls: bool = False,
) -> DataFrame:
    """Root mean squared error per group. With `strict_nulls`, one unknown makes it NULL."""
    error = F.col("units") - F.col(point)
    mean = F.avg(error * error)
    if strict_nulls:
        mean = strict(mean, error)
    return scored.groupBy(*by).agg(F.sqrt(mean).alias("rmse"))


def models_wide(
    scores: DataFrame,
    value: str,
    models: Sequence[str],
    ids: Sequence[str] = ("store_id", "upc_id"),
) -> DataFrame:
    """One column per model. The models are named, so no job looks them up."""
    return scores.groupBy(*ids).pivot("model", list(models)).agg(F.max(value))


def with_best_model(wide: DataFrame, models: Sequence[str], mean_name: str) -> DataFrame:
    """Mean score across models, and the model with the smallest one."""
    return wide.withColumns({mean_name: row_mean(models), "best_model": row_argmin(models)})


def aicc_leaderboard(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per winner: how often it wins and the mean of the mean scores."""
    best = with_best_model(wide, models, "mean_aicc")
    return best.groupBy("best_model").agg(
        F.avg("mean_aicc").alias("mean_aicc"), F.count(F.lit(1)).alias("n_best_model")
    )


def rmse_leaderboard(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per winner: how often it wins and the median of the mean scores, most wins first.

    The median is exact and never gathers a winner's series in one task.
    """
    best = with_best_model(wide, models, "mean_rmse")
    wins = best.groupBy("best_model").agg(F.count(F.lit(1)).alias("n_best_model"))
    median = exact_quantiles(best, ["mean_rmse"], [0.5], ["best_model"]).select(
        F.col("best_model").alias("_winner"), F.col("value").alias("median_rmse")
    )
    return (
        wins.join(median, F.col("best_model").eqNullSafe(F.col("_winner")), "left")
        .select("best_model", "median_rmse", "n_best_model")
        .orderBy(F.col("n_best_model").desc(), "best_model")
    )


def leaderboard_state(wide: DataFrame, models: Sequence[str], digits: int = 4) -> DataFrame:
    """Additive counts behind a leaderboard: per winner and mean score, rounded to `digits` (`cell`), how many series.

    States of disjoint series merge by `merge_leaderboards`, so a new batch is added and nothing is
    scored again. A state is as large as the scores differ at that rounding.
    """
    best = with_best_model(wide, models, "mean_score")
    cell = F.round(F.col("mean_score") * F.lit(float(10**digits))).cast("bigint")
    counts = best.groupBy("best_model", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("digits", F.lit(digits))


def merge_leaderboards(states: Sequence[DataFrame]) -> DataFrame:
    """One state of several."""
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other)
    return every.groupBy("best_model", "cell", "digits").agg(F.sum("n").alias("n")).select("best_model", "cell", "n", "digits")


def leaderboard(state: DataFrame) -> DataFrame:
    """Per winner, the median of the mean scores and how often it wins, most wins first."""
    own = Window.partitionBy("best_model")
    scored = F.when(F.col("cell").isNotNull(), F.col("n"))
    ranked = state.withColumns(
        {
            "upto": F.sum(scored).over(own.orderBy(F.col("cell").asc_nulls_last())),
            "total": F.coalesce(F.sum(scored).over(own), F.lit(0)),
        }
    )
    # The ranks, from 0, on both sides of the middle; a cell holds those below `upto` that no cell before it holds.
    middle = [F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)]
    holds = [scored.isNotNull() & (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")) for r in middle]
    value = F.col("cell") / F.pow(F.lit(10.0), F.col("digits"))
    low, high = (F.max(F.when(h, value)) for h in holds)
    return (
        ranked.groupBy("best_model")
        .agg(((low + high) / 2).alias("median_rmse"), F.sum("n").alias("n_best_model"))
        .orderBy(F.col("n_best_model").desc(), "best_model")
    )


def acf(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    index: str = "week",
    lag_max: int = 55,
) -> DataFrame:
    """Autocorrelation of each series at lags 1..lag_max (fewer for short series).

    A series becomes one array ordered by time, which is read once: the fold carries the last
    `lag_max` values and, for each lag, the running sum of products with them. NULLs are left out
    of the mean and of every product they touch.
    """
    rows = df.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("t"), F.col(value).cast("double").alias("x")))).alias("s"),
        F.avg(F.col(value).cast("double")).alias("mean"),
    )
    # Too short a series goes before the rows are dealt: a filter on what the fold gives would fold twice.
    centred = deal_series(rows.where(F.size("s") > 1), cost=F.size("s"), keys=by).select(
        *by,
        F.transform("s", lambda p: F.coalesce(p["x"] - F.col("mean"), F.lit(0.0))).alias("z"),
    )
    zeros = F.array_repeat(F.lit(0.0), lag_max + 1)

    def step(s: Column, v: Column) -> Column:
        recent = F.concat(F.array(v), F.slice(s["recent"], 1, lag_max))
        return F.struct(
            recent.alias("recent"),
            F.zip_with(s["sums"], recent, lambda total, r: total + r * v).alias("sums"),
        )

    sums = F.aggregate("z", F.struct(zeros.alias("recent"), zeros.alias("sums")), step, lambda s: s["sums"])
    lags = F.sequence(F.lit(1), F.least(F.lit(lag_max), F.size("z") - 1))

    def at(lag: Column) -> Column:
        return F.struct(lag.alias("lag"), F.try_divide(F.get("sums", lag), F.get("sums", F.lit(0))).alias("acf"))

    folded = centred.withColumn("sums", sums)
    return folded.select(*by, F.inline_outer(F.transform(lags, at)))
