"""Registered queries: each runs library functions over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.rows import round_scaled
from panelcast.operators import (
    clean,
    features,
    fit,
    forecast,
    impute,
    increment,
    panel,
    profile,
    regress,
    rollup,
    sampling,
    score,
    smooth,
)
from panelcast.plans import dashboard, training, validation
from panelcast.sources import derive, tables
from panelcast.sources import checkpoints
from panelcast.spec import FLAGS, MEASURES, WEEKLY

Query = Callable[[SparkSession, str], DataFrame]
KEYS = WEEKLY.key_list
SCORED = ["arima_base", "arima_lagged", "arima_seasonal", "arima_seasonal_lagged"]
NUMBERS = ("units", "visits", "base_price")


def rounded(
    df: DataFrame, digits: int = 4, skip: tuple[str, ...] = (), snap: bool = False
) -> DataFrame:
    """Doubles rounded for comparison across engines.

    A mean of prices often ends in an exact 5; `snap` first rounds off the noise of
    the summation order, so that such ties fall the same way everywhere.
    """

    def number(name: str):
        return round_scaled(round_scaled(F.col(name), 8) if snap else F.col(name), digits)

    return df.select(
        *[
            number(f.name).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in skip
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# Inputs -----------------------------------------------------------------------------------


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return derive.transactions(spark, sf)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return panel.filter_series(weekly(spark, sf))


def category_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.category_weekly(weekly(spark, sf), derive.products(spark, sf))


def raw_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly table under its landing names, dated by the week's end."""
    return weekly(spark, sf).select(
        F.date_add("week", 6).alias("WEEK_END_DATE"),
        F.col("store_id").cast("bigint").alias("STORE_NUM"),
        F.substring("upc_id", 7, 10).cast("bigint").alias("UPC"),
        F.col("units").alias("UNITS"),
        F.col("feature").alias("FEATURE"),
    )


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage; without a checkpoint folder in the session, in the warehouse."""
    warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir")
    return checkpoints.cut(df, f"{warehouse}/checkpoints")


def standin_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic forecasts of the last four weeks, to exercise scoring and views.

    "stl" carries the last known training value, "arima" is the mean of the last
    four training weeks; sigma is the spread of root units in training.
    """
    known = F.col("units").isNotNull()
    labelled = panel.label_holdout_split(filled(spark, sf)).withColumn(
        "_back", F.row_number().over(WEEKLY.newest_first())
    )
    train = F.col("split") == "train"
    base = labelled.groupBy(*KEYS).agg(
        F.max_by("units", F.when(train & known, F.col("week"))).alias("stl"),
        F.avg(F.when(train & (F.col("_back") <= 8), F.col("units"))).alias("arima"),
        F.stddev_samp(F.when(train, F.sqrt("units"))).alias("sigma"),
        F.max("week").alias("_end"),
    )
    ahead = base.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(3))))
    long = ahead.select(
        *KEYS, F.date_sub("_end", F.col("_h") * 7).alias("week"), "sigma", "stl", "arima"
    ).unpivot([*KEYS, "week", "sigma"], ["arima", "stl"], "model", "point")
    dist = long.select(*KEYS, "model", "week", F.sqrt("point").alias("mu"), "sigma")
    return forecast.add_intervals(dist)


def standin_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Change on the last known value, as innovations of two stand-in models."""
    carried = impute.carry_forward(filled(spark, sf))
    previous = F.lag("units", 1).over(WEEKLY.in_order())
    moved = carried.select(
        *KEYS,
        "week",
        (F.sqrt("units") - F.sqrt(previous)).alias("stl"),
        (F.sqrt("units") - F.lit(5.0)).alias("arima"),
    )
    return moved.unpivot([*KEYS, "week"], ["arima", "stl"], "model", "innov")


def standin_scores(spark: SparkSession, sf: str) -> DataFrame:
    """AICc of one-regressor fits of root units, one column per model name."""
    y = F.sqrt("units")
    rows = weekly(spark, sf)
    regressors = {
        "arima_base": F.col("feature"),
        "arima_lagged": F.col("display"),
        "arima_seasonal": F.col("tpr_only"),
        "arima_seasonal_lagged": F.col("visits"),
    }

    def aicc(x):
        n = F.regr_count(y, x)
        sse = F.regr_syy(y, x) - F.try_divide(
            F.pow(F.regr_sxy(y, x), F.lit(2.0)), F.regr_sxx(y, x)
        )
        k = F.lit(3.0)
        value = n * F.ln(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        # Rounded, so that equal fits tie on every engine and the first model wins.
        return F.when((n > 12) & (sse > 0.001), F.round(value, 6))

    return rows.groupBy(*KEYS).agg(*[aicc(x).alias(m) for m, x in regressors.items()])


def standin_fits(spark: SparkSession, sf: str) -> DataFrame:
    """A fit table with fixed parameters and each series' own terminal state."""
    rows = panel.drop_last_rows(impute.carry_forward(filled(spark, sf)), 4)
    root = F.sqrt("units")
    last = F.max_by(F.struct(root.alias("y"), *FLAGS), "week")
    state = rows.groupBy(*KEYS).agg(
        last.alias("l"), F.max("week").alias("last_week"), F.avg(root).alias("mean")
    )

    def doubles(*values: float):
        return F.array(*[F.lit(float(v)) for v in values])

    flags = [F.coalesce(F.col(f"l.{f}"), F.lit(0)).cast("double") for f in FLAGS]
    x_last = F.array(*flags, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    effect = flags[0] * 1.5 + flags[1] * 0.8 + flags[2] * 0.4
    shared = dict(
        status=F.lit("ok"),
        kind=F.lit("arima"),
        design=F.array(*[F.lit(c) for c in fit.PROMOTION]),
        beta=doubles(1.5, 0.8, 0.4, -0.5, 0.0, 0.0),
        x_last=x_last,
        sigma2=F.lit(0.25),
    )
    level = F.col("l.y") - effect
    stationary = state.withColumns(
        dict(
            shared,
            model=F.lit("arima"),
            d=F.lit(0),
            const=F.col("mean"),
            phi=doubles(0.6, 0.0),
            theta=doubles(0.3, 0.0),
            n_tail=F.array(level - F.col("mean"), F.lit(0.0)),
            e_tail=doubles(0.2, 0.0),
            level=F.lit(0.0),
        )
    )
    walk = state.withColumns(
        dict(
            shared,
            model=F.lit("arima_walk"),
            d=F.lit(1),
            const=F.lit(0.0),
            phi=doubles(0.0, 0.0),
            theta=doubles(-0.4, 0.0),
            n_tail=doubles(0.0, 0.0),
            e_tail=doubles(0.5, 0.0),
            level=level,
        )
    )
    season = F.transform(F.sequence(F.lit(0), F.lit(51)), lambda i: (i % 4) * F.lit(0.1))
    smoothing = state.select(
        *KEYS,
        "last_week",
        F.lit("ok").alias("status"),
        F.lit("stl").alias("model"),
        F.lit("stl").alias("kind"),
        F.col("l.y").alias("level"),
        F.lit(0.25).alias("sigma2"),
        F.lit(0.3).alias("alpha"),
        F.lit(0.1).alias("slope_gain"),
        F.lit(0.9).alias("damping"),
        F.lit(0.05).alias("slope"),
        season.alias("season"),
    )
    arima = stationary.unionByName(walk).drop("l", "mean")
    return arima.unionByName(smoothing, allowMissingColumns=True)


# Cleaning ---------------------------------------------------------------------------------


def q_rename_keys(spark, sf):
    return tables.rename_keys(tables.clean_names(raw_transactions(spark, sf)))


def q_format_transactions(spark, sf):
    return clean.format_transactions(q_rename_keys(spark, sf))


def q_store_merge_duplicates(spark, sf):
    return clean.merge_repeated_stores(derive.store(spark, sf))


def q_product_size_units(spark, sf):
    products = tables.rename_keys(derive.sized_products(spark, sf))
    return rounded(clean.convert_sizes(products), 6)


def q_product_size_no_counts(spark, sf):
    products = tables.rename_keys(derive.sized_products(spark, sf))
    return rounded(clean.convert_sizes(products, count_as_mass=False), 6)


# Panel ------------------------------------------------------------------------------------


def q_weekly_panel(spark, sf):
    return weekly(spark, sf)


def q_panel_key_check(spark, sf):
    return panel.key_duplicates(derive.sale_lines(spark, sf))


def q_fill_gaps(spark, sf):
    return panel.fill_gaps(weekly(spark, sf))


def q_missing_transactions(spark, sf):
    return panel.count_missing(weekly(spark, sf))


def q_missingness(spark, sf):
    return rounded(panel.missing_ratio(panel.count_missing(weekly(spark, sf))), 6)


def q_missingness_by_span(spark, sf):
    return rounded(panel.missing_ratio_by_span(weekly(spark, sf)), 6)


def q_series_min_obs(spark, sf):
    return panel.keep_long_series(weekly(spark, sf))


def q_filter_series(spark, sf):
    return filled(spark, sf)


def q_sample_series(spark, sf):
    ratio = panel.missing_ratio(panel.count_missing(weekly(spark, sf)))
    return rounded(sampling.sample_series(ratio, derive.products(spark, sf)), 6)


def q_sampled_transactions(spark, sf):
    rows = weekly(spark, sf)
    ratio = panel.missing_ratio_by_span(rows)
    picked = sampling.sample_series(ratio, derive.products(spark, sf))
    return rounded(sampling.sampled_rows(picked, rows), 6)


def q_incomplete_series(spark, sf):
    return impute.incomplete_series(filled(spark, sf))


def q_locf_impute(spark, sf):
    return impute.carry_forward(filled(spark, sf))


def q_calendar_split(spark, sf):
    return panel.label_calendar_split(panel.fill_gaps(weekly(spark, sf))).select(
        "week", *KEYS, "units", "split"
    )


def q_holdout_split(spark, sf):
    return panel.label_holdout_split(filled(spark, sf)).select("week", *KEYS, "units", "split")


def q_train_rows(spark, sf):
    return panel.drop_last_rows(filled(spark, sf), 4)


def q_holdout_from_join(spark, sf):
    rows = filled(spark, sf)
    return panel.holdout_from_join(panel.drop_last_rows(rows, 4), rows)


def q_union_full_panel(spark, sf):
    train, test = panel.holdout_split(filled(spark, sf))
    return panel.full_panel(train, test)


def q_future_rows(spark, sf):
    return panel.future_rows(weekly(spark, sf), 2)


def q_scenario_grid(spark, sf):
    return features.add_scenarios(panel.future_rows(weekly(spark, sf), 2))


def q_recent_history(spark, sf):
    return panel.last_rows(filled(spark, sf), 10)


def q_lag_features(spark, sf):
    rows = features.fill_flags(filled(spark, sf))
    return features.lag_features(rows).select(
        "week", *KEYS, *FLAGS, *[f"lag_{f}" for f in FLAGS]
    )


def q_fourier_features(spark, sf):
    weeks = filled(spark, sf).select("week").distinct()
    return rounded(features.fourier_features(weeks), 6)


# Profile ----------------------------------------------------------------------------------


def q_transactions_products(spark, sf):
    return rollup.with_products(weekly(spark, sf), derive.products(spark, sf))


def q_category_weekly(spark, sf):
    return rounded(category_weeks(spark, sf), 2, snap=True)


def q_column_summary(spark, sf):
    return profile.column_summary(weekly(spark, sf), MEASURES).transform(
        lambda d: rounded(d, 4, ("mean", "sd", "min", "max"))
    )


def q_text_summary(spark, sf):
    return profile.text_summary(
        tables.read_star(spark, sf, "part"), ["p_name", "p_brand", "p_type"]
    )


def q_date_summary(spark, sf):
    return profile.date_summary(weekly(spark, sf), ["week"])


def q_price_range(spark, sf):
    return rounded(profile.price_range(weekly(spark, sf)), snap=True)


def q_outlier_flags(spark, sf):
    return profile.outlier_flags(weekly(spark, sf))


def q_outlier_counts(spark, sf):
    return profile.outlier_counts(profile.outlier_flags(weekly(spark, sf)))


def q_outlier_counts_strict(spark, sf):
    return profile.outlier_counts(profile.outlier_flags(filled(spark, sf)), strict_nulls=True)


def q_product_long(spark, sf):
    return rounded(rollup.product_long(category_weeks(spark, sf)), 2, snap=True)


def q_promo_long(spark, sf):
    return rounded(rollup.promotion_long(category_weeks(spark, sf)), snap=True)


def q_promo_long_one_category(spark, sf):
    return rounded(rollup.promotion_long(category_weeks(spark, sf), "CAT1"), snap=True)


def q_pair_corr(spark, sf):
    return rounded(profile.pair_correlations(category_weeks(spark, sf), NUMBERS, ["category"]), 6)


def q_pair_corr_overall(spark, sf):
    return rounded(profile.pair_correlations(weekly(spark, sf), MEASURES), 6)


def q_pair_corr_by_flag(spark, sf):
    rows = rollup.with_products(weekly(spark, sf), derive.products(spark, sf))
    return rounded(profile.pair_correlations_by_flag(rows, NUMBERS, by=["category"]), 6)


def q_group_five_number(spark, sf):
    rows = rollup.with_products(weekly(spark, sf), derive.products(spark, sf))
    return rounded(profile.five_numbers(rows, NUMBERS, by=["category"]))


def q_flag_crosstab(spark, sf):
    return profile.flag_crosstab(category_weeks(spark, sf), by=["category"])


# Models with a closed form ----------------------------------------------------------------


def q_ols_one_regressor(spark, sf):
    rows = weekly(spark, sf).withColumn("root", F.sqrt("units"))
    return rounded(regress.one_regressor(rows, "root", "feature"))


def q_ols_flags(spark, sf):
    rows = weekly(spark, sf).withColumn("root", F.sqrt("units"))
    return rounded(regress.least_squares(rows, "root", FLAGS))


def q_ols_moments_one_regressor(spark, sf):
    rows = weekly(spark, sf).withColumn("root", F.sqrt("units"))
    return rounded(regress.least_squares(rows, "root", ["visits"]))


def q_ses_fixed_alpha(spark, sf):
    rows = filled(spark, sf).withColumn("root", F.sqrt("units"))
    return rounded(smooth.simple_smoothing(rows, "root", 0.3))


def q_ses_best_alpha(spark, sf):
    rows = filled(spark, sf).withColumn("root", F.sqrt("units"))
    return rounded(smooth.best_smoothing(rows, "root"))


def q_smoothing_forms(spark, sf):
    rows = filled(spark, sf).withColumn("root", F.sqrt("units"))
    return rounded(smooth.best_forms(rows, "root"))


def q_interval_bounds(spark, sf):
    return rounded(standin_forecasts(spark, sf))


def q_forecast_ahead_smoothing(spark, sf):
    fits = standin_fits(spark, sf).where(F.col("model") == "stl")
    return rounded(forecast.forecast_next(fits, 4).drop(*FLAGS))


def q_forecast_fixed_fits(spark, sf):
    _, test = panel.holdout_split(filled(spark, sf))
    return rounded(forecast.forecast(standin_fits(spark, sf), test).drop(*FLAGS))


def q_scenarios_fixed_fits(spark, sf):
    fits = standin_fits(spark, sf).where(F.col("model") != "stl")
    return rounded(forecast.forecast_scenarios(fits))


# Scores and views -------------------------------------------------------------------------


def q_rmse_by_series_model(spark, sf):
    scored = score.with_actuals(standin_forecasts(spark, sf), filled(spark, sf))
    return rounded(score.models_wide(score.rmse(scored), "rmse", ["arima", "stl"]))


def q_rmse_strict(spark, sf):
    scored = score.with_actuals(standin_forecasts(spark, sf), filled(spark, sf))
    return rounded(score.rmse(scored, strict_nulls=True))


def q_rmse_leaderboard(spark, sf):
    scored = score.with_actuals(standin_forecasts(spark, sf), filled(spark, sf))
    wide = score.models_wide(score.rmse(scored), "rmse", ["arima", "stl"])
    return rounded(score.rmse_leaderboard(wide, ["arima", "stl"]))


def q_leaderboard_merged(spark, sf):
    """The leaderboard of all stores from the states of each half."""
    scored = score.with_actuals(standin_forecasts(spark, sf), filled(spark, sf))
    wide = score.models_wide(score.rmse(scored), "rmse", ["arima", "stl"])
    halves = [wide.where(F.col("store_id").isin("0", "1") == first) for first in (True, False)]
    states = [score.leaderboard_state(half, ["arima", "stl"]) for half in halves]
    return rounded(score.leaderboard(score.merge_leaderboards(states)))


def q_units_histogram_by_store(spark, sf):
    return rounded(profile.histogram(weekly(spark, sf), "units", ["store_id", "upc_id"]))


def q_best_model_per_series(spark, sf):
    return rounded(
        score.with_best_model(standin_scores(spark, sf), SCORED, "mean_aicc").select(
            *KEYS, "mean_aicc", "best_model"
        )
    )


def q_aicc_leaderboard(spark, sf):
    return rounded(score.aicc_leaderboard(standin_scores(spark, sf), SCORED))


def q_model_fallback(spark, sf):
    """The lagged model where it has a score, else the base one, else nothing."""
    wide = standin_scores(spark, sf)
    long = wide.unpivot(KEYS, ["arima_seasonal", "arima_base"], "model", "aicc").withColumn(
        "status", F.when(F.col("aicc").isNotNull(), "ok").otherwise("not fitted")
    )
    return rounded(
        fit.prefer_model(long, ["arima_seasonal", "arima_base"], "arima").drop("status")
    )


def q_model_bind(spark, sf):
    """Series that both of two fit tables hold, with both scores."""
    wide = standin_scores(spark, sf)
    left = wide.where(F.col("arima_seasonal").isNotNull()).select(*KEYS, "arima_seasonal")
    right = wide.where(F.col("arima_base") < F.col("arima_lagged")).select(*KEYS, "arima_base")
    kept_left, kept_right = fit.bind_models(left, right)
    return rounded(kept_left.join(kept_right, KEYS))


def q_residual_acf(spark, sf):
    return rounded(dashboard.residual_acf(standin_residuals(spark, sf)))


def q_residual_histogram(spark, sf):
    return rounded(dashboard.residual_histogram(standin_residuals(spark, sf)))


def q_units_histogram(spark, sf):
    return rounded(profile.histogram(weekly(spark, sf), "units"))


def q_store_products(spark, sf):
    return dashboard.store_products(weekly(spark, sf))


def q_store_choices(spark, sf):
    return dashboard.store_choices(clean.merge_repeated_stores(derive.store(spark, sf)))


def q_series_history(spark, sf):
    return dashboard.series(filled(spark, sf), "1", "Brand#7")


def q_holdout_view(spark, sf):
    return rounded(dashboard.history_and_holdout(filled(spark, sf), standin_forecasts(spark, sf)))


def q_series_rmse(spark, sf):
    return rounded(dashboard.holdout_rmse(filled(spark, sf), standin_forecasts(spark, sf)))


def q_scenario_lookup(spark, sf):
    rows = panel.drop_last_rows(filled(spark, sf), 4)
    fits = standin_fits(spark, sf).where(F.col("model") == "arima")
    scenarios = forecast.forecast_scenarios(fits)
    stl = standin_forecasts(spark, sf).where(F.col("model") == "stl")
    return rounded(dashboard.scenario_view(rows, scenarios, stl, feature=1, display=1))


def q_scenario_lookup_invalid(spark, sf):
    rows = panel.drop_last_rows(filled(spark, sf), 4)
    scenarios = forecast.forecast_scenarios(standin_fits(spark, sf))
    stl = standin_forecasts(spark, sf).where(F.col("model") == "stl")
    return rounded(dashboard.scenario_view(rows, scenarios, stl, feature=1, tpr_only=1))


def q_residuals_fixed_fits(spark, sf):
    """Residual rows of a fit table whose one-step fit is the last known root."""
    rows = filled(spark, sf)
    so_far = WEEKLY.in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = rows.withColumn("_root", F.sqrt(F.last("units", ignorenulls=True).over(so_far)))
    known = known.withColumn("_fit", F.lag("_root", 1).over(WEEKLY.in_order()))
    innov = F.sqrt("units") - F.col("_fit")
    point = F.struct("week", "units", F.col("_fit").alias("fitted"), innov.alias("innov"))
    fits = known.groupBy(*KEYS).agg(F.array_sort(F.collect_list(point)).alias("s")).select(
        *KEYS,
        F.lit("walk").alias("model"),
        F.lit("ok").alias("status"),
        F.element_at("s", 1)["week"].alias("first_week"),
        F.element_at("s", -1)["week"].alias("last_week"),
        *[F.transform("s", (lambda c: lambda p: p[c])(c)).alias(c) for c in ("units", "fitted", "innov")],
    )
    return rounded(fit.residuals(fits))


def q_aicc_fixed_fits(spark, sf):
    """The wide table of criteria, from a long fit table that holds another kind of model too."""
    scores = standin_scores(spark, sf)
    long = scores.unpivot(KEYS, list(SCORED), "model", "aicc").withColumn("kind", F.lit("arima"))
    other = long.where(F.col("model") == SCORED[0]).withColumns({"kind": F.lit("stl"), "model": F.lit("stl")})
    return rounded(validation.aicc_table(long.unionByName(other)))


# Fitted models --------------------------------------------------------------

FIT_SUMMARY = [*KEYS, "model", "status", "n_obs", "p", "d", "q", "sigma2", "aicc"]


def q_fit_arima(spark, sf):
    return rounded(fit.fit_models(filled(spark, sf), fit.PLAIN, ()).select(*FIT_SUMMARY))


def q_fit_incremental(spark, sf):
    """The fits of `fit_arima` by a state of the weeks before 1998 and the later weeks added to it."""
    # Both halves read the panel: it is computed once, with what a state keeps.
    rows, turn = cut(filled(spark, sf).select(*WEEKLY.row_id, "units")), F.to_date(F.lit("1997-12-29"))
    split = F.max(F.when((F.col("week") < turn) & F.col("units").isNotNull(), F.col("week"))).over(WEEKLY.over_series())
    halves = rows.withColumn("_until", split)
    early = increment.fit_state(halves.where(F.col("week") <= F.col("_until")).select(*rows.columns), ())
    late = halves.where(F.col("_until").isNull() | (F.col("week") > F.col("_until"))).where(F.col("units").isNotNull())
    state = increment.extend_state(cut(early), late.select(*rows.columns), ())
    return rounded(increment.fits_of_state(state, fit.PLAIN, ()).select(*FIT_SUMMARY))


def q_fit_dynamic_regression(spark, sf):
    models = {m: fit.VALIDATION_MODELS[m] for m in ("arima_base", "arima_lagged")}
    fits = fit.fit_models(filled(spark, sf), models, fit.PROMOTION)
    effects = [F.get("beta", F.lit(i)).alias(f"b_{c}") for i, c in enumerate(fit.PROMOTION)]
    return rounded(fits.select(*FIT_SUMMARY, "const", *effects))


def q_fit_seasonal_regression(spark, sf):
    models = {m: fit.VALIDATION_MODELS[m] for m in ("arima_seasonal", "arima_seasonal_lagged")}
    return rounded(fit.fit_models(filled(spark, sf), models, fit.SEASONAL).select(*FIT_SUMMARY))


def q_fit_stl_ets(spark, sf):
    complete = impute.carry_forward(filled(spark, sf))
    models = {"stl": fit.VALIDATION_MODELS["stl"]}
    return rounded(
        fit.fit_models(complete, models, ()).select(
            *KEYS, "model", "status", "n_obs", "alpha", "slope_gain", "damping", "level", "sigma2"
        )
    )


def q_train_models(spark, sf):
    return rounded(fit.train_models(filled(spark, sf)).select(*FIT_SUMMARY))


def q_residuals(spark, sf):
    return rounded(fit.residuals(fit.train_models(filled(spark, sf))))


def q_impute_model(spark, sf):
    return rounded(impute.impute(filled(spark, sf)))


def q_forecast_holdout(spark, sf):
    train, test = panel.holdout_split(filled(spark, sf))
    return rounded(training.holdout_forecast(fit.train_models(train), test))


def q_forecast_scenarios(spark, sf):
    fits = fit.train_models(filled(spark, sf)).where(F.col("model") == "arima")
    return rounded(forecast.forecast_scenarios(fits))


def q_forecast_stl(spark, sf):
    fits = fit.train_models(filled(spark, sf)).where(F.col("model") == "stl")
    return rounded(forecast.forecast_next(fits).drop(*FLAGS))


def _sample(spark, sf):
    """Both halves of the imputed sample; the imputation runs once."""
    rows = weekly(spark, sf)
    ratio = panel.missing_ratio_by_span(rows)
    picked = sampling.sample_series(ratio, derive.products(spark, sf))
    return panel.calendar_split(cut(impute.impute(sampling.sampled_rows(picked, rows))))


def q_validation_aicc(spark, sf):
    train, _ = _sample(spark, sf)
    return rounded(validation.aicc_table(validation.validation_fits(train)))


def q_validation_rmse(spark, sf):
    train, val = _sample(spark, sf)
    finalists = {m: fit.VALIDATION_MODELS[m] for m in validation.FINALISTS}
    return rounded(validation.rmse_table(fit.fit_models(train, finalists), val))


def q_validation_leaderboard(spark, sf):
    train, val = _sample(spark, sf)
    finalists = {m: fit.VALIDATION_MODELS[m] for m in validation.FINALISTS}
    wide = cut(validation.rmse_table(fit.fit_models(train, finalists), val))
    return rounded(score.rmse_leaderboard(wide, validation.FINALISTS))


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): fn for name, fn in list(globals().items()) if name.startswith("q_")
}
