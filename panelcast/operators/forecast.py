"""Forecasts from the fit table, in plain column expressions.

The terminal state of each fit is rolled forward on the row itself; future rows
only bring their regressors. History is never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import fourier
from panelcast.functions.decompose import PERIOD
from panelcast.functions.intervals import back_transform
from panelcast.operators.features import SCENARIOS, add_scenarios, fill_flags
from panelcast.operators.fit import FOURIER, LAGS, PROMOTION, fitted_only
from panelcast.spec import FLAGS, WEEKLY, PanelSpec


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)


def arma_path(horizon: Column | int) -> Column:
    """array<(mu, sd)> of the ARIMA error process, `horizon` steps past the fit.

    The standard deviation grows through the psi weights, summed when the series
    was differenced.
    """
    phi1, phi2 = F.col("phi")[0], F.col("phi")[1]
    theta1, theta2 = F.col("theta")[0], F.col("theta")[1]
    differenced = F.col("d") == 1
    zero = F.lit(0.0)
    start = F.struct(
        F.col("n_tail")[0].alias("n1"),
        F.col("n_tail")[1].alias("n2"),
        F.col("e_tail")[0].alias("e1"),
        F.col("e_tail")[1].alias("e2"),
        zero.alias("psi1"),
        zero.alias("psi2"),
        zero.alias("total"),
        zero.alias("weight"),
        zero.alias("var"),
        F.array().cast("array<struct<mu:double,sd:double>>").alias("path"),
    )

    def advance(s: Column, h: Column) -> Column:
        n = phi1 * s["n1"] + phi2 * s["n2"] + theta1 * s["e1"] + theta2 * s["e2"]
        shock = F.when(h == 1, 1.0).when(h == 2, theta1).when(h == 3, theta2).otherwise(0.0)
        psi = phi1 * s["psi1"] + phi2 * s["psi2"] + shock
        total, weight = s["total"] + n, s["weight"] + psi
        mu = F.when(differenced, F.col("level") + total).otherwise(n)
        used = F.when(differenced, weight).otherwise(psi)
        var = s["var"] + used * used
        point = F.struct(mu.alias("mu"), F.sqrt(F.col("sigma2") * var).alias("sd"))
        return F.struct(
            n.alias("n1"),
            s["n1"].alias("n2"),
            zero.alias("e1"),
            s["e1"].alias("e2"),
            psi.alias("psi1"),
            s["psi1"].alias("psi2"),
            total.alias("total"),
            weight.alias("weight"),
            var.alias("var"),
            F.concat(s["path"], F.array(point)).alias("path"),
        )

    return F.aggregate(_steps(horizon), start, advance, lambda s: s["path"])


def _steps(horizon: Column | int) -> Column:
    """1 to horizon; none if it is below 1."""
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    return F.when(h >= 1, F.sequence(F.lit(1), h)).otherwise(F.array().cast("array<int>"))


def smoothing_path(horizon: Column | int, period: int = PERIOD) -> Column:
    """array<(mu, sd)> of level plus damped trend plus the last seasonal cycle, repeated."""
    damping = F.col("damping")

    def reach(h: Column) -> Column:
        """damping + damping^2 + ... + damping^h"""
        return (
            F.when(damping == 1, h.cast("double"))
            .when(damping == 0, 0.0)
            .otherwise(damping * (1 - F.pow(damping, h)) / (1 - damping))
        )

    def spread(h: Column) -> Column:
        earlier = F.filter(F.sequence(F.lit(0), h - 1), lambda j: j > 0)
        return 1 + _sum(
            F.transform(
                earlier, lambda j: F.pow(F.col("alpha") + F.col("slope_gain") * reach(j), F.lit(2.0))
            )
        )

    def point(h: Column) -> Column:
        season = F.coalesce(F.get("season", (h - 1) % period), F.lit(0.0))
        return F.struct(
            (F.col("level") + F.col("slope") * reach(h) + season).alias("mu"),
            F.sqrt(F.col("sigma2") * spread(h)).alias("sd"),
        )

    return F.transform(_steps(horizon), point)


def _state(fits: DataFrame, horizon: Column | int, spec: PanelSpec) -> DataFrame:
    """What a forecast needs of each fit, with the error process rolled forward."""
    return fitted_only(fits).select(
        *spec.keys,
        "model",
        "last_week",
        "const",
        "beta",
        "design",
        "x_last",
        F.when(F.col("kind") == "stl", smoothing_path(horizon))
        .when(F.col("kind") == "arima", arma_path(horizon))
        .otherwise(F.raise_error(F.concat(F.lit("no forecast of kind "), F.coalesce("kind", F.lit("NULL")))))
        .alias("path"),
    )


def _distribution(h: Column, previous: dict[str, Column], design: Sequence[str], week: str) -> dict:
    """mu and sigma of a row that holds a fit's state and the flags of its week.

    `previous` gives last week's flag, NULL at the first step, where the last
    observed flag kept in the fit stands in. A fit with effects must have been made
    with the same design.
    """
    seasonal = fourier(F.col(week))
    regressors = []
    for name in design:
        if name in LAGS:
            flag = name.removeprefix("lag_")
            last = F.get("x_last", F.lit(design.index(flag)))
            earlier = F.coalesce(previous[flag].cast("double"), F.lit(0.0))  # unknown flags are read as 0
            regressors.append(F.when(h == 1, last).otherwise(earlier))
        elif name in FOURIER:
            regressors.append(seasonal[name])
        else:
            regressors.append(F.col(name).cast("double"))
    x = F.array(*regressors) if regressors else F.array().cast("array<double>")
    names = F.array(*[F.lit(n) for n in design]).cast("array<string>")
    other = F.concat(
        F.lit("the fit was made with other regressors: "),
        F.coalesce(F.array_join("design", ", "), F.lit("unknown")),
    )
    effect = (
        F.when(F.col("beta").isNull(), 0.0)
        .when(~F.coalesce(F.col("design") == names, F.lit(False)), F.raise_error(other).cast("double"))
        .otherwise(_sum(F.zip_with("beta", x, lambda b, v: b * v)))
    )
    point = F.get("path", h - 1)
    return {
        "mu": point["mu"] + F.coalesce("const", F.lit(0.0)) + effect,
        "sigma": point["sd"],
    }


def forecast(
    fits: DataFrame,
    future: DataFrame,
    design: Sequence[str] = PROMOTION,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """Mean and standard deviation (square-root scale) for given future rows and their flags.

    Each fit is rolled forward as far as the rows of its series go. Rows that don't lie
    after the fit get NULL.
    """
    flags = fill_flags(future.select(*spec.row_id, *FLAGS))
    ordered = spec.in_order()
    near = F.datediff(spec.index, F.lag(spec.index, 1).over(ordered)) == spec.step_days
    rows = flags.withColumns({f"_prev_{f}": F.when(near, F.lag(f, 1).over(ordered)) for f in FLAGS})
    ends = flags.groupBy(*spec.keys).agg(F.max(spec.index).alias("_until"))
    ahead = (F.datediff("_until", "last_week") / spec.step_days).cast("int")
    state = _state(fits.join(ends, on=spec.key_list, how="inner"), ahead, spec)
    joined = rows.join(state, on=spec.key_list, how="inner")
    h = (F.datediff(spec.index, "last_week") / spec.step_days).cast("int")
    previous = {f: F.col(f"_prev_{f}") for f in FLAGS}
    return joined.withColumns(_distribution(h, previous, design, spec.index)).select(
        *spec.keys, "model", spec.index, *FLAGS, "mu", "sigma"
    )


def forecast_ahead(
    fits: DataFrame,
    n: int,
    scenarios: Sequence[tuple[int, ...]],
    design: Sequence[str] = PROMOTION,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """The same for the next `n` steps under each scenario, held over all of them.

    Every row comes from its fit alone: no history, no join, no shuffle.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(n)))
    rows = add_scenarios(_state(fits, n, spec).withColumn("h", steps), scenarios).withColumn(
        spec.index, F.date_add("last_week", F.col("h") * spec.step_days)
    )
    previous = {f: F.when(F.col("h") > 1, F.col(f)) for f in FLAGS}
    return rows.withColumns(_distribution(F.col("h"), previous, design, spec.index)).select(
        *spec.keys, "model", "fc_ind", spec.index, *FLAGS, "mu", "sigma"
    )


def add_intervals(forecasts: DataFrame) -> DataFrame:
    """Replace the distribution by the point forecast and its 80 and 95 % bounds."""
    out = forecasts.withColumns(back_transform(F.col("mu"), F.col("sigma")))
    return out.drop("mu", "sigma")


def forecast_next(
    fits: DataFrame, n: int = 2, design: Sequence[str] = PROMOTION, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """The next `n` weeks without promotions."""
    ahead = forecast_ahead(fits, n, SCENARIOS[:1], design, spec)
    return add_intervals(ahead).drop("fc_ind")


def forecast_scenarios(
    fits: DataFrame,
    n: int = 2,
    scenarios: Sequence[tuple[int, ...]] = SCENARIOS,
    design: Sequence[str] = PROMOTION,
    spec: PanelSpec = WEEKLY,
) -> DataFrame:
    """The next `n` weeks under every promotion scenario, numbered in `fc_ind`."""
    return add_intervals(forecast_ahead(fits, n, scenarios, design, spec))
