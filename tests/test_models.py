"""Planted parameters come back; forecasts obey their properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import planted
from panelcast.functions import decompose, moments
from panelcast.operators import fit, forecast, gaps, impute, increment, panel, regress, score, smooth
from panelcast.spec import FLAGS

KEYS = ["store_id", "upc_id"]


def load(spark, table):
    return spark.createDataFrame(table).withColumn("week", F.col("week").cast("date"))


@pytest.fixture(scope="module")
def promo(spark):
    return load(spark, planted.ar1_promo())


@pytest.fixture(scope="module")
def promo_fits(promo):
    fits = fit.train_models(promo).cache()
    yield fits
    fits.unpersist()


def beta(fits, name):
    position = fit.PROMOTION.index(name)
    return fits.where("model = 'arima'").agg(F.avg(F.get("beta", F.lit(position)))).first()[0]


def test_promotion_effects_and_noise(promo_fits):
    fits = promo_fits.where("model = 'arima'")
    assert fits.where("status = 'ok'").count() == 60
    for name, truth in zip(FLAGS, planted.EFFECTS, strict=True):
        assert beta(promo_fits, name) == pytest.approx(truth, abs=0.05)
        assert beta(promo_fits, f"lag_{name}") == pytest.approx(0, abs=0.05)
    assert fits.agg(F.median("sigma2")).first()[0] == pytest.approx(0.25, abs=0.02)
    ar1 = fits.where("p = 1 and d = 0 and q = 0").agg(F.count("*"), F.avg(F.get("phi", F.lit(0))))
    n, phi = ar1.first()
    assert n > 20 and phi == pytest.approx(0.6, abs=0.06)


def test_lagged_effect(spark):
    fits = fit.train_models(load(spark, planted.ar1_promo(40, lag_effect=-0.5))).cache()
    for name in fit.LAGS:
        assert beta(fits, name) == pytest.approx(-0.5, abs=0.06)
    fits.unpersist()


def test_lagged_model_wins_by_aicc(spark):
    df = load(spark, planted.ar1_promo(24, lag_effect=-0.5))
    models = {m: fit.VALIDATION_MODELS[m] for m in ("arima_base", "arima_lagged")}
    aicc = fit.information_criteria(fit.fit_models(df, models, fit.PROMOTION))
    wide = score.models_wide(aicc, "aicc", list(models))
    board = {r.best_model: r.n_best_model for r in score.aicc_leaderboard(wide, list(models)).collect()}
    assert board == {"arima_lagged": 24}


def test_seasonal_regression_follows_the_year(spark):
    df = load(spark, planted.seasonal())
    models = {"arima_seasonal": fit.VALIDATION_MODELS["arima_seasonal"]}
    got = fit.residuals(fit.fit_models(df, models, fit.SEASONAL))
    assert got.agg(F.stddev("innov")).first()[0] == pytest.approx(0.3, abs=0.05)


def test_decomposition_finds_season_and_trend(spark):
    df = load(spark, planted.seasonal())
    fits = fit.fit_models(df, {"stl": fit.VALIDATION_MODELS["stl"]}, ())
    assert fits.where("status = 'ok' and size(season) = 52").count() == 20
    fc = forecast.add_intervals(
        forecast.forecast(fits, panel.future_rows(df, 26).withColumns({f: F.lit(0) for f in FLAGS}), ())
    ).toPandas()
    first = df.agg(F.min("week")).first()[0]
    t = np.array([(w - first).days // 7 for w in fc["week"]])
    truth = 10 + 2 * np.sin(2 * np.pi * t / 52) + 0.01 * t
    assert np.abs(np.sqrt(fc["p_units"]) - truth).mean() < 0.35


def test_decomposition_parts_add_up():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(130, 3)).cumsum(0)
    trend, seasonal = decompose.stl_matrices(130)
    # A constant is all trend; a repeating cycle of mean zero is all season.
    flat = np.full((130, 1), 7.0)
    assert np.allclose(trend @ flat, flat) and np.allclose(seasonal @ flat, 0)
    cycle = rng.normal(size=52)
    wave = np.tile(cycle - cycle.mean(), 3)[:130, None]
    assert np.allclose(seasonal @ wave, wave) and np.allclose(trend @ wave, 0)
    short = decompose.stl_matrices(90)[1]
    assert not short.any()
    assert (trend @ y).shape == y.shape


def test_loess_equals_weighted_least_squares():
    rng = np.random.default_rng(4)
    y = rng.normal(size=30)
    got = decompose.loess_matrix(30, 9, 1, np.arange(30)) @ y
    x = np.arange(30.0)
    for at in (0, 4, 17, 29):
        d = np.abs(x - at)
        reach = np.sort(d)[8]
        w = (1 - np.clip(d / reach, 0, 1) ** 3) ** 3
        slope, level = np.polyfit(x - at, y, 1, w=np.sqrt(w))
        assert got[at] == pytest.approx(level)


def test_smoothing_parameter(spark):
    df = load(spark, planted.level_only()).withColumn("root", F.sqrt("units"))
    best = smooth.best_smoothing(df, "root")
    assert best.agg(F.median("alpha")).first()[0] == pytest.approx(0.3, abs=0.06)


def plain_smoothing(y, alpha, gain, damping):
    """Level, slope, squared error and what was expected of each value."""
    first = min(len(y), smooth.OPENING) - 1
    level, slope = y[0], (y[first] - y[0]) / max(first, 1) if damping else 0.0
    sse, path = 0.0, [None]
    for v in y[1:]:
        ahead = level + damping * slope
        path.append(ahead)
        level, slope = ahead + alpha * (v - ahead), damping * slope + gain * (v - ahead)
        sse += (v - ahead) ** 2
    return level, slope, sse, path


@pytest.mark.parametrize("case", [(0.5, 0.0, 0.0), (0.3, 0.06, 1.0), (0.7, 0.2, 0.9)])
def test_smoothing_folds_equal_a_loop(spark, case):
    y = np.random.default_rng(1).normal(size=30).cumsum().tolist()
    df = spark.createDataFrame([(y,), ([4.0],), ([4.0, 5.0],)], "y array<double>")
    args = [F.lit(v) for v in case]
    got = df.select("y", smooth.fold("y", *args).alias("f"), smooth.one_step_ahead("y", *args).alias("p")).collect()
    for r in got:
        level, slope, sse, path = plain_smoothing(r.y, *case)
        assert (r.f.level, r.f.slope, r.f.sse) == pytest.approx((level, slope, sse))
        assert r.p[0] is None and r.p[1:] == pytest.approx(path[1:])


def test_smoothing_picks_the_form(spark):
    t = np.arange(120.0)
    noise = np.random.default_rng(3).normal(0, 0.3, (3, 120))
    level = plain_level(0.5, noise[0])
    rows = {"level": level, "trend": 2 * t + noise[1], "damped": 40 * (1 - 0.9**t) + noise[2]}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], "k string, y array<double>")
    best = {r.k: r.form for r in smooth.with_best_form(df, "y").collect()}
    assert best["level"].damping == 0 and best["trend"].damping > 0 and best["damped"].damping > 0
    assert best["trend"].slope == pytest.approx(2, abs=0.2) and abs(best["damped"].slope) < 0.2
    for k, v in rows.items():
        b = best[k]
        assert plain_smoothing(v, b.alpha, b.slope_gain, b.damping)[2] == pytest.approx(b.sse)
    short = spark.createDataFrame([([1.0, 2.0],), (None,)], "y array<double>")
    assert [r.form for r in smooth.with_best_form(short, "y").collect()] == [None, None]


def plain_level(alpha, shocks):
    level, out = 10.0, []
    for e in shocks:
        out.append(level + e)
        level += alpha * e
    return np.array(out)


def test_least_squares_equals_numpy(spark, promo):
    df = promo.withColumn("root", F.sqrt("units")).repartition(7)
    got = regress.least_squares(df, "root", FLAGS).toPandas()
    table = df.toPandas()
    for row in got.head(5).itertuples():
        own = table[(table.store_id == row.store_id) & (table.upc_id == row.upc_id)]
        x = np.column_stack([np.ones(len(own)), *[own[f] for f in FLAGS]]).astype(float)
        truth = np.linalg.lstsq(x, own.root.to_numpy(), rcond=None)[0]
        assert np.allclose([row.intercept, row.b_feature, row.b_display, row.b_tpr_only], truth)


def test_interval_coverage_and_order(promo):
    train, test = panel.holdout_split(promo, 8)
    fc = forecast.add_intervals(forecast.forecast(fit.train_models(train), test))
    rows = score.with_actuals(fc.where("model = 'arima'"), promo).toPandas()
    assert len(rows) == 60 * 8
    inside80 = ((rows.units >= rows.low80) & (rows.units <= rows.up80)).mean()
    inside95 = ((rows.units >= rows.low95) & (rows.units <= rows.up95)).mean()
    assert 0.70 < inside80 < 0.90 and 0.88 < inside95 < 1.0
    assert ((rows.up95 >= rows.up80) & (rows.up80 >= rows.low80) & (rows.low80 >= rows.low95)).all()
    assert (rows.low95 >= 0).all()


def test_scenarios_move_by_the_effects(promo, promo_fits):
    arima = promo_fits.where("model = 'arima'")
    fc = forecast.forecast_scenarios(arima)
    assert fc.count() == 60 * 5 * 2
    by = {r.fc_ind: r.m for r in fc.groupBy("fc_ind").agg(F.avg(F.sqrt("p_units")).alias("m")).collect()}
    assert by[2] - by[1] == pytest.approx(1.5, abs=0.1)
    assert by[5] - by[1] == pytest.approx(2.3, abs=0.1)


def test_first_future_week_reads_the_last_flag(spark, promo):
    """Two panels differing only in the last observed flag differ by the lag effect."""
    fits = fit.train_models(promo).where("model = 'arima'").limit(1).cache()
    flipped = fits.withColumn("x_last", F.transform("x_last", lambda v: 1 - v))
    a, b = (forecast.forecast_ahead(f, 2, forecast.SCENARIOS) for f in (fits, flipped))
    pairs = a.join(b.select(*KEYS, "week", "fc_ind", F.col("mu").alias("mu2")), [*KEYS, "week", "fc_ind"])
    moved = pairs.withColumn("gap", F.round(F.abs(F.col("mu") - F.col("mu2")), 9)).groupBy("week").agg(F.max("gap").alias("g")).orderBy("week").collect()
    assert moved[0].g > 0 and moved[1].g == 0
    fits.unpersist()


def test_imputation_keeps_observed_values(spark):
    full = planted.ar1_promo(20)
    gappy = load(spark, planted.punch_gaps(full))
    filled = panel.fill_gaps(gappy)
    out = impute.impute(filled).toPandas()
    assert len(out) == 20 * 156 and out.units.notna().all()
    both = out.merge(full, on=["week", "store_id", "upc_id"], suffixes=("", "_true"))
    seen = both.merge(gappy.select("week", *KEYS).toPandas().assign(seen=1), how="left").seen.notna()
    assert np.allclose(both.units[seen], both.units_true[seen])
    error = np.abs(np.sqrt(both.units[~seen]) - np.sqrt(both.units_true[~seen]))
    assert error.mean() < 0.75


def test_bridge_is_the_expected_value_of_an_autoregression(spark):
    """Against the conditional mean of the joint normal distribution."""
    phi, n = 0.7, 9
    cov = phi ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    known = [1, 6]
    values = np.array([2.0, -3.0])
    weights = cov[:, known] @ np.linalg.inv(cov[np.ix_(known, known)])
    want = weights @ values
    rows = [(0, None, 2.0, None, 1.0)] + [(t, 2.0, -3.0, t - 1.0, 6.0 - t) for t in range(2, 6)] + [(t, -3.0, None, t - 6.0, None) for t in (7, 8)]
    df = spark.createDataFrame(rows, "t int, before double, after double, back double, ahead double")
    at = gaps.bridge(*(F.col(c) for c in ("before", "after", "back", "ahead")), F.lit(phi))
    got = {r.t: r.v for r in df.select("t", at.alias("v")).collect()}
    assert all(got[t] == pytest.approx(want[t]) for t in got)
    line = gaps.bridge(*(F.col(c) for c in ("before", "after", "back", "ahead")), F.lit(1.0))
    got = {r.t: r.v for r in df.select("t", line.alias("v")).collect()}
    assert got[0] == 2 and got[8] == -3 and got[2] == pytest.approx(1.0)


def test_gaps_are_filled_from_both_sides(spark):
    units = {"walk": [1.0, 4.0, None, 16.0, None, None], "lead": [None, 9.0, 9.0, 9.0, None, 9.0], "none": [None] * 6}
    rows = [(planted.weeks(6)[i], "1", k, v) for k, vs in units.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "week date, store_id string, upc_id string, units double").repartition(4)
    got = impute.impute(df).orderBy("week").toPandas().groupby("upc_id").units.apply(list)
    assert got["walk"] == pytest.approx([1, 4, 9, 16, 16, 16])  # too few pairs: straight, then carried
    assert got["lead"] == pytest.approx([9] * 6) and np.isnan(got["none"]).all()


def test_sums_of_products_add_up():
    rng = np.random.default_rng(6)
    y, x, known = rng.normal(size=40), rng.normal(size=(40, 2)), rng.random(40) < 0.8
    early = np.arange(40) < 25
    whole = moments.products(y, known, x)
    assert np.allclose(whole, moments.products(y, known & early, x) + moments.products(y, known & ~early, x))
    assert whole[0, 0] == known[moments.FIRST :].sum()


@pytest.mark.parametrize("p,d", moments.ORDERS)
def test_regressions_read_off_the_sums_equal_least_squares(p, d):
    """Both steps of each order by lstsq on the written-out design."""
    rng = np.random.default_rng(p + 3 * d)
    n, k = 120, 3
    x = rng.normal(size=(n, k))
    noise = np.zeros(n)
    for t in range(2, n):
        noise[t] = 0.5 * noise[t - 1] - 0.2 * noise[t - 2] + rng.normal(0, 0.4)
    y = 3 + x @ np.array([1.0, -2.0, 0.5]) + (noise.cumsum() if d else noise)
    known = rng.random(n) < 0.9
    known[:2] = False
    got = moments.fit(moments.products(y, known, x)[None], k, [0, 2], [True, True, False], p, d)
    at = np.array([t for t in range(moments.FIRST, n) if known[t]])

    def back(v, lag):
        w = v if not d else np.concatenate([np.zeros_like(v[:1]), np.diff(v, axis=0)])
        return w[at - lag]

    phi = np.zeros(0)
    if p:
        design = [back(y, i)[:, None] for i in range(1, p + 1)] + [back(x[:, [0, 2]], 0)] + [back(x[:, [0]], i) for i in range(1, p + 1)]
        if not d:
            design.insert(0, np.ones((len(at), 1)))
        phi = np.linalg.lstsq(np.hstack(design), back(y, 0), rcond=None)[0][1 - d : 1 - d + p]
    taps = np.r_[1.0, -phi]
    response = sum(c * back(y, i) for i, c in enumerate(taps))
    design = sum(c * back(x[:, [0, 2]], i) for i, c in enumerate(taps))
    if not d:
        design = np.hstack([np.full((len(at), 1), taps.sum()), design])
    coef, rss, *_ = np.linalg.lstsq(design, response, rcond=None)
    assert got["beta"][0] == pytest.approx([coef[1 - d], 0, coef[2 - d]])
    assert got["const"][0] == pytest.approx(0 if d else coef[0])
    assert got["phi"][0][:p] == pytest.approx(phi)
    params = 2 + 1 + p + 1  # effects, constant or first level, autoregression, variance
    m = len(at)
    assert got["sigma2"][0] == pytest.approx(rss[0] / (m - 2 - (1 - d) - p))
    assert got["aicc"][0] == pytest.approx(m * (np.log(2 * np.pi * rss[0] / m) + 1) + 2 * params + 2 * params * (params + 1) / (m - params - 1))


def test_dead_regressors_are_dropped():
    x = np.ones((60, 3))
    x[:, 1] = np.random.default_rng(0).normal(size=60)
    x[:, 2] = 2 * x[:, 1]
    y = 5 + x[:, 1] * 0.5 + np.random.default_rng(1).normal(0, 0.1, 60)
    got = moments.fit(moments.products(y, np.ones(60, bool), x)[None], 3, [0, 1, 2], [True] * 3, 1, 0)
    assert got["beta"][0][0] == 0 and got["beta"][0][2] == 0 and got["beta"][0][1] == pytest.approx(0.5, abs=0.1)


def test_complete_series_bypass_the_model(spark, promo):
    assert impute.incomplete_series(promo).count() == 0


def test_fallback_and_dropped_series(spark):
    promo = planted.ar1_promo(3, n=60)
    short = promo[promo.upc_id == "U000"].head(9).assign(upc_id="short")
    # Enough weeks for a plain model, too few for six regressors.
    medium = promo[promo.upc_id == "U000"].head(11).assign(upc_id="medium")
    empty = promo[promo.upc_id == "U000"].head(30).assign(upc_id="empty", units=np.nan)
    flat = promo[promo.upc_id == "U000"].head(40).assign(upc_id="flat", units=9.0)
    single = promo[promo.upc_id == "U000"].head(1).assign(upc_id="single")
    df = load(spark, pd.concat([promo, short, medium, empty, flat, single])).withColumn(
        "units", F.nanvl("units", F.lit(None).cast("double"))
    )
    fits = fit.train_models(df, tasks=2).toPandas().set_index(["upc_id", "model"])
    assert fits.loc[("U000", "arima"), "status"] == "ok"
    assert fits.loc[("medium", "arima"), "status"] == "ok"
    assert all(b == 0 for b in fits.loc[("medium", "arima"), "beta"])
    assert fits.loc[("empty", "arima"), "status"] == "not fitted"
    assert ("empty", "stl") not in fits.index
    assert fits.loc[("single", "arima"), "status"] == "not fitted"
    assert fits.loc[("flat", "arima"), "sigma2"] == pytest.approx(0, abs=1e-9)
    assert fits.loc[("flat", "arima"), ["p", "d", "q"]].tolist() == [0, 0, 0]
    assert fits.loc[("U001", "stl"), "status"] == "ok"


@pytest.mark.parametrize("tasks", [1, 4, 16])
def test_task_count_does_not_change_fits(spark, tasks):
    df = load(spark, planted.punch_gaps(planted.ar1_promo(12, n=80)))
    a = fit.train_models(panel.fill_gaps(df), tasks=tasks).toPandas()
    b = fit.train_models(panel.fill_gaps(df.repartition(5)), tasks=3).toPandas()
    a, b = (t.sort_values(["upc_id", "model"]).reset_index(drop=True) for t in (a, b))
    assert len(a) == 24
    assert np.allclose(a.sigma2, b.sigma2) and np.allclose(a.aicc, b.aicc)
    assert all(np.allclose(x, y, equal_nan=True) for x, y in zip(a.filled, b.filled, strict=True))


def test_residuals_match_units(promo, promo_fits):
    res = fit.residuals(promo_fits)
    assert res.count() == 60 * 156 * 2
    assert res.where("abs(units - fitted - resid) > 1e-9").count() == 0
    joined = res.where("model = 'stl'").join(promo.select("week", *KEYS, F.col("units").alias("u")), ["week", *KEYS])
    assert joined.where("units <> u").count() == 0 and joined.count() == 60 * 156


def test_states_that_take_new_weeks_equal_full_fits(spark):
    """Gaps on both sides of the seam, a series that starts later, and two additions one after the other."""
    table = planted.punch_gaps(planted.ar1_promo(8, n=90, lag_effect=-0.4), 0.15)
    late = table[table.upc_id == "U003"].assign(upc_id="late")
    df = load(spark, pd.concat([table, late[late.week >= planted.weeks(60)[59]]]))
    models = {"arima": fit.ModelSpec(uses=fit.PROMOTION)}
    whole = fit.fit_models(panel.fill_gaps(df), models, fit.PROMOTION).toPandas().set_index("upc_id")
    turns = [F.lit(planted.weeks(90)[i]) for i in (40, 70)]
    parts = [df.where(F.col("week") < turns[0]), df.where((F.col("week") >= turns[0]) & (F.col("week") < turns[1])), df.where(F.col("week") >= turns[1])]
    state = increment.fit_state(panel.fill_gaps(parts[0]))
    for part in parts[1:]:
        state = increment.extend_state(state, part)
    fits = increment.fits_of_state(state, models)
    got = fits.toPandas().set_index("upc_id")
    assert set(got.index) == set(whole.index) and len(got) == 9
    for upc in whole.index:
        a, b = whole.loc[upc], got.loc[upc]
        assert (a.status, a.p, a.d, a.n_obs) == ("ok", b.p, b.d, b.n_obs)
        assert [a.const, a.sigma2, a.aicc, a.level, *a.beta, *a.phi, *a.n_tail, *a.x_last] == pytest.approx([b.const, b.sigma2, b.aicc, b.level, *b.beta, *b.phi, *b.n_tail, *b.x_last])
    ahead = [forecast.forecast_scenarios(f.where("status = 'ok'")) for f in (fits, fit.fit_models(panel.fill_gaps(df), models, fit.PROMOTION))]
    a, b = (sorted(map(tuple, x.select("upc_id", "fc_ind", "week", F.round("p_units", 6)).collect())) for x in ahead)
    assert a == b and len(a) == 9 * 10
    with pytest.raises(Exception, match="not later"):
        increment.extend_state(state, parts[1]).collect()


def test_states_read_their_panel_once(spark, tmp_path, monkeypatch):
    from contract import queries

    table = planted.punch_gaps(planted.ar1_promo(6, n=90), 0.15)
    turn = pd.Timestamp("1997-12-29").date() - planted.weeks(90)[50]
    table = table.assign(week=[w + turn for w in table.week])
    short, keyless = (table[table.upc_id == "U001"].head(n).assign(upc_id=x) for n, x in ((2, "short"), (30, None)))
    load(spark, pd.concat([table, short, keyless])).write.parquet(f"{tmp_path}/panel")
    df = spark.read.parquet(f"{tmp_path}/panel")

    def reads(*frames):
        leaves = [x._jdf.queryExecution().optimizedPlan().collectLeaves() for x in frames]
        return sum(x.apply(i).nodeName() == "LogicalRelation" for x in leaves for i in range(x.size()))

    full = panel.fill_gaps(df)
    state = increment.fit_state(full)
    assert reads(state) == 1  # three times before: sums, counts and tails by themselves
    got = {r.upc_id: r for r in state.collect()}
    assert set(got) == {*table.upc_id, "short"}
    rows = full.where("upc_id is not null").orderBy("week").collect()
    for upc, r in got.items():
        own = [(x.week, x.units, x.feature, x.display, x.tpr_only) for x in rows if x.upc_id == upc]
        assert [(t.week, t.units, t.feature, t.display, t.tpr_only) for t in r.tail] == own[-4:]
        assert r.n_obs == sum(x[1] is not None for x in own)

    cuts, real = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda x: cuts.append(x) or real(x))
    monkeypatch.setattr(queries, "filled", lambda spark, sf: panel.filter_series(df.where("upc_id is not null")))
    fits = queries.q_fit_incremental(spark, "")
    assert reads(*cuts, fits) == 1
    whole = queries.q_fit_arima(spark, "")
    assert sorted(map(tuple, fits.collect())) == sorted(map(tuple, whole.collect())) and fits.count() == 6
