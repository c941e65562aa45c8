"""Per-series models as one Spark job.

A series becomes one row of arrays in a single shuffle. Regressions with autoregressive errors are read off the
sums of products of a series (`functions/moments.py`): one additive matrix per series serves every model and
order, and the order is chosen by AICc. Everything else is column expressions on the row: residuals, the state
that forecasting starts from, smoothing. The fit table keeps all that forecasting needs, so history is read once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import decompose, moments
from panelcast.functions.intervals import square_bound
from panelcast.operators.features import fill_flags, fourier_features, lag_features
from panelcast.operators.gaps import with_interpolated
from panelcast.operators.smooth import one_step_ahead, with_best_form
from panelcast.spec import FLAGS, WEEKLY, PanelSpec, deal_series

LAGS = tuple(f"lag_{f}" for f in FLAGS)
FOURIER = tuple(f"{t}{i}" for i in range(1, 7) for t in ("s", "c"))
# Regressors of the training models, and of the validation models.
PROMOTION = FLAGS + LAGS
SEASONAL = PROMOTION + FOURIER


@dataclass(frozen=True)
class ModelSpec:
    """`kind` is arima or stl; `uses` are its regressors; `d` is fixed or chosen when None."""

    kind: str = "arima"
    uses: tuple[str, ...] = ()
    d: int | None = None


# The compared models and their regressors (fixed values).
VALIDATION_MODELS = {
    "arima_base": ModelSpec(uses=FLAGS),
    "arima_lagged": ModelSpec(uses=PROMOTION),
    "arima_seasonal": ModelSpec(uses=FLAGS + FOURIER),
    "arima_seasonal_lagged": ModelSpec(uses=PROMOTION + FOURIER, d=0),
    "stl": ModelSpec(kind="stl"),
}
PLAIN = {"arima": ModelSpec()}
TRAINING_FALLBACK = (ModelSpec(uses=PROMOTION), ModelSpec())

# Bytes that the matrices of a block of series may take in a Python worker.
BLOCK_BYTES = 32 * 2**20
# Filled roots that come with the rows of an earlier state.
STORED_ROOT = "stored_root"
# Lengths of series whose decomposition a worker keeps at a time.
KEPT_LENGTHS = 8

FIT_COLUMNS = (
    "model string, kind string, design array<string>, status string, n_obs int, p int, d int, q int, const double,"
    " beta array<double>, phi array<double>, theta array<double>, n_tail array<double>,"
    " e_tail array<double>, level double, x_last array<double>, alpha double, slope_gain double,"
    " damping double, slope double, season array<double>, sigma2 double, aicc double,"
    " first_week date, last_week date, units array<double>, fitted array<double>,"
    " innov array<double>, filled array<double>"
)


def design_matrix(
    panel: DataFrame, design: Sequence[str] = PROMOTION, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """Filled panel with every regressor in `design` as a column."""
    out = fill_flags(panel) if any(c in PROMOTION for c in design) else panel
    if any(c in LAGS for c in design):
        out = lag_features(out, FLAGS, spec)
    if any(c in FOURIER for c in design):
        out = fourier_features(out, 6, spec=spec)
    return out


def series_rows(
    panel: DataFrame,
    design: Sequence[str] = PROMOTION,
    spec: PanelSpec = WEEKLY,
    tasks: int | None = None,
    along: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per series: first and last week; units, their filled roots `z` and regressors `x` over time;
    and the aggregates `along` of its rows, which come with a `filled_root`.

    The panel is unique per week, so an array is as long as the calendar at most.
    Windows and arrays share one exchange by key. The finished rows are then dealt
    out by length: fits cost time per series and week, far more than moving the row.
    """
    featured = with_interpolated(design_matrix(panel, design, spec), spec=spec, straight=True)
    if STORED_ROOT in panel.columns:  # rows of an earlier state keep what they were filled with
        featured = featured.withColumn("filled_root", F.coalesce(STORED_ROOT, "filled_root"))
    point = F.struct(
        F.col(spec.index).alias("t"),
        F.col("units").cast("double").alias("y"),
        F.col("filled_root").alias("z"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in design]).alias("x")
        if design
        else F.array().cast("array<double>").alias("x"),
    )
    rows = (
        featured.groupBy(*spec.keys)
        .agg(F.array_sort(F.collect_list(point)).alias("s"), *[c.alias(n) for n, c in (along or {}).items()])
        .select(
            *spec.keys,
            *(along or {}),
            F.element_at("s", 1)["t"].alias("first_week"),
            F.element_at("s", -1)["t"].alias("last_week"),
            F.transform("s", lambda p: p["y"]).alias("units"),
            F.transform("s", lambda p: p["z"]).alias("z"),
            F.flatten(F.transform("s", lambda p: p["x"])).alias("x"),
        )
    )
    return deal_series(rows, tasks, F.size("z"), spec.keys)


def series_moments(rows: DataFrame, regressors: int) -> DataFrame:
    """Add `moments`, the sums of products of each series, to `series_rows`; see `functions/moments.py`."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sums(units: pd.Series, z: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([_products(*r, regressors).ravel() for r in zip(units, z, x, strict=True)])

    return rows.withColumn("moments", sums("units", "z", "x"))


def _products(units, z, x, regressors: int) -> np.ndarray:
    """The matrix of one row of `series_rows`."""
    filled = np.asarray(z, float)
    known = ~np.isnan(np.asarray(units, float)) & ~np.isnan(filled)
    return moments.products(np.nan_to_num(filled), known, np.asarray(x, float).reshape(len(filled), regressors))


def merge_moments(left: Column, right: Column) -> Column:
    """Sums of products over the steps of both; a NULL side has no steps."""
    both = F.zip_with(left, right, lambda a, b: a + b)
    return F.coalesce(both, left, right)


def candidate_orders(option: ModelSpec) -> list[tuple[int, int]]:
    return [(p, d) for p, d in moments.ORDERS if option.d is None or d == option.d]


CANDIDATE = "array<struct<aicc:double,at:int,p:int,d:int,const:double,beta:array<double>,phi:array<double>,sigma2:double>>"


def with_candidates(rows: DataFrame, options: Sequence[ModelSpec], design: Sequence[str]) -> DataFrame:
    """Add `candidates`: every order of every option, read off the sums of products of the series.

    An order that can't be fitted has no aicc. The sums come with the rows (`moments`), else they are
    made from the series and stay in the task. The matrices of a block of series are stacked; each
    is reduced by itself, so neither neighbours nor tasks matter.
    """
    columns, k = list(design), len(design)
    lagged = [c not in FOURIER for c in columns]
    cases = [([columns.index(c) for c in o.uses], p, d) for o in options for p, d in candidate_orders(o)]
    size = moments.width(k)
    block = max(1, BLOCK_BYTES // (8 * size * size * 4))

    def fitted(m: np.ndarray) -> pa.Array:
        n, count = len(m), len(cases)
        results = [moments.fit(m, k, uses, lagged, p, d) for uses, p, d in cases]

        def numbers(name: str) -> pa.Array:
            return pa.array(np.stack([r[name] for r in results], 1).ravel(), from_pandas=True)

        def lists(name: str) -> pa.Array:
            values = np.stack([r[name] for r in results], 1)
            offsets = np.arange(n * count + 1) * values.shape[2]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()))

        def constant(values) -> pa.Array:
            return pa.array(np.tile(np.array(values, "int32"), n))

        fields = [numbers("aicc"), constant(range(count)), constant([c[1] for c in cases]), constant([c[2] for c in cases]), numbers("const"), lists("beta"), lists("phi"), numbers("sigma2")]
        flat = pa.StructArray.from_arrays(fields, ["aicc", "at", "p", "d", "const", "beta", "phi", "sigma2"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "moments"]
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                if "moments" in batch.schema.names:
                    m = part.column("moments").flatten().to_numpy().reshape(part.num_rows, size, size)
                else:
                    series = zip(*(part.column(c).to_pylist() for c in ("units", "z", "x")), strict=True)
                    m = np.stack([_products(*r, k) for r in series])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), fitted(m)], [*rest, "candidates"])

    kept = rows.drop("moments").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return rows.mapInArrow(run, f"{ddl}, candidates {CANDIDATE}")


def fit_models(
    panel: DataFrame,
    models: dict[str, ModelSpec],
    design: Sequence[str] = SEASONAL,
    spec: PanelSpec = WEEKLY,
    tasks: int | None = None,
) -> DataFrame:
    """Every model on every series: one row per (series, model), `status` says how it went."""
    plan = {name: (m,) for name, m in models.items()}
    return _run(panel, plan, design, spec, tasks)


def train_models(
    panel: DataFrame,
    fallback: Sequence[ModelSpec] = TRAINING_FALLBACK,
    design: Sequence[str] = PROMOTION,
    spec: PanelSpec = WEEKLY,
    tasks: int | None = None,
) -> DataFrame:
    """The two training models of every series, from one pass.

    `arima` is the first of `fallback` that can be fitted; `stl` is fitted on the interpolated
    series. A series no regression fits keeps one row whose status says so, has no
    `stl`, and is left out by `fitted_only`.
    """
    plan = {"arima": tuple(fallback), "stl": (ModelSpec("stl"),)}
    return _run(panel, plan, design, spec, tasks, needs="arima")


def fitted_only(fits: DataFrame) -> DataFrame:
    return fits.where(F.col("status") == "ok")


def prefer_model(
    fits: DataFrame, order: Sequence[str], name: str, spec: PanelSpec = WEEKLY
) -> DataFrame:
    """Per series, the first model in `order` that was fitted, renamed; the others go.

    For fit tables that hold the alternatives side by side.
    """
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    rest = [c for c in fits.columns if c not in spec.keys]
    picked = (
        fitted_only(fits)
        .where(F.col("model").isin(list(order)))
        .groupBy(*spec.keys)
        .agg(F.min_by(F.struct(*rest), rank).alias("m"))
    )
    return picked.select(*spec.keys, "m.*").withColumns(
        {"chosen": F.col("model"), "model": F.lit(name)}
    )


def bind_models(
    left: DataFrame, right: DataFrame, spec: PanelSpec = WEEKLY
) -> tuple[DataFrame, DataFrame]:
    """Keep in both tables the series both hold, matched by key."""
    keys = spec.key_list
    return (
        left.join(right.select(*keys), keys, "left_semi"),
        right.join(left.select(*keys), keys, "left_semi"),
    )


def residuals(fits: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Per (series, model, week): units, fitted, residual, and model-scale innovation."""
    step = F.expr(f"interval {spec.step_days} days")
    weeks = F.sequence(F.col("first_week"), F.col("last_week"), step)
    rows = fitted_only(fits).select(
        *spec.keys,
        "model",
        F.explode(
            F.arrays_zip(
                weeks.alias(spec.index), F.col("units"), F.col("fitted"), F.col("innov")
            )
        ).alias("r"),
    )
    fitted = square_bound(F.col("r.fitted"))
    return rows.select(
        *spec.keys,
        "model",
        F.col(f"r.{spec.index}").alias(spec.index),
        F.col("r.units").alias("units"),
        fitted.alias("fitted"),
        (F.col("r.units") - fitted).alias("resid"),
        F.col("r.innov").alias("innov"),
    )


def interpolated(fits: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """Per (series, week): observed units, or the model's value where they are missing."""
    step = F.expr(f"interval {spec.step_days} days")
    weeks = F.sequence(F.col("first_week"), F.col("last_week"), step)
    return (
        fitted_only(fits)
        .select(
            *spec.keys,
            F.explode(
                F.arrays_zip(weeks.alias(spec.index), F.col("units"), F.col("filled"))
            ).alias("r"),
        )
        .select(
            *spec.keys,
            F.col(f"r.{spec.index}").alias(spec.index),
            F.coalesce(F.col("r.units"), square_bound(F.col("r.filled"))).alias("units"),
        )
    )


def information_criteria(fits: DataFrame, spec: PanelSpec = WEEKLY) -> DataFrame:
    """AICc of the ARIMA models, which share a likelihood; NULL where none was fitted."""
    return fits.where(F.col("kind") == "arima").select(*spec.keys, "model", "aicc")


def _run(
    panel: DataFrame,
    plan: dict[str, tuple[ModelSpec, ...]],
    design: Sequence[str],
    spec: PanelSpec,
    tasks: int | None,
    needs: str | None = None,
) -> DataFrame:
    return fits_from(series_rows(panel, design, spec, tasks), plan, design, spec, needs)


def fits_from(
    rows: DataFrame,
    plan: dict[str, tuple[ModelSpec, ...]],
    design: Sequence[str],
    spec: PanelSpec = WEEKLY,
    needs: str | None = None,
    n_obs: Column | None = None,
) -> DataFrame:
    """The fit table from `series_rows`, with or without `moments`: of each name in `plan`, the first option that fits.

    With `needs`, the other models are kept for series that this one fits. `n_obs` counts the observed weeks,
    where the rows don't hold them all.
    """
    regressions = {n: o for n, o in plan.items() if o[0].kind == "arima"}
    options = [o for many in regressions.values() for o in many]
    smoothed = len(regressions) < len(plan)
    if options:
        rows = with_candidates(rows, options, design)
    fits, at = [], 0
    for name, many in plan.items():
        chosen = F.lit(None)
        if name in regressions:
            counts = [len(candidate_orders(o)) for o in many]
            chosen = _first_of(F.slice("candidates", at + 1, sum(counts)), counts)
            at += sum(counts)
        fits.append(F.struct(F.lit(name).alias("model"), F.lit(many[0].kind).alias("kind"), chosen.cast(CANDIDATE[6:-1]).alias("c")))
    if smoothed:
        rows = _with_smoothing(rows)
    each = rows.withColumn("_all", F.array(*fits))
    lead = F.lit(True) if needs is None else F.exists("_all", lambda m: (m["model"] == needs) & m["c"].isNotNull())
    each = each.withColumns({"_m": F.explode_outer("_all"), "_lead": lead}).select("*", "_m.*")
    return _fit_table(each.where((F.col("model") == needs) | F.col("_lead")) if needs else each, design, spec, smoothed, n_obs)


def _first_of(candidates: Column, counts: Sequence[int]) -> Column:
    """Of candidates in groups of `counts`, the one with the least AICc in the first group that has any."""
    best, at = [], 1
    for count in counts:
        best.append(F.array_min(F.filter(F.slice(candidates, at, count), lambda c: c["aicc"].isNotNull())))
        at += count
    return F.coalesce(*best)


@lru_cache(KEPT_LENGTHS)
def _seasonal_matrix(n: int) -> np.ndarray:
    return decompose.stl_matrices(n)[1]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _seasonal(z: pd.Series) -> pd.Series:
    """Seasonal part of each filled series; NULL where a value is missing."""

    def one(v):
        v = np.asarray(v, float)
        return None if np.isnan(v).any() else _seasonal_matrix(len(v)) @ v

    return z.map(one)


def _with_smoothing(rows: DataFrame) -> DataFrame:
    """Add the seasonal part, and the best smoothing of the rest, to `series_rows`."""
    parted = rows.withColumn("seasonal", _seasonal("z"))
    rest = F.zip_with("z", "seasonal", lambda v, s: v - s)
    return with_best_form(parted.withColumn("rest", rest), "rest", "smooth")


def _fit_table(
    each: DataFrame, design: Sequence[str], spec: PanelSpec, smoothed: bool, n_obs: Column | None = None
) -> DataFrame:
    """The rows of the fit table from the chosen candidate or smoothing of every series and model."""
    k = len(design)
    regression = F.col("kind") == "arima"
    if smoothed:
        expected = one_step_ahead("rest", F.col("smooth.alpha"), F.col("smooth.slope_gain"), F.col("smooth.damping"))
        own = (F.col("kind") == "stl") & F.col("smooth").isNotNull()
        each = each.withColumn("_ahead", F.when(own, F.zip_with(expected, "seasonal", lambda a, s: a + s)))
    else:
        own = F.lit(False)
        empty = "struct<aicc:double,alpha:double,slope_gain:double,damping:double,params:double,level:double,slope:double,sse:double>"
        each = each.withColumns({"smooth": F.lit(None).cast(empty), "seasonal": F.lit(None).cast("array<double>"), "_ahead": F.lit(None).cast("array<double>")})
    done = (regression & F.col("c").isNotNull()) | own
    n = F.size("z")

    def effect(i: Column) -> Column:
        here = F.slice("x", i * k + 1, k)
        return F.aggregate(F.zip_with(here, F.col("c.beta"), lambda v, b: v * b), F.lit(0.0), lambda a, v: a + v)

    noise = F.transform("z", lambda v, i: v - F.col("c.const") - effect(i)) if k else F.transform("z", lambda v: v - F.col("c.const"))
    each = each.withColumn("_noise", F.when(regression & done, noise))
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice("_noise", F.lit(1), F.greatest(n - 1, F.lit(0))))
    moved = F.when(F.col("c.d") == 1, F.zip_with("_noise", before, lambda a, b: a - b)).otherwise(F.col("_noise"))
    each = each.withColumn("_w", moved)

    def innovation(v: Column, i: Column) -> Column:
        past = [F.get("_w", i - lag) for lag in (1, 2)]
        weights = [F.get("c.phi", F.lit(lag)) for lag in (0, 1)]
        seen = F.get("units", i).isNotNull() & (i >= moments.FIRST)
        return F.when(seen, v - weights[0] * past[0] - weights[1] * past[1])

    innov = F.when(regression, F.transform("_w", innovation)).otherwise(F.zip_with("z", "_ahead", lambda v, a: v - a))
    each = each.withColumn("_innov", F.when(done, innov))
    doubles = "array<double>"
    seen = F.size(F.filter("units", lambda v: v.isNotNull())) if n_obs is None else n_obs
    used = (n - 1).cast("double")
    period = decompose.PERIOD
    values = {
        "status": F.when(done, "ok").otherwise("not fitted"),
        "design": F.array(*[F.lit(c) for c in design]).cast("array<string>"),
        "n_obs": F.when(done, F.when(regression, seen).otherwise(n)),
        "p": F.col("c.p"),
        "d": F.col("c.d"),
        "q": F.when(F.col("c.p").isNotNull(), F.lit(0)),
        "const": F.col("c.const"),
        "beta": F.col("c.beta"),
        "phi": F.col("c.phi"),
        "theta": F.when(F.col("c.p").isNotNull(), F.array(F.lit(0.0), F.lit(0.0))),
        "n_tail": F.when(F.col("_w").isNotNull(), F.array(F.get("_w", n - 1), F.get("_w", n - 2))),
        "e_tail": F.when(F.col("_w").isNotNull(), F.array(F.lit(0.0), F.lit(0.0))),
        "level": F.when(regression, F.when(F.col("c.d") == 1, F.get("_noise", n - 1)).when(F.col("c.d") == 0, 0.0)).when(own, F.col("smooth.level")),
        "x_last": F.when(regression & done, F.slice("x", (n - 1) * k + 1, k) if k else F.array().cast(doubles)),
        "alpha": F.when(own, F.col("smooth.alpha")),
        "slope_gain": F.when(own, F.col("smooth.slope_gain")),
        "damping": F.when(own, F.col("smooth.damping")),
        "slope": F.when(own, F.col("smooth.slope")),
        "season": F.when(own & (n >= 2 * period), F.slice("seasonal", n - period + 1, period)),
        "sigma2": F.when(regression, F.col("c.sigma2")).when(own, F.col("smooth.sse") / F.greatest(used - F.col("smooth.params") + 1, F.lit(1.0))),
        "aicc": F.when(regression, F.col("c.aicc")).when(own, F.col("smooth.aicc")),
        "fitted": F.when(done, F.transform("z", lambda v, i: v - F.get("_innov", i))),
        "innov": F.col("_innov"),
        "filled": F.when(done, F.col("z")),
    }
    types = dict(c.rsplit(" ", 1) for c in FIT_COLUMNS.split(", "))
    columns = [values.get(c, F.col(c)).cast(t).alias(c) for c, t in types.items()]
    return each.select(*spec.keys, *columns)
