"""The batch plans end to end, from landing names to leaderboards."""

import pytest
from pyspark.sql import functions as F

import planted
from panelcast.plans import batch, dashboard, prepare, training
from panelcast.sources.fits import read_fits
from panelcast.spec import FLAGS


@pytest.fixture(scope="module")
def landed(spark):
    """A planted panel under its landing names, two products per store and category."""
    table = planted.punch_gaps(planted.ar1_promo(14, n=130), 0.05)
    df = spark.createDataFrame(table)
    transactions = df.select(
        F.date_add(F.col("week").cast("date"), 6).alias("WEEK_END_DATE"),
        F.col("store_id").cast("bigint").alias("STORE_NUM"),
        F.substring("upc_id", 2, 3).cast("bigint").alias("UPC"),
        F.col("units").alias("UNITS"),
        *[F.col(f).alias(f.upper()) for f in FLAGS],
    )
    products = spark.createDataFrame(
        [(i, "SNACKS" if i < 7 else "ORAL", f"{i + 1} OZ") for i in range(14)],
        "UPC bigint, CATEGORY string, PRODUCT_SIZE string",
    )
    store = spark.createDataFrame(
        [(i, "TX", "VALUE") for i in range(7)] + [(3, "TX", "UPSCALE")],
        "STORE_ID bigint, STATE string, SEG_VALUE_NAME string",
    )
    return store, products, transactions


@pytest.fixture(scope="module")
def out(spark, landed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out"))
    batch.train(spark, *landed, path)
    return path


def half(spark, out, name, split):
    return prepare.read_split(spark, out, name, split)


def test_clean_tables(spark, out):
    store = spark.read.parquet(f"{out}/store.parquet")
    assert store.count() == 7
    assert store.where("seg_value_name = 'MAINSTREAM_UPSCALE'").first().store_id == "3"
    tx = spark.read.parquet(f"{out}/transactions.parquet")
    assert tx.columns[0] == "week" and dict(tx.dtypes)["upc_id"] == "string"


def test_model_inputs(spark, out):
    sample = half(spark, out, "sample", "train").unionByName(half(spark, out, "sample", "val"))
    assert sample.select("store_id", "upc_id").distinct().count() == 14
    assert sample.where("units is null").count() == 0
    train, test = (half(spark, out, "panel", s) for s in ("train", "test"))
    assert train.count() == 14 * 126 and test.count() == 14 * 4
    assert spark.read.parquet(f"{out}/panel.parquet").count() == 14 * 130
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_stored_panels_and_fits_are_joined_in_place(spark, out):
    panel = prepare.read_model_table(spark, out, "panel")
    fits = read_fits(spark, f"{out}/fit_train.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        forecasts = training.holdout_forecast(fits, half(spark, out, "panel", "test"))
        plan = forecasts._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert forecasts.count() == 14 * 4 * 2 and panel.count() == 14 * 130
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_training_and_forecasts(spark, out):
    holdout = spark.read.parquet(f"{out}/fc_train.parquet")
    scenarios = spark.read.parquet(f"{out}/fc_arima.parquet")
    seasonal = spark.read.parquet(f"{out}/fc_stl.parquet")
    assert (holdout.count(), scenarios.count(), seasonal.count()) == (14 * 4 * 2, 14 * 2 * 5, 14 * 2)
    for table in (holdout, scenarios, seasonal):
        assert table.where("p_units is null or low95 is null").count() == 0
    final = prepare.read_model_table(spark, out, "panel")
    wide = dashboard.holdout_rmse(final, holdout)
    assert wide.columns == ["store_id", "upc_id", "ARIMA", "STL"] and wide.count() == 14
    view = dashboard.scenario_view(final, scenarios, seasonal, display=1)
    assert view.groupBy("line").count().count() == 3
    only = dashboard.scenario_view(final, scenarios, seasonal, feature=1, tpr_only=1)
    assert {(r.line, r.reason is None) for r in only.select("line", "reason").distinct().collect()} == {("HISTORY", False)}
    assert only.count() == final.count()
    assert dashboard.scenario_reason(1, 0, 1) and dashboard.scenario_reason(1, 1, 0) is None
    residuals = spark.read.parquet(f"{out}/residuals.parquet")
    assert dashboard.residual_acf(residuals).count() == 14 * 2 * 55
    assert dashboard.residual_histogram(residuals).agg(F.countDistinct("model")).first()[0] == 2
    # White innovations: the first autocorrelation of the ARIMA residuals is small.
    first = dashboard.residual_acf(residuals).where("model = 'arima' and lag = 1")
    assert abs(first.agg(F.avg("acf")).first()[0]) < 0.1


def test_validation(spark, landed, tmp_path):
    by_aicc, by_rmse = batch.validate(spark, *landed, str(tmp_path))
    assert by_aicc.agg(F.sum("n_best_model")).first()[0] == 14
    board = by_rmse.collect()
    assert sum(r.n_best_model for r in board) == 14
    assert board[0].best_model == "arima_lagged"


def test_measure_choices(spark, out):
    final = prepare.read_model_table(spark, out, "panel")
    assert dashboard.measure_choices(final.drop("split")) == ["units", *FLAGS]
    one = dashboard.series(final, "1", "1")
    assert one.count() == 130
