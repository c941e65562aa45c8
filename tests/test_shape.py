"""The physical plans keep their promises: few exchanges, pushed filters, no wide scans."""

import re

import pytest
from pyspark.sql import functions as F

from panelcast.operators import fit, forecast, impute, panel, profile, rollup, sampling, score
from panelcast.plans.explore import explore
from panelcast.sources import buckets, derive, fits, schemas, tables
from panelcast.sources.checkpoints import cut
from panelcast.spec import deal_series


@pytest.fixture(scope="module")
def tx(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shape"))
    tables.write_table(derive.transactions(spark, small), path)
    return tables.read_parquet(spark, path, schemas.TRANSACTIONS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single|shuffle)", plan(df), re.IGNORECASE))


def test_a_panel_chain_shuffles_once(tx):
    labelled = panel.label_holdout_split(panel.filter_series(tx))
    assert exchanges(labelled) == 1
    featured = fit.design_matrix(panel.drop_last_rows(panel.filter_series(tx), 4), fit.SEASONAL)
    assert exchanges(featured) == 1


@pytest.fixture(scope="module")
def stored(spark, tx, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "panel")
    return path, buckets.write_bucketed(tx, path, buckets=6)


def test_a_stored_panel_needs_no_exchange(stored, tx):
    """Gap filling, splits, lags, counts and joins by series start from the layout on disk."""
    _, back = stored
    assert back.columns == tx.columns and back.exceptAll(tx).count() == 0 and back.count() == tx.count()
    filled = panel.filter_series(back)
    for df in (panel.label_holdout_split(filled), panel.missing_ratio_by_span(back), impute.impute(filled)):
        assert exchanges(df) == 0
    assert exchanges(fit.design_matrix(panel.drop_last_rows(filled, 4), fit.SEASONAL)) == 0
    counts = panel.missing_ratio_by_span(back)
    assert exchanges(back.hint("merge").join(counts, ["store_id", "upc_id"])) == 0


def test_one_series_opens_one_folder(spark, stored, tx):
    path, _ = stored
    one = buckets.one_series(spark, path, "1", "Brand#7")
    assert one.count() == tx.where("store_id = '1' and upc_id = 'Brand#7'").count() > 0
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) <= 6
    text = one._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({buckets.BUCKET}" in text
    assert "EqualTo(store_id,1)" in text and "EqualTo(upc_id,Brand#7)" in text
    folders = one.select("_metadata.file_path").distinct() if "_metadata" in one.columns else None
    assert folders is None or folders.count() == 1
    assert buckets.one_series(spark, path, "1", "no such product").count() == 0


def test_stored_panels_open_in_another_session(spark, stored, tx):
    path, back = stored
    other = spark.newSession()
    other.sql(f"DROP TABLE IF EXISTS {buckets.table_name(path)}")
    again = buckets.open_bucketed(other, path)
    assert again.schema == back.schema and again.count() == tx.count()
    assert exchanges(panel.fill_gaps(again)) == 0


def test_fit_shuffles_the_panel_once_and_deals_rows(tx):
    train = panel.drop_last_rows(panel.filter_series(tx), 4)
    rows = fit.train_models(train, tasks=5)
    assert exchanges(rows) == 2
    assert len({r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}) == 5


@pytest.mark.parametrize("tasks", [3, 8])
def test_tasks_get_like_sums_of_cost(spark, tasks):
    """Most series short, some long, and the long ones together in the input."""
    rows = spark.range(2000).select("id", F.when(F.col("id") < 150, 156).when(F.col("id") < 700, 60).otherwise(13).alias("n"))
    series = rows.select("id", F.sequence(F.lit(1), "n").alias("z")).repartitionByRange(6, "id")
    dealt = deal_series(series, tasks, F.size("z"), ["id"])
    per_task = dealt.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.size("z")).alias("cost")).toPandas().cost
    assert len(per_task) == tasks and per_task.max() < 1.2 * per_task.mean()
    assert dealt.select("id").distinct().count() == 2000 and dealt.columns == ["id", "z"]


def test_forecast_from_fits_does_not_shuffle(spark, tx, tmp_path):
    one = tx.where("store_id = '1' and upc_id in ('Brand#1', 'Brand#2')")
    fits.write_fits(fit.train_models(panel.fill_gaps(one)), str(tmp_path / "f"))
    back = fits.read_fits(spark, str(tmp_path / "f"))
    fc = forecast.forecast_scenarios(back.where("model = 'arima'"))
    assert exchanges(fc) == 0 and "Join" not in plan(fc)
    assert "innov" not in plan(fc) and fc.count() == 2 * 5 * 2


def test_rollup_has_no_hint_and_reads_few_columns(spark, small, tx):
    text = plan(rollup.category_weekly(tx, derive.products(spark, small)))
    assert "spend" not in text and "hhs" not in text


def test_sampling_fills_only_the_sample(spark, small, tx, tmp_path):
    picked = sampling.sample_series(
        panel.missing_ratio_by_span(tx), derive.products(spark, small)
    )
    rows = sampling.sampled_rows(cut(picked, str(tmp_path)), tx)
    text = plan(rows)
    assert text.index("Generate explode") < text.index("LeftSemi")
    assert rows.select("store_id", "upc_id").distinct().count() == 12


def test_a_hot_product_is_combined_before_it_moves(spark, tx, small):
    """A third of all rows under one product: the roll-up is the same as without salting."""
    hot = tx.union(tx.selectExpr(*[c if c != "upc_id" else "'Brand#7' as upc_id" for c in tx.columns]))
    weekly = rollup.category_weekly(hot, derive.products(spark, small))
    total = weekly.agg({"units": "sum"}).first()[0]
    assert total == 2 * 1524135
    assert plan(weekly).count("partial_sum(units") >= 1


def test_explore_gives_every_table(spark, small, tx):
    out = explore(derive.store(spark, small), derive.products(spark, small), tx)
    assert {"store_text", "products_text", "transactions_numeric", "transactions_date"} <= set(out)
    for name in ("store_numeric", "transactions_numeric", "outliers", "product_overview", "flag_crosstab"):
        assert out[name].count() > 0


def test_profiles_expand_and_join_nothing(tx):
    text = plan(profile.text_summary(tx, ["store_id", "upc_id"]))
    assert "Expand" not in text and exchanges(profile.text_summary(tx, ["store_id", "upc_id"])) == 2
    # The rows that are looked at again meet the cells that an edge cuts, never their whole group.
    joins = [x for x in plan(profile.histogram(tx, "units", ["store_id"])).splitlines() if "Join" in x]
    assert len(joins) == 1 and "_cell" in joins[0]


def test_autocorrelation_folds_once(tx):
    """The fold stands in one projection: in no filter, and not once for every use of its result."""
    text = plan(score.acf(panel.fill_gaps(tx), "units", ["store_id", "upc_id"]))
    assert len(re.findall("Generate inline_outer|Generate inline", text)) == 1
    assert text.count("aggregate(") == 1
    assert not any("aggregate(" in line for line in text.splitlines() if "Filter" in line)


def test_imputation_counts_gaps_on_one_exchange_of_the_panel(tx):
    """The panel is dealt by key for gap filling; counting, modelling and carrying forward need no other."""
    out = impute.impute(panel.filter_series(tx), tasks=5)
    text = plan(out)
    assert "hashpartitioning(store_id" in text and "week#" not in " ".join(re.findall(r"hashpartitioning\([^)]*\)", text))
