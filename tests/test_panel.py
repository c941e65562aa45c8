import datetime as dt
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast.operators import clean, features, impute, panel, sampling
from panelcast.sources import derive
import planted
from planted import MONDAY, weeks

SCHEMA = "week date, store_id string, upc_id string, units double"


def make(spark, series):
    """{upc: [(week number, units), ...]} as a panel."""
    rows = [
        (MONDAY + dt.timedelta(days=7 * w), "1", upc, None if u is None else float(u))
        for upc, points in series.items()
        for w, u in points
    ]
    return spark.createDataFrame(rows, SCHEMA)


def units(df):
    return {(r.upc_id, (r.week - MONDAY).days // 7): r.units for r in df.collect()}


@pytest.mark.parametrize(
    ("sf", "rows", "filled", "short"),
    [("sf0.001", 5484, 41964, 4), ("sf0.01", 32050, 44501, 0)],
)
def test_golden_counts(spark, sf, rows, filled, short):
    tx = derive.transactions(spark, f"/root/testdata/{sf}").cache()
    assert tx.count() == rows
    assert panel.fill_gaps(tx).count() == filled
    per = tx.groupBy("store_id", "upc_id").count()
    assert per.where("count <= 12").count() == short
    assert panel.key_duplicates(tx).count() == 0
    tx.unpersist()


def test_golden_sums(spark, small):
    tx = derive.transactions(spark, small)
    got = tx.agg(F.sum("units"), F.round(F.sum("spend"), 2)).first()
    assert got[0] == 1524135 and got[1] == 3183256271.63


def test_golden_stores(spark, small):
    store = derive.store(spark, small)
    merged = clean.merge_repeated_stores(store)
    assert (store.count(), merged.count()) == (115, 100)


def test_fill_gaps_keeps_values_and_adds_only_nulls(spark):
    df = make(spark, {"A": [(0, 5), (1, None), (4, 7)], "B": [(2, 1)], "C": [(0, 1), (2, 3)]})
    assert units(panel.fill_gaps(df)) == {
        ("A", 0): 5, ("A", 1): None, ("A", 2): None, ("A", 3): None, ("A", 4): 7,
        ("B", 2): 1, ("C", 0): 1, ("C", 1): None, ("C", 2): 3,
    }


def test_declare_panel_fails_on_a_repeated_row(spark):
    df = make(spark, {"A": [(0, 5), (1, 6), (1, 7)]})
    assert panel.key_duplicates(df).count() == 1
    with pytest.raises(PySparkException, match="repeated row in panel"):
        panel.declare_panel(df).collect()
    good = make(spark, {"A": [(0, 5), (1, 6)]})
    assert panel.declare_panel(good).columns[0] == "week"
    assert panel.declare_panel(good).count() == 2


def test_twelve_observations_are_too_few(spark):
    df = make(spark, {"A": [(2 * i, 1) for i in range(12)], "B": [(2 * i, 1) for i in range(13)]})
    kept = panel.filter_series(df)
    assert {r.upc_id for r in kept.collect()} == {"B"}
    assert kept.count() == 25


def test_missing_ratio_counts_filled_rows(spark):
    df = make(spark, {"A": [(0, 1), (3, 1)], "B": [(0, 1)]})
    got = {r.upc_id: (r.n_na, r.missingness) for r in panel.missing_ratio(panel.count_missing(df)).collect()}
    assert got == {"A": (2, 0.5), "B": (0, 0.0)}


def test_calendar_split_clamps_month_ends(spark):
    # The last Monday is 31 August 2009; July has 31 days, but from 31 March February has not.
    rows = [(dt.date(2008, 3, 31) - dt.timedelta(days=7 * i), "1", "A", 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    train, val = panel.calendar_split(df)
    assert train.count() + val.count() == 12
    # 31 March - 1 month = 29 February 2008, whose week starts on the 25th.
    assert train.agg(F.max("week")).first()[0] == dt.date(2008, 2, 25)
    assert val.count() == 5


def test_holdout_halves_are_disjoint_and_complete(spark):
    df = panel.fill_gaps(make(spark, {"A": [(i, i) for i in range(10)], "B": [(0, 1), (9, 2)], "C": [(0, 1)]}))
    train, test = panel.holdout_split(df)
    both = panel.full_panel(train, test)
    assert both.count() == 20  # C is too short to hold anything out
    assert train.join(test, ["week", "store_id", "upc_id"]).count() == 0
    joined = panel.holdout_from_join(train, df)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, test.collect()), key=str)


def test_carry_forward_leaves_leading_nulls(spark):
    df = make(spark, {"A": [(0, None), (1, 4), (2, None), (3, None), (4, 2)]})
    got = units(impute.carry_forward(df))
    assert [got["A", i] for i in range(5)] == [None, 4, 4, 4, 2]


def test_lag_reads_the_filled_week(spark):
    df = make(spark, {"A": [(0, 1), (2, 3)]}).withColumn("feature", F.lit(1))
    out = features.lag_features(features.fill_flags(panel.fill_gaps(df), ["feature"]), ["feature"])
    got = {(r.week - MONDAY).days // 7: (r.feature, r.lag_feature) for r in out.collect()}
    assert got == {0: (1, None), 1: (0, 1), 2: (1, 0)}


def test_scenarios_multiply_future_rows(spark):
    future = panel.future_rows(make(spark, {"A": [(0, 1)], "B": [(3, 1)]}), 2)
    grid = features.add_scenarios(future)
    assert grid.count() == 2 * 2 * 5
    assert grid.where("tpr_only = 1 and (feature = 1 or display = 1)").count() == 0
    assert {r.week for r in future.where("upc_id = 'B'").collect()} == set(weeks(6)[4:])


def test_sample_is_one_series_per_cell_and_repeats(spark, small):
    ratio = panel.missing_ratio_by_span(derive.transactions(spark, small))
    products = derive.products(spark, small)
    first = sampling.sample_series(ratio, products)
    again = sampling.sample_series(ratio.repartition(3), products.repartition(2))
    rows = sorted(map(tuple, first.collect()))
    assert len(rows) == 12 and rows == sorted(map(tuple, again.collect()))
    assert len({(r[0], r[2]) for r in rows}) == 12
    other = sampling.sample_series(ratio, products, seed=7)
    assert sorted(map(tuple, other.collect())) != rows


def test_relocate(spark):
    df = make(spark, {"A": [(0, 1)]})
    assert panel.relocate(df, ["units"]).columns == ["units", "week", "store_id", "upc_id"]
    assert panel.relocate(df, ["units"], after="store_id").columns == [
        "week", "store_id", "units", "upc_id",
    ]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitioning_does_not_change_the_panel(spark, tiny, parts):
    tx = derive.transactions(spark, tiny)
    base = panel.label_holdout_split(panel.filter_series(tx))
    other = panel.label_holdout_split(panel.filter_series(tx.repartition(parts)))
    assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


def test_rows_without_a_week_are_refused(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "1", "a", 1.0), (None, "1", "a", 2.0)],
        "week date, store_id string, upc_id string, units double",
    )
    for refuse in (panel.declare_panel, panel.fill_gaps):
        with pytest.raises(Exception, match="week|index"):
            refuse(df).collect()


def test_longer_holdouts_are_scored_to_their_end(spark):
    from panelcast.operators import fit, score
    from panelcast.plans import training

    df = spark.createDataFrame(planted.ar1_promo(6, n=80))
    train, test = panel.holdout_split(df, 8)
    out = training.holdout_forecast(fit.train_models(train), test)
    assert out.count() == 6 * 8 * 2 and out.where("p_units is null").count() == 0
    assert score.with_actuals(out, df).where("units is not null").count() == 6 * 8 * 2


def test_fits_do_not_depend_on_neighbours_or_tasks(spark):
    """Series of several lengths, with gaps, give the same fits in any number of tasks."""
    import pandas as pd

    from panelcast.operators import fit

    parts = []
    for n in (30, 41, 60, 150):
        part = planted.punch_gaps(planted.ar1_promo(5, n=n), 0.05)
        part["upc_id"] = part["upc_id"] + f"_{n}"
        parts.append(part)
    df = panel.fill_gaps(spark.createDataFrame(pd.concat(parts)))
    got = []
    for tasks in (1, 4, 16):
        rows = fit.train_models(df, tasks=tasks).select("store_id", "upc_id", "model", "p", "d", "q", "sigma2").collect()
        got.append({(r[0], r[1], r[2]): (r[3], r[4], r[5], r[6] and round(r[6], 9)) for r in rows})
    assert got[0] == got[1] == got[2] and len(got[0]) == 40


def test_forecasts_refuse_other_regressors_and_kinds(spark):
    from pyspark.sql import functions as F

    from panelcast.operators import fit, forecast
    from panelcast.spec import FLAGS

    df = spark.createDataFrame(planted.ar1_promo(3, n=60))
    fits = fit.train_models(df)
    with pytest.raises(Exception, match="other regressors"):
        forecast.forecast_next(fits.where("model = 'arima'"), 2, FLAGS).collect()
    with pytest.raises(Exception, match="no forecast of kind"):
        forecast.forecast_next(fits.withColumn("kind", F.lit("odd"))).collect()
    renamed = fits.where("model = 'stl'").withColumn("model", F.lit("decomp"))
    assert forecast.forecast_next(renamed).where("p_units is null").count() == 0


def test_lagged_flags_go_by_week(spark):
    """A hole in the future rows: the flag before it isn't last week's."""
    from pyspark.sql import functions as F

    from panelcast.operators import fit, forecast

    df = spark.createDataFrame(planted.ar1_promo(1, n=120, lag_effect=-0.5))
    fits = fit.train_models(df).where("model = 'arima'")
    future = panel.future_rows(df, 4).withColumns({"feature": F.lit(1), "display": F.lit(0), "tpr_only": F.lit(0)})
    whole = {r.week: r.mu for r in forecast.forecast(fits, future).collect()}
    part = {r.week: r.mu for r in forecast.forecast(fits, future.where("h <> 3")).collect()}
    weeks = sorted(whole)
    beta = fits.first().beta
    assert part[weeks[1]] == pytest.approx(whole[weeks[1]])
    assert part[weeks[3]] == pytest.approx(whole[weeks[3]] - beta[3])


def test_tasks_of_the_order_join_follow_the_lines(spark, tmp_path):
    lines = spark.range(4000).select(
        F.expr("id div 4").alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(10.5).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.lit("1997-03-05 00:00:00").cast("timestamp_ntz").alias("l_shipdate"),
    )
    rows = {
        "lineitem": lines.repartition(8),
        "orders": spark.range(1000).selectExpr("id as o_orderkey", "if(id % 10 = 0, null, id % 7) as o_custkey"),
        "supplier": spark.sql("select 1L as s_suppkey, 3 as s_nationkey"),
        "nation": spark.sql("select 3 as n_nationkey, 'X' as n_name, 2 as n_regionkey"),
        "part": spark.range(3).selectExpr("id as p_partkey", "concat('Brand#', id % 2) as p_brand"),
    }
    for name, df in rows.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    settings = {"spark.sql.shuffle.partitions": "2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = derive.sale_lines(spark, str(tmp_path))
        assert joined.count() == 4000
        most = joined.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
        got = {(r.store_id, r.upc_id): (r.units, r.visits, r.hhs) for r in derive.transactions(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most <= 400  # two tasks would hold 2,000 lines each
    # An order has lines of both products; customers are 0 to 6 and none.
    assert got == {("2", "Brand#0"): (2 * 2667.0, 1000, 8), ("2", "Brand#1"): (2 * 1333.0, 1000, 8)}


def test_grouping_to_customers_follows_the_lines(spark, tmp_path):
    lines = spark.range(800).selectExpr(
        "id div 2 as l_orderkey", "id % 2 as l_partkey", "if(id % 5 = 4, 9L, 1L) as l_suppkey", "1 as l_linenumber",
        "1D as l_quantity", "2.5D as l_extendedprice", "0D as l_discount", "0D as l_tax", "'N' as l_returnflag",
        "'O' as l_linestatus", "timestamp_ntz'1997-03-05 00:00:00' as l_shipdate",
    )
    rows = {
        "lineitem": lines.repartition(8),
        "orders": spark.range(400).selectExpr("id as o_orderkey", "if(id < 200, null, id div 2) as o_custkey"),
        "supplier": spark.sql("select 1L as s_suppkey, 3 as s_nationkey union all select 9L, null"),
        "nation": spark.sql("select 3 as n_nationkey, 'X' as n_name, 2 as n_regionkey"),
        "part": spark.range(2).selectExpr("id as p_partkey", "concat('Brand#', id) as p_brand"),
    }
    for name, df in rows.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    weekly = derive.transactions(spark, str(tmp_path))
    plan = weekly._jdf.queryExecution().executedPlan().toString()
    tasks = re.findall(r"Exchange hashpartitioning\(store_id#\d+, upc_id#\d+, week#\d+, o_custkey#\d+L, (\d+)\)", plan)
    assert tasks == ["128"]  # 16 for each of 8 files, with any number of shuffle partitions
    assert "hashpartitioning(l_suppkey" not in plan  # lines are not sorted for a few suppliers
    got = {r.upc_id: (r.units, r.visits, r.hhs) for r in weekly.collect()}
    left = [(i // 2, i % 2) for i in range(800) if i % 5 != 4]  # a supplier without a nation has no store
    for part in (0, 1):
        orders = [o for o, p in left if p == part]
        assert got[f"Brand#{part}"] == (len(orders), len(orders), len({o // 2 if o >= 200 else None for o in orders}))
