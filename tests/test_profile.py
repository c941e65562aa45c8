import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import rows, sizes
from panelcast.operators import clean, profile, rollup, score
from panelcast.operators.quantiles import exact_quantiles, ordered_long


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_equal_a_sort(spark, parts):
    rng = random.Random(5)
    # A third of all rows is one value of one group; others are ties, tiny, huge, negative.
    data = [("hot", 3.25)] * 400
    data += [("hot", rng.choice([-1e300, -2.5, 0.0, 1e-310, 1e-20, 2.0, 2.0000000000000004, 1e9])) for _ in range(300)]
    data += [("cold", rng.gauss(1000, 1e-9)) for _ in range(301)]
    data += [("one", 7.0), ("cold", None), ("cold", float("nan")), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(parts)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["v"], probs, ["g"]).collect()}
    for g in ("hot", "cold", "one", None):
        values = [v for k, v in data if k == g and v is not None and not math.isnan(v)]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)
    assert len(got) == 20


def test_ordered_long_never_reverses(spark):
    values = [0.0, 5e-324, 1e-300, 1.0, math.nextafter(2.0, 0), 2.0, math.nextafter(2.0, 3)]
    values += [math.nextafter(2.0**29, 0), 2.0**29, math.nextafter(2.0**29, 1e99), 1e308, math.inf]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.k for r in df.orderBy("x").select(ordered_long(F.col("x")).alias("k")).collect()]
    assert got == sorted(got)


def test_strict_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    flags = df.select((F.col("v") > 2).alias("outlier_v"))
    assert profile.outlier_counts(flags).first()[0] == 1
    assert profile.outlier_counts(flags, strict_nulls=True).first()[0] is None


def test_approximate_fences_are_close(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    exact = profile.outlier_fences(df, ["v"]).first()
    approx = profile.outlier_fences(df, ["v"], approx=True).first()
    assert exact.v_lo == -12500 and approx.v_lo == pytest.approx(-12500, abs=10)


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 9.9), ("b", 1.0), ("b", 1.0), ("b", None)], "g string, v double")
    got = {(r.g, r.bin): r.n for r in profile.histogram(df, "v", ["g"]).collect()}
    assert got == {("a", 1): 1, ("a", 50): 2, ("b", 1): 2}
    assert profile.histogram(df, "v").agg(F.sum("n")).first()[0] == 5


def test_row_functions(spark):
    df = spark.createDataFrame([(2.0, 2.0, 5.0), (None, 3.0, 1.0), (None, None, None)], "a double, b double, c double")
    got = [tuple(r) for r in df.select(rows.row_mean(["a", "b", "c"]), rows.row_argmin(["a", "b", "c"])).collect()]
    assert got == [(3.0, "a"), (2.0, "c"), (None, None)]


def test_leaderboard_ties_and_unscored_series(spark):
    wide = spark.createDataFrame(
        [("1", 2.0, 2.0), ("2", 4.0, 1.0), ("3", None, 3.0), ("4", None, None)], "id string, a double, b double"
    )
    got = {r.best_model: (r.median_rmse, r.n_best_model) for r in score.rmse_leaderboard(wide, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1), "b": (2.75, 2), None: (None, 1)}


def test_sizes(spark):
    df = spark.createDataFrame([("2 LT",), ("500 ML",), ("16 OZ",), ("10 CT",), ("3 KG",), ("x OZ",), (None,)], "s string")
    s = F.col("s")
    got = [tuple(r) for r in df.select(sizes.volume_ml(s), sizes.mass_oz(s), sizes.size_is_count(s)).collect()]
    assert got[:3] == [(2000.0, None, False), (500.0, None, False), (None, 16.0, False)]
    assert got[3][1] == pytest.approx(10 * 0.2 / 28.349523125) and got[3][2]
    assert got[4:] == [(None, None, False)] * 3
    off = clean.convert_sizes(df.select(F.lit(1).alias("upc_id"), s.alias("product_size")), count_as_mass=False)
    assert off.where("mass_oz is not null").count() == 1


def test_merged_stores_keep_distinct_rows(spark):
    df = spark.createDataFrame(
        [(1, "A", "VALUE"), (1, "A", "UPSCALE"), (2, "B", "VALUE"), (2, "B", "VALUE"), (3, "C", "VALUE"), (1, "Z", "VALUE")],
        "store_id bigint, city string, seg_value_name string",
    )
    got = sorted(tuple(r) for r in clean.merge_repeated_stores(df).collect())
    m = "MAINSTREAM_UPSCALE"
    assert got == [("1", "A", m), ("1", "Z", m), ("2", "B", m), ("3", "C", "VALUE")]


def test_no_visits_gives_null(spark):
    df = spark.createDataFrame([("w", "c", 3.0, 0, 1, 0, 0)], "week string, category string, units double, visits bigint, feature int, display int, tpr_only int")
    got = {r.col: r.value for r in rollup.promotion_long(df).collect()}
    assert got == {"units_visits": None, "feature": 1.0, "display": 0.0, "tpr_only": 0.0}


def test_acf_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=60).cumsum()
    rows_ = [("s", i, float(v)) for i, v in enumerate(x)] + [("short", 0, 1.0), ("flat", 0, 2.0), ("flat", 1, 2.0)]
    df = spark.createDataFrame(rows_, "k string, week int, v double").repartition(5)
    got = {(r.k, r.lag): r.acf for r in score.acf(df, "v", ["k"], lag_max=10).collect()}
    z = x - x.mean()
    for k in range(1, 11):
        assert got["s", k] == pytest.approx((z[k:] * z[:-k]).sum() / (z**2).sum())
    assert got["flat", 1] is None and len(got) == 11


def test_histogram_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "g string, x double")
    rows = profile.histogram(df, "x", ["g"], 2).collect()
    assert sum(r.n for r in rows) == 4
    assert {(r.g, r.bin, r.bin_end) for r in rows if r.g is None} == {(None, 1, 7.0), (None, 2, 9.0)}


def test_histogram_of_many_and_of_hot_groups(spark):
    """Against numpy, with one group that holds most rows, values that share cells, and one-valued groups."""
    rng = np.random.default_rng(4)
    groups = {f"g{i}": rng.normal(5, 2, 40) for i in range(200)}
    groups["hot"] = np.round(1000 + rng.random(20_000), 6)  # a few cells of the sketch
    groups["flat"], groups["signs"] = np.full(9, 3.0), np.array([-1.5, 0.0, -0.0, 2.5, 1e-300])
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(r.g, r.bin): r.n for r in profile.histogram(df, "v", ["g"], 20).collect()}
    want = {}
    for g, values in groups.items():
        lo, hi = values.min(), values.max()
        for v in values:
            b = 1 if hi == lo else min(int(np.floor((v - lo) / ((hi - lo) / 20))) + 1, 20)
            want[g, b] = want.get((g, b), 0) + 1
    assert got == want


def test_merged_leaderboards_equal_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", *(None if rng.random() < 0.1 else round(float(v), 3) for v in rng.random(2))) for i in range(300)]
    wide = spark.createDataFrame(rows, "id string, a double, b double").repartition(4)
    parts = [score.leaderboard_state(wide.where(f"abs(hash(id)) % 3 = {k}"), ["a", "b"]) for k in range(3)]
    merged = score.merge_leaderboards(parts)
    whole = score.rmse_leaderboard(wide, ["a", "b"])
    got, want = (sorted(map(tuple, x.collect()), key=str) for x in (score.leaderboard(merged), whole))
    assert [r[::2] for r in got] == [r[::2] for r in want]
    assert all(a[1] == pytest.approx(b[1], abs=1e-4) for a, b in zip(got, want, strict=True) if b[1] is not None)
    again = score.merge_leaderboards([merged, score.leaderboard_state(wide.where("false"), ["a", "b"])])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, merged.collect()), key=str)
