import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcast.operators import fit
from panelcast.sources import checkpoints, derive, fits, schemas, tables
import planted


def test_landing_csv_drops_title_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Products Lookup,,,,,\n"
        "UPC,DESCRIPTION,MANUFACTURER,CATEGORY,SUB_CATEGORY,PRODUCT_SIZE\n"
        '111,"PRETZEL, BIG",ACME,SNACKS,SALTED,15 OZ\n'
        "222,RINSE,ACME,ORAL,,500 ML\n"
    )
    df = tables.read_landing_csv(spark, str(tmp_path / "a.csv"), schemas.RAW_PRODUCTS)
    got = tables.rename_keys(df).collect()
    assert [(r.upc_id, r.description, r.sub_category) for r in got] == [
        (111, "PRETZEL, BIG", "SALTED"),
        (222, "RINSE", None),
    ]


def test_landing_csv_rejects_text_in_a_number(spark, tmp_path):
    (tmp_path / "b.csv").write_text("UPC,DESCRIPTION,MANUFACTURER,CATEGORY,SUB_CATEGORY,PRODUCT_SIZE\nabc,X,Y,Z,W,1 OZ\n")
    df = tables.read_landing_csv(spark, str(tmp_path / "b.csv"), schemas.RAW_PRODUCTS)
    with pytest.raises(PySparkException):
        df.collect()


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["WEEK_END_DATE", "Store Num", "tprOnly", "2x", "store.num"])
    assert tables.clean_names(df).columns == ["week_end_date", "store_num", "tpr_only", "x2x", "store_num_2"]


def test_decimal_comma_round_trip(spark, tmp_path):
    schema = schemas.columns("upc_id string, n int, arima double, stl double")
    df = spark.createDataFrame([("a", 1, 1.5, None), ("b", 2, -1234.25, 1e-7)], schema)
    path = str(tmp_path / "scores")
    tables.write_decimal_comma_csv(df, path)
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert "1,5;NA" in text
    back = tables.read_decimal_comma_csv(spark, path, schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_panel_files_are_clustered_by_series(spark, tmp_path, tiny):
    tx = derive.transactions(spark, tiny)
    path = str(tmp_path / "panel")
    tables.write_panel(tx, path, tasks=4)
    back = tables.read_parquet(spark, path, schemas.TRANSACTIONS)
    assert back.count() == 5484
    named = back.withColumn("file", F.input_file_name())
    files = named.groupBy("store_id", "upc_id").agg(F.count_distinct("file").alias("n"))
    assert files.where("n > 1").count() == 0
    plan = back.where("store_id = '1'").select("week", "units")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(store_id), EqualTo(store_id,1)]" in plan
    assert "ReadSchema: struct<week:date,store_id:string,units:double>" in plan


def test_fit_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame(planted.ar1_promo(3, n=60))
    path = str(tmp_path / "fits")
    fits.write_fits(fit.train_models(df), path)
    back = fits.read_fits(spark, path)
    assert back.count() == 6
    row = back.where("model = 'arima' and upc_id = 'U000'").first()
    assert row.first_week == dt.date(2009, 1, 5) and len(row.units) == 60


def test_cut_keeps_rows(spark):
    df = spark.range(10).repartition(3)
    assert sorted(r.id for r in checkpoints.cut(df).collect()) == list(range(10))


def test_landing_csv_keeps_sparse_records(spark, tmp_path):
    """A title isn't a value of the first column; a record with only its key is."""
    schema = schemas.columns("upc bigint, description string, product_size string")
    (tmp_path / "p.csv").write_text("Products of the chain,,\nUPC,DESCRIPTION,PRODUCT_SIZE\n7,,\n8,UPC,1 OZ\n,x,\n")
    got = tables.read_landing_csv(spark, str(tmp_path / "p.csv"), schema).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, None, None), (8, "UPC", "1 OZ"), (None, "x", None)], key=str)


def test_cut_needs_a_folder(spark, tmp_path):
    from panelcast.sources import checkpoints

    if spark.sparkContext.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            checkpoints.cut(spark.range(3))
    assert checkpoints.cut(spark.range(3), str(tmp_path)).count() == 3
