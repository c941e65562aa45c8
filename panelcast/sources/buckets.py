"""Panels stored so that later steps need no exchange, and so that one series is one folder.

A panel is written as an external table bucketed by the series keys. Spark knows that layout: windows,
groupings and joins by series on tables with equally many buckets run without moving a row. Each bucket lies in a
folder of its own, named by the same hash of the keys, so a lookup of one series opens one folder.

The layout is written beside the table (`<path>_layout`), so any session opens it by its path alone.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.spec import WEEKLY, PanelSpec, fit_tasks

BUCKET = "series_bucket"


def bucket_of(keys: list[Column], buckets: int) -> Column:
    """The bucket of a series: the hash by which Spark deals rows to buckets."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def table_name(path: str) -> str:
    """A name for the table at `path`, the same in every session."""
    return f"panel_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def buckets_for(rows: int, per_bucket: int = 2_000_000, least: int = 1) -> int:
    """Buckets of about `per_bucket` rows each."""
    return max(least, -(-rows // per_bucket))


def write_bucketed(
    df: DataFrame,
    path: str,
    spec: PanelSpec = WEEKLY,
    buckets: int | None = None,
    split_by: str | None = None,
    order: tuple[str, ...] | None = None,
) -> DataFrame:
    """Write a table bucketed by series, sorted inside (by `order`, else by week), and return it as stored.

    One exchange, by series; tables that are to be joined without another one take equally many
    buckets (by default as many as the session's tasks). With `split_by`, each of its few values has
    folders of its own within a bucket. An existing table at `path` is replaced.
    """
    spark = df.sparkSession
    n = buckets or fit_tasks(spark)
    keys = [F.col(k) for k in spec.keys]
    parts = [BUCKET, split_by] if split_by else [BUCKET]
    inside = [*spec.keys, *((spec.index,) if order is None else order)]
    placed = df.withColumn(BUCKET, bucket_of(keys, n)).repartition(n, *spec.keys)
    name = table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (
        placed.sortWithinPartitions(*parts, *inside)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .partitionBy(*parts)
        .bucketBy(n, *spec.keys)
        .sortBy(*inside)
        .saveAsTable(name)
    )
    layout = {"schema": df.schema.json(), "keys": spec.key_list, "order": inside, "buckets": n, "parts": parts}
    one = spark.createDataFrame([(json.dumps(layout),)], "layout string")
    one.coalesce(1).write.mode("overwrite").text(f"{path}_layout")
    return open_bucketed(spark, path)


def layout_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}_layout").first()[0])


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The table at `path` with its bucket column, registered in this session if it isn't yet."""
    layout, name = layout_of(spark, path), table_name(path)
    if not spark.catalog.tableExists(name):
        fields = T.StructType.fromJson(json.loads(layout["schema"])).fields
        body = [f for f in fields if f.name not in layout["parts"]]
        tail = [next((f for f in fields if f.name == p), T.StructField(p, T.IntegerType())) for p in layout["parts"]]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body + tail)
        parts, keys = (", ".join(f"`{c}`" for c in layout[k]) for k in ("parts", "keys"))
        order = ", ".join(f"`{c}`" for c in layout["order"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({parts})"
            f" CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name), layout


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The whole panel in the column order it was written with; its partitioning by series holds."""
    df, layout = _stored(spark, path)
    return df.select(*T.StructType.fromJson(json.loads(layout["schema"])).fieldNames())


def one_series(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """Rows of one series: the scan opens the folder of its bucket and prunes inside by the keys."""
    df, layout = _stored(spark, path)
    if len(key) != len(layout["keys"]):
        raise ValueError(f"a series is named by {layout['keys']}")
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [F.lit(v).cast(types[c]) for c, v in zip(layout["keys"], key, strict=True)]
    bucket = spark.range(1).select(bucket_of(values, layout["buckets"])).first()[0]
    rows = df.where(F.col(BUCKET) == bucket)
    for c, v in zip(layout["keys"], values, strict=True):
        rows = rows.where(F.col(c) == v)
    return rows.select(*T.StructType.fromJson(json.loads(layout["schema"])).fieldNames())
