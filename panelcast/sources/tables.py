"""Reading and writing tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources.schemas import STAR
from panelcast.spec import WEEKLY, PanelSpec, by_series

# Landing names that the cleaned tables spell differently.
KEY_NAMES = {"upc": "upc_id", "store_num": "store_id"}


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", STAR[name])


def read_landing_csv(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ","
) -> DataFrame:
    """Read a landing file that opens with a title record and a header record.

    Line numbers mean nothing once a file is split, so both records are dropped
    by what they hold: a title fills only the first cell, with text that is no value
    of the first column; a header repeats all column names. Everything else is a
    record and must cast to the schema, or the job fails. A first column of text
    can't tell a title from a record, so its title must be left out of the file.
    """
    names = schema.fieldNames()
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(text).option("sep", sep).csv(path)
    first = schema.fields[0]
    is_title = F.col(first.name).isNotNull() & F.col(first.name).try_cast(first.dataType).isNull()
    for n in names[1:]:
        is_title = is_title & F.col(n).isNull()
    is_header = F.lit(True)
    for n in names:
        cell = F.lower(F.regexp_replace(F.trim(F.col(n)), "[^A-Za-z0-9]+", "_"))
        is_header = is_header & F.coalesce(cell == n, F.lit(False))
    return rows.where(~is_title & ~is_header).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def snake_case(name: str) -> str:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    return f"x{name}" if name[:1].isdigit() or not name else name


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case every column; a repeated name gets _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = snake_case(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def rename_keys(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(KEY_NAMES if names is None else names)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_panel(
    df: DataFrame,
    path: str,
    spec: PanelSpec = WEEKLY,
    tasks: int | None = None,
    split_by: str | None = None,
) -> None:
    """Write clustered by series and sorted inside files, so a lookup of one
    series prunes to a few row groups. With `split_by`, each of its few values has a
    folder of its own."""
    order = [split_by, *spec.row_id] if split_by else spec.row_id
    writer = by_series(df, spec, tasks).sortWithinPartitions(*order).write.mode("overwrite")
    (writer.partitionBy(split_by) if split_by else writer).parquet(path)


def write_decimal_comma_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with decimal commas and NA for NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.translate(c.cast("string"), ".", ",")
        cols.append(c.alias(f.name))
    (
        df.select(*cols)
        .write.mode("overwrite")
        .option("sep", ";")
        .option("header", True)
        .option("nullValue", "NA")
        .csv(path)
    )


def read_decimal_comma_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Inverse of `write_decimal_comma_csv`.

    Doubles arrive as text and the comma is turned back before the cast; the CSV
    reader itself would give NULL for `1,5` under a double schema.
    """
    text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if _is_real(f.dataType) else f.dataType)
            for f in schema.fields
        ]
    )
    df = (
        spark.read.schema(text)
        .option("sep", ";")
        .option("header", True)
        .option("nullValue", "NA")
        .csv(path)
    )
    return df.select(
        *[
            (F.translate(F.col(f.name), ",", ".") if _is_real(f.dataType) else F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def _is_real(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))
