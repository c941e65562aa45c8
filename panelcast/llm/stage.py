"""Small helpers of the operators: tables between steps, values bound once, text columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"


def keep(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and go on from there.

    The folder is `spark.checkpoint.dir`; where that is unset, it is `checkpoints` in the warehouse,
    which executors share too. A lost executor takes nothing of the table with it.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column, blank: str = BLANK) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), blank), "")


def row_key(*cols: Column) -> Column:
    """One long for the row's content; rows with equal content share it."""
    return F.xxhash64(*cols)
