"""Cutting lineage where a costly table is read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute once into a folder that all executors share and go on from there.

    The folder is the session's `spark.checkpoint.dir`, else the caller's; without
    either the call fails, on one machine as on a cluster.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None) or folder
        if place is None:
            raise ValueError("set spark.checkpoint.dir, or name a folder all executors share")
        context.setCheckpointDir(place)
    return df.checkpoint()
