"""Incremental collection on streams of trajectory files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import scans


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """New trajectory files as they land, each read once (files written by this library, ids signed)."""
    return spark.readStream.schema(schemas.TRAJECTORY).parquet(folder)


def remaining_time(done: DataFrame, left: int, window: int = 200) -> DataFrame:
    """By completion (id, ts_ms): seconds that ``left`` more take at the pace of the last ``window``; null for the first."""
    rows = scans.moving(done.select("id", "ts_ms"), window, {"n_": lambda w: F.count("*").over(w), "first_": lambda w: F.first("ts_ms").over(w)}, ["ts_ms", "id"])
    return rows.select("id", F.when(F.col("n_") > 1, (F.col("ts_ms") - F.col("first_")) / 1000 / (F.col("n_") - 1) * left).alias("eta_secs"))
