"""Results kept in hash buckets of theorem_name, so that resuming shuffles only what is asked about.

A store is a table of the catalog, partitioned by attempt and bucketed and sorted by theorem. What is done is
found by a join that reads the buckets as they lie: of the two sides only the new names are dealt out. Each try at a
batch is an attempt with rows of its own, and a log beside the table names the attempt that finished a batch; rows of
other attempts don't count, and a batch that is in the log isn't written again.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "theorem_name"


def create(spark: SparkSession, store: str, like: DataFrame, buckets: int = 64) -> None:
    """An empty store for rows such as ``like``, and its log; nothing happens where there is one."""
    if not spark.catalog.tableExists(store):
        empty = spark.createDataFrame([], like.schema).withColumn("attempt", F.lit(""))
        empty.write.partitionBy("attempt").bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(store)
    if not spark.catalog.tableExists(f"{store}_log"):
        spark.createDataFrame([], "batch long, attempt string, theorems long, n_rows long").write.saveAsTable(f"{store}_log")


def finished(spark: SparkSession, store: str) -> DataFrame:
    """batch, attempt, theorems, n_rows of the batches that were written to the end."""
    return spark.table(f"{store}_log")


def rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows of finished batches."""
    known = [r.attempt for r in finished(spark, store).select("attempt").distinct().collect()]  # a name for each batch
    return spark.table(store).filter(F.col("attempt").isin(known)).drop("attempt")


def unfinished(names: DataFrame, store: str) -> DataFrame:
    """``names`` (theorem_name and more) that no finished batch holds; null names are never done."""
    return names.join(rows(names.sparkSession, store).select(KEY).hint("merge"), KEY, "left_anti")


def add(batch: DataFrame, store: str, number: int) -> None:
    """Write the rows of theorems that no batch has finished, and log the batch; nothing happens if it was logged before."""
    spark = batch.sparkSession
    if finished(spark, store).filter(F.col("batch") == number).limit(1).count():
        return
    attempt = f"{number}-{uuid.uuid4().hex}"
    own = unfinished(batch, store).withColumn("attempt", F.lit(attempt))
    own.select(*spark.table(store).columns).write.insertInto(store)
    spark.catalog.refreshTable(store)
    written = spark.table(store).filter(F.col("attempt") == attempt)
    written.agg(F.lit(number).cast("long").alias("batch"), F.lit(attempt).alias("attempt"), F.count_distinct(KEY).alias("theorems"), F.count("*").alias("n_rows")).write.insertInto(f"{store}_log")


def collect(stream: DataFrame, store: str, checkpoint: str, buckets: int = 64):
    """Adds each batch of a stream, skipping theorems that earlier batches finished."""
    create(stream.sparkSession, store, stream, buckets)
    return stream.writeStream.foreachBatch(lambda batch, number: add(batch, store, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
