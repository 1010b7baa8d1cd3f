"""Records for training a value model: which have vectors, which pairs join them, which theorems are shown."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors_of(states: DataFrame, cache: DataFrame) -> DataFrame:
    """state_pp, embedding of the different texts; null where the cache has none."""
    return states.select("state_pp").distinct().join(cache.select("state_pp", "embedding"), "state_pp", "left")


def with_vectors(records: DataFrame, cache: DataFrame) -> DataFrame:
    """The records whose state the cache holds."""
    return records.join(cache.select("state_pp").distinct(), "state_pp", "left_semi").select(*records.columns)


def vector_counts(records: DataFrame, cache: DataFrame, by: str) -> DataFrame:
    """By split: records before, kept and dropped for want of a vector."""
    known = cache.select(F.col("state_pp").alias("s")).distinct().withColumn("known", F.lit(1))
    rows = records.join(known, F.col("state_pp") == F.col("s"), "left")
    return rows.groupBy(by).agg(F.count("*").alias("before"), F.count("known").alias("kept"), (F.count("*") - F.count("known")).alias("dropped"))


def merged_pairs(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """theorem_name, state_pp, label of the records, and as positives the pairs (theorem, state) of theorems that occur in them."""
    names = records.select(F.col("theorem_name").alias("theorem")).distinct()
    more = pairs.join(names, "theorem", "left_semi").select(F.col("theorem").alias("theorem_name"), F.col("state").alias("state_pp"), F.lit("positive").alias("label"))
    return records.select("theorem_name", "state_pp", "label").unionByName(more)


def first_theorems(traj: DataFrame, n: int, *order: str) -> DataFrame:
    """The rows of the first ``n`` theorems by their least ``order`` (the name by default), ties by name.

    ``n`` names are broadcast, whatever the table.
    """
    least = [F.min(c).alias(f"o{k}") for k, c in enumerate(order)]
    names = traj.groupBy("theorem_name").agg(*(least or [F.lit(0).alias("o0")])).orderBy(*[f"o{k}" for k in range(max(1, len(order)))], "theorem_name").limit(n)
    return traj.join(F.broadcast(names.select(F.col("theorem_name").alias("first_"))), F.col("theorem_name").eqNullSafe(F.col("first_")), "left_semi")
