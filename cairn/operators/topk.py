"""The first rows of each group, as an aggregate that merges: no window, no sort of all rows, no gathered group."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows that a task keeps before it passes on what it has, and tables of rows that one task merges at a time
_KEPT, _MERGED = 200_000, 256


def first_k(rows: DataFrame, by: list[str], order: list[str], k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order`` (nulls first), with their ``place`` from 1.

    Each task keeps the first k rows of the groups it meets, and hands them on when these are many; what is left of a group
    then meets in two steps, so that no task sees more than k rows from each of ``_MERGED`` tasks at once. ``order``
    should tell rows apart; of rows that tie any may be kept.
    """
    narrow = rows.select(*rows.columns)

    def keep(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = held.sort_values(order, na_position="first", kind="stable").groupby(by, dropna=False, sort=False).head(k) if by else held.sort_values(order, na_position="first", kind="stable").head(k)
            if len(held) > _KEPT:
                yield held
                held = None
        if held is not None and len(held):
            yield held

    few = narrow.mapInPandas(keep, narrow.schema).withColumn("from_", F.pmod(F.spark_partition_id(), F.lit(_MERGED)))
    return _merged(_merged(few, [*by, "from_"], order, k, rows.columns, None), by, order, k, rows.columns, place)


def _merged(rows: DataFrame, by: list[str], order: list[str], k: int, columns: list[str], place: str | None) -> DataFrame:
    rest = [c for c in columns if c not in order and c not in by]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    first: Column = F.slice(F.sort_array(F.collect_list(row)), 1, k)
    keys = [c for c in by]
    out = rows.groupBy(*keys).agg(first.alias("rows_")).select(*keys, F.posexplode("rows_").alias("at_", "row_"))
    own = [F.col(c) if c in by else F.col("row_")[c].alias(c) for c in columns]
    extra = [F.col("from_")] if "from_" in by else []
    return out.select(*own, *extra, *([(F.col("at_") + 1).alias(place)] if place else []))
