"""Mixing sources to target weights by proportional-fair scheduling.

Each source's rows, in a hash order of its own, are cut into blocks. Block k of a source with
weight w is released at slot floor(k / w) and due by slot ceil((k + 1) / w); of the blocks
released, each slot takes the one due first. With weights that sum to one this meets every
deadline, so in any prefix a source is less than one block off its share. The weights are taken as
they are, as integers over a common denominator, and the schedule runs over all blocks: it is
planned on the driver, an entry for each block (not row) whatever the number of sources. Blocks
grow with the table, so that a plan has ``max_blocks`` entries and one more for each source at most.

Rows are numbered within a source without gathering it: hash buckets of about ``bucket_rows`` are
numbered each for itself, and start where the counts of the buckets before end; these are summed up
in two levels, so that a hot source's many buckets meet in no one task either.
"""
from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import ceil, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: buckets whose counts are summed up together
_SPAN = 1024


def _slots(weights: list[int], counts: list[int]):
    """(slot, source, block) of ``counts`` blocks of each source, earliest deadline first; ties go to the earlier source.

    Slots that sources without further blocks leave go to the others as far as their blocks are
    released; slots that then stay free are passed over.
    """
    total = sum(weights)
    waiting = [(0, s, 0) for s in range(len(weights)) if counts[s]]  # by release
    ready: list[tuple[int, int, int]] = []  # by deadline
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k))
        due, s, k = heapq.heappop(ready)
        assert due > slot
        yield slot, s, k
        if k + 1 < counts[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))
        slot += 1


def whole(weights: list[float]) -> list[int]:
    """Integers in exactly the proportions of the weights."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    exact = [Fraction(w) for w in weights]
    scale = lcm(*[x.denominator for x in exact])
    return [int(x * scale) for x in exact]


def _plan(sizes: list[int], weights: list[float], block_rows: int) -> tuple[pa.Table, int]:
    """sid, block2, slot, first (the rows before it) of every block, and the first slot that misses its source."""
    sid, block, slot = array("i"), array("q"), array("q")
    # one block more than the whole ones: what is left of the source, perhaps nothing
    for at, s, k in _slots(whole(weights), [n // block_rows + 1 for n in sizes]):
        sid.append(s)
        block.append(k)
        slot.append(at)
    sid, block, slot = np.array(sid, np.int32), np.array(block, np.int64), np.array(slot, np.int64)
    n = np.minimum(block_rows, np.array(sizes, np.int64)[sid] - block * block_rows)
    horizon = int(slot[n < block_rows].min()) if len(n) else 0
    columns = [x[n > 0] for x in (sid, block, slot, n.cumsum() - n)]
    return pa.table(columns, names=["sid", "block2", "slot", "first"]), horizon


def _slotted(docs, weights, alpha, block_rows, bucket_rows, source, key, carry=None, max_blocks=2**20):
    """row, source, block, idx (the row's place in its block), slot and first (the rows before the block) of every row; the first slot that misses its source."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), docs[source].cast("string").alias("source"), F.xxhash64(docs[key]).alias("h1"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("h2"))
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sizes = dict(sorted(sizes.items(), key=lambda x: (x[0] is not None, x[0] or "")))
    weights = {s: n**alpha for s, n in sizes.items()} if weights is None else {s: weights.get(s, 0) for s in sizes}
    block_rows = max(block_rows, -(-sum(sizes.values()) // max_blocks))
    table, horizon = _plan(list(sizes.values()), list(weights.values()), block_rows)
    slots = spark.createDataFrame(table, "sid int, block2 long, slot long, first long")
    if table.num_rows <= 2**21:  # beyond that the sources are too many, and the join is dealt by source and block
        slots = F.broadcast(slots)
    # as an Arrow table, which needs no workers
    each = pa.table([pa.array(sizes, pa.string()), pa.array(range(len(sizes)), pa.int32()), pa.array([max(1, ceil(n / bucket_rows)) for n in sizes.values()], pa.int32())], names=["s2", "number", "buckets"])
    each = spark.createDataFrame(each, "s2 string, number int, buckets int")
    bucketed = rows.join(F.broadcast(each), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    bucketed = bucketed.withColumn("bucket", F.pmod("h2", "buckets").cast("int"))
    counts = bucketed.groupBy("source", "bucket", "number").agg(F.count("*").alias("n"))
    # what comes before a bucket travels with its rows, as one more row that sorts first
    counts = counts.withColumn("span", F.expr(f"bucket div {_SPAN}"))
    spans = counts.groupBy("source", "span").agg(F.sum("n").alias("all"))
    spans = spans.select(F.col("source").alias("s3"), F.col("span").alias("span3"), (F.sum("all").over(W.partitionBy("source").orderBy("span")) - F.col("all")).alias("upto"))
    heads = counts.withColumn("inner", F.sum("n").over(W.partitionBy("source", "span").orderBy("bucket")) - F.col("n"))
    heads = heads.join(spans, F.col("source").eqNullSafe(F.col("s3")) & (F.col("span") == F.col("span3"))).select("source", "number", "bucket", (F.col("upto") + F.col("inner")).alias("offset"))
    body = bucketed.select("row", "source", "number", "bucket", "h1", "h2", F.lit(None).cast("long").alias("offset"))
    both = body.unionByName(heads, allowMissingColumns=True)
    inside = W.partitionBy("source", "bucket").orderBy(F.col("offset").desc_nulls_last(), "h1", "h2")
    ranked = both.withColumn("rank", F.first("offset").over(inside) + F.row_number().over(inside) - 2).filter("offset is null")
    ranked = ranked.select("row", "source", "number", F.expr(f"rank div {block_rows}").alias("block"), F.expr(f"rank % {block_rows}").alias("idx"))
    laid = ranked.join(slots, (F.col("number") == F.col("sid")) & (F.col("block") == F.col("block2")))
    return laid.select("row", "source", "block", "idx", "slot", "first"), horizon


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, block_rows: int = 64, bucket_rows: int = 1024, source: str = "source", key: str = "doc_id", carry: tuple[str, ...] | None = None, max_blocks: int = 2**20) -> DataFrame:
    """Every row of ``docs`` once, as struct ``row`` of the columns ``carry`` (all by default), with source, block, slot, position, within_target.

    ``weights`` gives each source's target; by default they are the row counts to the power
    ``alpha``. position numbers the rows from 0 in the order of the mixture; a source that has run
    out leaves its slots to the others, which keep their proportions among themselves.
    within_target marks rows before the first slot that misses its source: in that prefix every
    source is less than one block off its target, the exact weight. Any number of sources will do.
    Null sources form a source of their own (key None of ``weights``); repeated rows are placed each; an empty table gives an empty result; every
    source of the table needs a weight above 0 (ValueError). A block has ``block_rows`` rows, or as
    many more as keep the blocks to ``max_blocks``.
    """
    rows, horizon = _slotted(docs, weights, alpha, block_rows, bucket_rows, source, key, carry, max_blocks)
    return rows.select("row", "source", "block", "slot", (F.col("first") + F.col("idx")).alias("position"), (F.col("slot") < horizon).alias("within_target"))


def mixed(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, block_rows: int = 64) -> DataFrame:
    """The rows of ``docs`` with their columns, laid out in the order of the mixture: partition by
    partition, and within each from its first row to its last. Files written from it keep that order.
    Nulls, repeated rows and empty tables as in :func:`mix`."""
    rows = _slotted(docs, weights, alpha, block_rows, 1024, "source", "doc_id")[0]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "slot", "idx").sortWithinPartitions("slot", "idx").select("row.*")


def op1_query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), carry=("doc_id",)).select("row.doc_id", "source", "block", "slot", "position", "within_target")
