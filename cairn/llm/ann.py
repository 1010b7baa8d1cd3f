"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop.

Vectors are lifted by one coordinate so that largest inner product is least distance, and projected
to ``M`` dimensions with a fixed Gaussian matrix. For two points at distance d their projected
distance, squared and divided by d squared, follows the chi-square law with ``M`` degrees of freedom.
Cells of a kd-tree are taken by projected distance, nearest first; their points are verified with
exact inner products, and the search ends when a point as near as the k-th found would have shown
itself by then with probability ``confidence``.

The tree has two levels. The upper one (``max_cells`` cells at most, from a sample of
``max_sample`` vectors at most) is broadcast and deals all rows into cells, and a cell's rows by
hash into blocks of about ``block_rows``, however many share it. Each block is a kd-tree of its own.
A query first searches one block of its own cell, which bounds its k-th distance, and then visits
every cell that the test doesn't rule out. Queries of a crowded cell are split by hash as well.
"""
from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, table

M = 8
LEAF = 64


def chi_square_quantile(p: float, m: int = M) -> float:
    """Of an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        if 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(m // 2)) < p:
            low = x
        else:
            high = x
    return high


def projection(dim: int, seed: int = 7) -> np.ndarray:
    """From the lifted space to ``M`` dimensions."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dim + 1, M))


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Data: one more coordinate brings every vector to length ``most``."""
    rest = np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1)


def scale(q: np.ndarray, most: float) -> np.ndarray:
    """Queries: scaled to length ``most``, the new coordinate zero."""
    q = q * (most / np.sqrt((q * q).sum(1)))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], 1)


class Tree:
    """A kd-tree whose leaves hold ``leaf`` points or fewer, split at medians of the widest dimension."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.dim, self.cut, self.left, self.right, self.members = [], [], [], [], []
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points, rows, leaf) -> int:
        node = len(self.dim)
        for x in (self.dim, self.cut, self.left, self.right):
            x.append(-1)
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) > leaf and spread.max() > 0:
            d = int(spread.argmax())
            v = points[rows, d]
            cut = np.median(v)
            low = v <= cut
            if low.all():
                low = v < cut
                cut = v[low].max()
            self.dim[node], self.cut[node] = d, float(cut)
            self.left[node] = self._grow(points, rows[low], leaf)
            self.right[node] = self._grow(points, rows[~low], leaf)
        else:
            self.left[node] = len(self.members)
            self.members.append(rows)
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        dim, cut, left, right = map(np.array, (self.dim, self.cut, self.left, self.right))
        at = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(dim[at] >= 0)):
            n = at[inner]
            at[inner] = np.where(points[inner, dim[n]] <= cut[n], left[n], right[n])
        return left[at]


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance from each query to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search_block(ids, x, px, qids, q, pq, bounds, k, most, quantile):
    """The k best of one block for each query, by inner product, ties to the smaller id.

    ``bounds``: a score that the query is known to reach k times elsewhere, or -inf.
    """
    tree = Tree(px, LEAF)
    # points that no split tells apart share a leaf, however many: it is searched in pieces
    pieces = [r[a : a + LEAF] for r in tree.members for a in range(0, len(r), LEAF)]
    order, ends = np.concatenate(pieces), np.cumsum([len(r) for r in pieces])
    x, ids, px = x[order], ids[order], px[order]
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    low, high = (np.array([f(px[a:b], axis=0) for a, b in spans]) for f in (np.min, np.max))
    lengths = np.sqrt((q * q).sum(1))
    slack = 1e-9 * most * lengths  # products of matrices are rounded otherwise than sums
    scores = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), np.iinfo(np.int64).max)
    near = box_distance(pq, low, high)
    rank = near.argsort(1, kind="stable").argsort(1, kind="stable")
    first, last = 0, 1
    while first < len(spans):  # each query's nearest leaf, then three more, and so on
        for leaf, (a, b) in enumerate(spans):
            reach = np.maximum(scores[:, -1], bounds)
            gap = 2 * most * (most - reach / lengths)  # the k-th distance squared
            rows = np.flatnonzero((rank[:, leaf] >= first) & (rank[:, leaf] < last) & ~(near[:, leaf] > quantile * np.maximum(gap, 0)))
            if len(rows):
                rows = rows[(q[rows] @ x[a:b].T).max(1) >= reach[rows] - slack[rows]]
            if not len(rows):
                continue
            s = (q[rows][:, None, :] * x[None, a:b]).sum(-1)
            i = np.broadcast_to(ids[a:b], s.shape)
            own = i == qids[rows][:, None]
            s = np.concatenate([scores[rows], np.where(own, -np.inf, s)], 1)
            i = np.concatenate([found[rows], np.where(own, np.iinfo(np.int64).max, i)], 1)
            best = np.lexsort((i, -s), axis=-1)[:, :k]
            scores[rows], found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        first, last = last, last * 4
    return scores, found


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, np.float64)


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, confidence: float = 0.97, max_cells: int = 1024, max_sample: int = 32_768, cell_rows: int = 4096, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` rows with the largest inner product, by query.

    Queries are the rows whose vec_id is divisible by ``every``; a row is no candidate for queries
    of its own id. Vectors that are null, zero, of another length than most, or that hold null or
    non-finite components take no part, nor do rows without id. Of rows that repeat a query's id
    the one with the smallest vector asks; repeated candidates are found each. With fewer
    candidates than ``k`` all are returned; an empty table gives an empty result; ties go to the
    smaller vec_id; further columns are ignored.
    """
    spark = vectors.sparkSession
    e = F.col("e")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0))
    # halved exponents: squares of the largest and smallest doubles would leave their range
    length = lambda m: m * F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + (v / m) * (v / m)))
    norm = F.transform(F.array(F.array_max(F.transform(e, F.abs))), length)[0]  # the largest component is looked for once a vector
    stats = good.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if stats is None:
        return spark.createDataFrame([], schema)
    dim, n, most = stats
    good = good.filter(F.size("e") == dim)
    matrix, quantile = projection(dim), chi_square_quantile(confidence)
    sample = good.select("vec_id", "e").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toPandas()
    points = lift(_matrix(sample.e), most) @ matrix
    upper = Tree(points, max(LEAF, -(-len(points) // max(1, min(max_cells, n // cell_rows)))))
    shared = spark.sparkContext.broadcast((upper, matrix))

    def assign(batches):
        tree, p = shared.value
        for b in batches:
            x = np.array(b.column(1).flatten(), np.float64).reshape(-1, dim)
            proj = lift(x, most) @ p
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.leaf_of(proj).astype(np.int32)), pa.array(list(proj), pa.list_(pa.float64()))], names=["vec_id", "e", "cell", "p"])

    placed = materialise(good.mapInArrow(assign, "vec_id long, e array<double>, cell int, p array<double>"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[i]).alias(f"{x}{i}") for i in range(M) for f, x in ((F.min, "l"), (F.max, "h"))]).orderBy("cell").toPandas()
    number = cells.cell.to_numpy()
    low, high = cells[[f"l{i}" for i in range(M)]].to_numpy(), cells[[f"h{i}" for i in range(M)]].to_numpy()
    splits = dict(zip(number.tolist(), (-(-cells.n // block_rows)).tolist()))

    def per_cell(values: dict, default: int = 1):
        out = np.full(max([0, *values, *splits]) + 1, default)
        for c, v in values.items():
            out[c] = v
        return F.array(*[F.lit(int(v)) for v in out])[F.col("cell")]

    def searched(data: DataFrame, queries: DataFrame) -> DataFrame:
        """data and queries by (cell, s, t); the k best of each block."""
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            left = left.sort_values("vec_id", kind="stable")
            q = _matrix(right.e)
            scores, found = search_block(left.vec_id.to_numpy(), _matrix(left.e), _matrix(left.p), right.query_id.to_numpy(), q, scale(q, most) @ matrix, right.bound.to_numpy(), k, most, quantile)
            keep = ~np.isneginf(scores)
            return pd.DataFrame({"query_id": np.repeat(right.query_id.to_numpy(), k)[keep.ravel()], "vec_id": found[keep], "score": scores[keep]})

        return data.groupBy("cell", "s", "t").cogroup(queries.groupBy("cell", "s", "t")).applyInPandas(run, "query_id long, vec_id long, score double")

    asking = placed.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("e").alias("e"))

    def home(batches):
        tree, p = shared.value
        for b in batches:
            x = scale(np.array(b.column(1).flatten(), np.float64).reshape(-1, dim), most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.leaf_of(x @ p).astype(np.int32))], names=["query_id", "e", "cell"])

    def dealt(queries: DataFrame, counts: dict) -> tuple[DataFrame, DataFrame]:
        """Each query's and each row's blocks, crowded cells split on both sides."""
        shares = {c: -(-v // query_rows) for c, v in counts.items()}
        t = F.pmod(F.xxhash64("query_id"), per_cell(shares)).cast("int")
        data = placed.filter(per_cell({c: 1 for c in counts}, 0) == 1).withColumn("s", F.pmod(F.xxhash64("vec_id"), per_cell(splits)).cast("int"))
        return data.withColumn("t", F.explode(F.sequence(F.lit(0), per_cell(shares) - 1))), queries.withColumn("t", t)

    first = asking.mapInArrow(home, "query_id long, e array<double>, cell int").filter(per_cell({c: 1 for c in splits}, 0) == 1)
    first = materialise(first.withColumn("s", F.pmod(F.xxhash64("query_id"), per_cell(splits)).cast("int")).withColumn("bound", F.lit(float("-inf"))), "first")
    counts = {r.cell: r["count"] for r in first.groupBy("cell").count().collect()}
    data, queries = dealt(first, counts)
    bounds = searched(data, queries).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound")).filter(F.col("n") == k).select("query_id", "bound")
    bounded = materialise(asking.join(bounds, "query_id", "left").select("query_id", "e", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")), "bounded")
    boxes = spark.sparkContext.broadcast((number, low, high))

    def visits(batches):
        _, p = shared.value
        cell, lo, hi = boxes.value
        for b in batches:
            q = np.array(b.column(1).flatten(), np.float64).reshape(-1, dim)
            for a in range(0, len(q), 1024):
                z = q[a : a + 1024]
                near = box_distance(scale(z, most) @ p, lo, hi)
                gap = 2 * most * (most - np.array(b.column(2))[a : a + 1024] / np.sqrt((z * z).sum(1)))
                i, c = np.nonzero(~(near > quantile * np.maximum(gap, 0)[:, None]))
                yield pa.RecordBatch.from_arrays([*[x.take(pa.array(i + a)) for x in b.columns], pa.array(cell[c].astype(np.int32))], names=["query_id", "e", "bound", "cell"])

    second = bounded.mapInArrow(visits, "query_id long, e array<double>, bound double, cell int")
    counts = {r.cell: r["count"] for r in second.groupBy("cell").count().collect()}
    data, queries = dealt(second.withColumn("s", F.explode(F.sequence(F.lit(0), per_cell(splits) - 1))), counts)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    discard(first)
    best = searched(data, queries).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_query(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"))
