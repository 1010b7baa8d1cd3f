"""Quality scores from histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from a bounded sample of labelled rows (``max_rows``), flattened
into three arrays of fixed size, and broadcast: at most ``n_trees * 2**(depth + 1)`` numbers.
Scoring is one pass over the documents without a shuffle; a batch's statistics form a matrix that
goes down all levels of a tree by numpy indexing.
"""
from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, fold, passing

SINGLE = b"!?#*$%&|@/<>{}=_~^+.,;:'\"-()[]"
N_STATS = 18 + len(SINGLE)


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; those of an empty text are zero."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / n
    some = share[share > 0]
    words = text.split()
    k = len(words)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x]
    top = [c for _, c in seen.most_common(10)]
    upper = share[65:91].sum()
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(np.log1p(len(lines))),
        float(upper), float(share[97:123].sum()), float(share[48:58].sum()), float(share[128:].sum()),
        float(share[[9, 10, 11, 12, 13, 32]].sum()), float(share[:32].sum()),
        float(-(some * np.log2(some)).sum()),
        (n - counts[[9, 10, 11, 12, 13, 32]].sum()) / max(k, 1),
        len(seen) / max(k, 1), (top[0] if top else 0) / max(k, 1), sum(top) / max(k, 1),
        pairs / max(k - 1, 1), sum(map(operator.eq, words, words[1:])) / max(k - 1, 1),
        len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1) / 1000,
        *[float(share[c]) for c in SINGLE],
    ]


def stat_matrix(column) -> np.ndarray:
    return np.array([statistics(t) for t in each_text(column)], np.float64).reshape(-1, N_STATS)


@dataclass
class Trees:
    """Complete binary trees, level by level: inner nodes (feature, threshold), then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boost ``n_trees`` trees on the logistic loss; splits come from histograms of ``bins`` quantile bins."""
    inner = 2**depth - 1
    trees = Trees(np.zeros((n_trees, inner), np.int32), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1)), 0.0)
    if not len(y):
        return trees
    p = (y.sum() + 0.5) / (len(y) + 1)
    trees.base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), trees.base)
    for t in range(n_trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key = (at - first) * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl = gs[:, : len(cut)], hs[:, : len(cut)]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2), 0.0)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    trees.feature[t, first + node], trees.threshold[t, first + node] = j, cut[k[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), trees.feature[t, at]] > trees.threshold[t, at])
        at -= inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        trees.leaf[t] = -rate * gs / (hs + l2)
        margin += trees.leaf[t][at]
    return trees


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5) -> Trees:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold, those with the lowest id hash.

    A document labelled twice counts with its lower label; ids that documents repeat count once.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            x = stat_matrix(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    return fit(np.array(got.x.tolist(), np.float64).reshape(-1, N_STATS), got.y.to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts score as empty ones. A null doc_id counts as the text '' when folds are dealt.
    Repeated rows come out repeated; an empty table gives an empty result. Without labelled rows
    every score is 0.5. Further columns of either table are ignored, whatever their names.
    """
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows, folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            s = trees.value.score(stat_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["doc_id", "held_out", "score"])

    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return passing(docs, lambda texts: pa.array(trees.value.score(stat_matrix(texts)) >= threshold))


def op5_query(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
