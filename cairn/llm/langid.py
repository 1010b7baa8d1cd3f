"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to ``MAX_N`` code points of the lower-cased text (two blanks follow it) are hashed
into ``2**BITS`` buckets. The log-probability matrix, buckets by languages, is broadcast; its size
is fixed by the number of languages. A batch is scored as a sparse count matrix times that matrix:
the matrix rows of the n-grams present are gathered and summed by document.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

BITS, MAX_N = 15, 3
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTER = re.compile("[A-Za-z]")
#: elements of a gathered block at most
_BLOCK = 4_000_000


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def _buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n, the bucket of the n-gram at each place; and where each text begins."""
    padded = [t.lower() + "  " for t in texts]
    starts = np.cumsum([0, *map(len, padded)])[:-1]
    codes = np.frombuffer("".join([*padded, "  "]).encode("utf-32-le", "replace"), np.uint32)
    n, mixed, out = len(codes) - 2, np.uint32(0), []
    with np.errstate(over="ignore"):
        for k in range(MAX_N):
            mixed = (mixed + codes[k : k + n] + np.uint32(k + 1)) * _MULTIPLIERS[k]
            mixed = mixed ^ (mixed >> np.uint32(15))
            out.append(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out, starts


def _slices(texts: list[str], width: int):
    """Runs of texts with about ``_BLOCK / width`` characters, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > _BLOCK // width:
            yield first, i
            first, size = i, 0
        size += len(t) + 2
    if first < len(texts):
        yield first, len(texts)


def train(docs: DataFrame, max_rows: int = 20_000, folds: int = 5) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets x languages, the prior in one more row).

    Fitted on the whole texts of at most ``max_rows`` documents with a language, outside the
    held-out fold, those with the lowest id hash.
    """
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    chosen = able.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = able.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                own = [t for x, t in zip(langs, texts) if x == lang]
                sums = total.setdefault(lang, np.zeros(2**BITS + 1, np.int64))
                for i, j in _slices(own, 1):
                    for x in _buckets(own[i:j])[0]:
                        sums[:-1] += np.bincount(x, minlength=2**BITS)
                sums[-1] += len(own)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])

    got = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang.unique())
    counts = np.zeros((2**BITS + 1, len(langs)))
    counts[got.bucket.to_numpy(np.int64), got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = got.n
    grams, prior = counts[:-1] + 0.5, counts[-1:]
    return langs, np.concatenate([np.log(grams / grams.sum(0)), np.log(prior / max(prior.sum(), 1))]).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, best = ["und"] * len(texts), np.zeros(len(texts))
    able = [i for i, t in enumerate(texts) if t is not None and langs and has_letter(t)]
    own = [texts[i] for i in able]
    for i, j in _slices(own, max(1, len(langs))):
        grams, starts = _buckets(own[i:j])
        sums = sum(np.add.reduceat(table[g], starts, axis=0, dtype=np.float64) for g in grams) + table[-1]
        odds = np.exp(sums - sums.max(1, keepdims=True))
        top = odds.argmax(1)
        for k, at, p in zip(able[i:j], top.tolist(), (1 / odds.sum(1)).tolist()):
            names[k], best[k] = langs[at], p
    return names, best


def identify(docs: DataFrame, max_rows: int = 20_000, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's posterior) for every row of ``docs``.

    Texts that are null or have no letter, and all texts if no language could be learned, get
    'und' with score 0. Ties go to the language first in alphabetical order. Repeated rows come out
    repeated; an empty table gives an empty result; further columns are ignored. A null doc_id
    counts as the text '' when folds are dealt.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, max_rows, folds))

    def run(batches):
        for b in batches:
            names, score = predict(b.column(2).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_query(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
