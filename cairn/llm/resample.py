"""Importance resampling towards a target distribution, over hashed word n-grams.

A document's features are its runs of one to ``n`` words; each falls into one of 10,000 buckets by
its checksum. What a feature in a bucket is worth is a whole number: 1,000 times the log of how
much likelier the bucket is in the target's texts than in the corpus, both smoothed by one. A
document's weight is the floored mean over its features, and adding Gumbel noise to the weights
and taking the highest scores draws documents without replacement in proportion to exp(weight/1000).

Features are never rows. Higher-order functions make each document's array of buckets; counting
explodes that array of numbers into a partial count, so only totals by bucket leave a task, and
scoring folds it over a literal array of gains. The driver holds two counts and a gain for each
bucket, whatever the input. Noise hangs on the document's id and the seed alone.

Ranks need an order over all that is drawn. Scores are whole numbers in a narrow range, so counts by
score give the lowest score drawn and the rank at which each score begins; within a score rows are
numbered by doc_id. Rows below the lowest score drawn don't move.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, table

BUCKETS = 10_000
#: ranks that are written out from one array
_STEP = 10_000


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII."""
    return F.filter(F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def buckets_of(found: Column, n: int = 2) -> Column:
    """The buckets of all runs of 1 to ``n`` of the words in ``found``, repeats included."""
    bucket = lambda f: (F.crc32(F.encode(f, "UTF-8")) % BUCKETS).cast("short")

    def runs(k: int) -> Column:
        first = F.slice(found, 1, F.greatest(F.size(found) - (k - 1), F.lit(0)))
        return F.transform(first, lambda w, i: bucket(F.concat_ws(" ", w, *[F.get(found, i + j) for j in range(1, k)])))

    return F.concat(*[runs(k) for k in range(1, n + 1)])


def bucket_counts(texts: DataFrame, n: int = 2) -> np.ndarray:
    """How many features of column ``text`` fall into each bucket."""
    found = texts.select(words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).select(F.explode(buckets_of(F.col("w"), n)).alias("bucket"))
    out = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), B the number of buckets, S and T the sums."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of sha256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weights(docs: DataFrame, target: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of ``docs``; ``target`` has a column ``text``.

    Null texts have no words, and a document without words has weight 0. Rows that repeat count
    and are weighed each. Empty tables give an empty result, an empty target gains that rest on the
    corpus alone. Texts of any length are one row's arrays. Further columns are ignored.
    """
    literal = F.lit(gains(bucket_counts(docs, n), bucket_counts(target, n)))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    found = found.select("doc_id", F.size("w").cast("long").alias("n_words"), buckets_of(F.col("w"), n).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b.cast("int") + 1))
    size = F.size("b").cast("long")
    # of whole numbers, floored without a double between
    mean = F.floor((total - F.pmod(total, size)) / size)
    return found.select("doc_id", "n_words", size.alias("n_features"), F.when(size > 0, mean).otherwise(F.lit(0)).cast("long").alias("weight"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, n: int = 2) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``: the floor(percent * N / 100) highest
    scores of the N rows with ``least_words`` words or more are drawn and ranked from 1, the others' rank is null.

    Ties in the score go to the smaller doc_id, a null one last; rows that tie in both are ranked
    in any order, each with a rank of its own. Edge cases otherwise as in :func:`weights`; the noise of
    a null doc_id is that of the text ''.
    """
    scored = weights(docs, target, n).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")).withColumn("able", F.col("n_words") >= least_words)
    scored = materialise(scored.select("doc_id", "n_features", "weight", "score", "able"), "scored")
    counts = sorted(((r.score, r.n) for r in scored.filter("able").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # scores are whole numbers of a narrow range
    take, done, begins = percent * sum(n for _, n in counts) // 100, 0, {}
    for score, many in counts:
        if done >= take:
            break
        begins[score], done = done, done + many
    if not begins:
        return scored.drop("able").withColumn("rank", F.lit(None).cast("long"))
    above = F.col("able") & (F.col("score") >= min(begins))
    begin = docs.sparkSession.createDataFrame(sorted(begins.items()), "score long, begin long")
    # rows that tie in all are one row with a count until their ranks are written out
    alike = scored.filter(above).groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("many"))
    upto = F.sum("many").over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features").rowsBetween(W.unboundedPreceding, 0))
    alike = alike.withColumn("upto", upto).join(F.broadcast(begin), "score").withColumn("first", F.col("begin") + F.col("upto") - F.col("many") + 1)
    last = F.col("begin") + F.col("upto")
    ranked = alike.withColumn("a", F.explode(F.sequence("first", last, F.lit(_STEP).cast("long")))).withColumn("rank", F.explode(F.sequence("a", F.least(F.col("a") + (_STEP - 1), last))))
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return scored.filter(~above).drop("able").withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def op13_query(spark, sf_dir):
    return drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: checksums are linear: each byte's share of the remainder depends on its distance from the end alone
OP13_SQL = """
WITH RECURSIVE bits(b, k, r) AS (
  SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END FROM bits WHERE k < 8),
one AS MATERIALIZED (SELECT b, r FROM bits WHERE k = 8),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
df AS MATERIALIZED (
  SELECT rid, unnest(w) AS f FROM d UNION ALL
  SELECT rid, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM d WHERE len(w) > 1),
gf AS MATERIALIZED (
  SELECT unnest(w) AS f FROM g UNION ALL
  SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM g WHERE len(w) > 1),
kinds AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM df UNION SELECT DISTINCT f FROM gf)),
most AS (SELECT max(n) AS m FROM kinds),
far(p, b, r) AS (
  SELECT 0::BIGINT, b, r FROM one
  UNION ALL SELECT p + 1, far.b, xor(far.r >> 8, one.r) FROM far JOIN one ON one.b = far.r & 255 WHERE p + 1 < (SELECT m FROM most)),
start(p, r) AS (
  SELECT 0::BIGINT, 4294967295::UBIGINT
  UNION ALL SELECT p + 1, xor(start.r >> 8, one.r) FROM start JOIN one ON one.b = start.r & 255 WHERE p < (SELECT m FROM most)),
bytes AS (SELECT f, n, n - i AS p, CAST('0x' || substr(h, 2 * i - 1, 2) AS UBIGINT) AS b FROM (SELECT f, h, n, unnest(range(1, n + 1)) AS i FROM kinds)),
sums AS (SELECT f, any_value(n) AS n, bit_xor(far.r) AS r FROM bytes JOIN far USING (p, b) GROUP BY f),
bucket AS MATERIALIZED (SELECT f, CAST(xor(xor(sums.r, start.r), 4294967295::UBIGINT) % 10000 AS INTEGER) AS bucket FROM sums JOIN start ON start.p = sums.n),
s AS (SELECT bucket, count(*) AS s FROM df JOIN bucket USING (f) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM gf JOIN bucket USING (f) GROUP BY ALL),
gain AS MATERIALIZED (
  SELECT k.range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM gf) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) k LEFT JOIN s ON s.bucket = k.range LEFT JOIN t ON t.bucket = k.range),
total AS (SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM df JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY rid),
weighed AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
         CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8] AS UBIGINT) AS h
  FROM d LEFT JOIN total USING (rid)),
scored AS MATERIALIZED (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""
