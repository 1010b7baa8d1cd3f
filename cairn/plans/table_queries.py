"""Queries over the other test tables, each with SQL for comparison where SQL can say it."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import analytics as A
from ..operators import curate as C
from ..operators import metrics as M
from ..operators import ranks as RK
from ..operators import scans as SC
from ..streaming import incremental
from . import traces

QUERIES, ORACLE_SQL = {}, {}


def on(table, name, op, sql=None):
    QUERIES[name] = lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql:
        ORACLE_SQL[name] = sql


def over(name, op, sql=None):
    QUERIES[name] = op
    if sql:
        ORACLE_SQL[name] = sql


_FRAC = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967295"
on("documents", "split_by_hash", lambda d: d.select("doc_id", C.split_of(F.concat(F.lit("split:"), "source", F.lit(":"), F.col("doc_id").cast("string"))).alias("split")),
   f"SELECT doc_id, CASE WHEN {_FRAC.format(chr(39) + 'split:' + chr(39) + ' || source || ' + chr(39) + ':' + chr(39) + ' || doc_id')} < 0.05 THEN 'val' ELSE 'train' END AS split FROM documents")
on("documents", "split_counts", lambda d: d.withColumn("split", C.split_of(F.col("doc_id").cast("string"), 0.2)).rollup("source", "split").agg(F.count("*").alias("n")),
   f"SELECT source, split, count(*) AS n FROM (SELECT source, CASE WHEN {_FRAC.format('doc_id::VARCHAR')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY ROLLUP (source, split)")
on("documents", "validation_split", lambda d: C.validation_split(d.select("doc_id").distinct(), "doc_id", 0.1),
   "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, r <= floor(n * 0.1 + 0.5) AS is_val FROM r")
on("documents", "hash_sample_by_lang", lambda d: C.hash_sample(d.select("doc_id", "lang"), "doc_id", 5, "s", "lang"),
   "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
on("documents", "hash_sample", lambda d: C.hash_sample(d.select("doc_id"), "doc_id", 40), "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 40")
on("documents", "systematic_sample", lambda d: C.systematic_sample(d.select("doc_id"), "doc_id", 30),
   "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, greatest(1, count(*) OVER () // 30) AS s FROM documents) WHERE r % s = 0 ORDER BY r LIMIT 30")
on("documents", "contiguous_chunks", lambda d: (lambda n: C.ranked(d.select("doc_id"), "doc_id").select("doc_id", C.chunk_of(F.col("rank_"), n, 7).alias("chunk")))(d.count()),
   "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER () / 7) AS BIGINT) AS INTEGER) AS chunk FROM documents")
on("documents", "sft_filter", lambda d: C.sft_filter(d, "text", "source", "doc_id").groupBy("reason").agg(F.count("*").alias("n")),
   "WITH r AS (SELECT row_number() OVER (PARTITION BY trim(text, ' ' || chr(10) || chr(9) || chr(13)), source ORDER BY doc_id) AS r, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents) SELECT CASE WHEN t = '' THEN 'empty' WHEN r > 1 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY 1")
on("documents", "short_states", lambda d: C.short_states(d, "text", 2000).select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) <= 2000")
on("documents", "without_banned_sources", lambda d: C.without_banned(d, "source", "text", ("moron", "clown")).select("doc_id"),
   "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE contains(text, 'moron') OR contains(text, 'clown'))")
on("documents", "distinct_texts", lambda d: C.distinct_first(d.select("doc_id", "text"), ["text"], "doc_id").select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
on("documents", "numbered_names", lambda d: C.numbered_names(d.select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_name"),
   "SELECT doc_id, CASE WHEN r > 0 THEN source || '__dup' || r ELSE source END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)")
on("documents", "squeezed_text", lambda d: d.select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("h")), "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
on("documents", "lengths_by_lang", lambda d: A.distribution(d.withColumn("len", F.length("text")), "len", "lang"),
   "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.25), 6) AS p25, round(quantile_cont(length(text), 0.75), 6) AS p75, min(length(text))::DOUBLE AS least, max(length(text))::DOUBLE AS most FROM documents GROUP BY lang")
on("documents", "indexed_percentiles", lambda d: (lambda r: r.select("lang", *[F.col(c).cast("long").alias(c) for c in r.columns[1:]]))(RK.percentiles(d, {f"p{int(100 * p)}": ("n_chars", RK.indexed(p)) for p in (0.5, 0.95, 0.99)} | {"upper_median": ("n_chars", RK.upper_median())}, "lang")),
   "WITH s AS (SELECT lang, list_sort(list(n_chars)) AS s, count(*) AS n FROM documents GROUP BY lang) SELECT lang, s[CAST(least(floor(n * 0.5), n - 1) AS BIGINT) + 1] AS p50, s[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95, s[CAST(least(floor(n * 0.99), n - 1) AS BIGINT) + 1] AS p99, s[n // 2 + 1] AS upper_median FROM s")
on("documents", "population_spread", lambda d: d.groupBy("source").agg(A.r6(F.stddev_pop("n_chars")).alias("std"), F.count("*").alias("n")), "SELECT source, round(stddev_pop(n_chars), 6) AS std, count(*) AS n FROM documents GROUP BY source")
on("documents", "shortened_text", lambda d: d.select("doc_id", T.shortened(F.col("text"), 40).alias("t")),
   "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(replace(text, chr(10), '↵'), 1, 37) || '...' ELSE replace(text, chr(10), '↵') END AS t FROM documents")
on("documents", "durations", lambda d: d.select("doc_id", T.duration(F.col("n_chars")).alias("t")),
   "SELECT doc_id, CASE WHEN n_chars < 60 THEN printf('%ds', n_chars) WHEN n_chars < 3600 THEN printf('%dm%02ds', n_chars // 60, n_chars % 60) ELSE printf('%dh%02dm', n_chars // 3600, n_chars % 3600 // 60) END AS t FROM documents")
on("conversations", "deep_conversations", lambda c: C.deep_keys(c, "conv_id", "turn", 4), "SELECT conv_id, max(turn) AS max_depth FROM conversations GROUP BY 1 HAVING max(turn) >= 4")
on("conversations", "complete_conversations", lambda c: C.complete_groups(c, "conv_id", "turn", 3), "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AND count(*) >= 3")
on("conversations", "remaining_turns", lambda c: C.remaining_depth(c, "conv_id", "turn").select("conv_id", "turn", "remaining_depth"), "SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) - turn AS remaining_depth FROM conversations")
on("conversations", "lexicographic_depth", lambda c: C.with_depth(c.select("conv_id", "turn", F.col("turn").cast("string").alias("s")), "conv_id", "s").select("conv_id", "turn", "depth"),
   "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn::VARCHAR) - 1 AS INTEGER) AS depth FROM conversations")
on("conversations", "training_texts", lambda c: c.select("conv_id", "turn", F.md5(T.training_text(F.col("text"), F.col("role"))).alias("h")),
   "SELECT conv_id, turn, md5('Complete the following Lean 4 code:' || chr(10) || chr(10) || '```lean4' || chr(10) || '/- tactic state:' || chr(10) || text || chr(10) || '-/' || chr(10) || '```' || chr(10) || role) AS h FROM conversations")
on("conversations", "pairs_summary", lambda c: c.agg(F.count_distinct("conv_id").alias("theorems"), F.count("*").alias("pairs"), A.r6(F.count("*") / F.count_distinct("conv_id")).alias("per_theorem"), A.r6(F.avg(F.length("text"))).alias("avg_len"), F.max(F.length("text")).alias("max_len")),
   "SELECT count(DISTINCT conv_id) AS theorems, count(*) AS pairs, round(count(*) / count(DISTINCT conv_id), 6) AS per_theorem, round(avg(length(text)), 6) AS avg_len, CAST(max(length(text)) AS INTEGER) AS max_len FROM conversations")
on("conversations", "packed_sequences", lambda c: C.packed(c.select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.array("conv_id", "turn", F.length("text")).alias("tokens")), "k", "tokens", 16, -1, "role").select("role", "run", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels")),
   """WITH t AS (SELECT role, conv_id * 1000 + turn AS k, unnest([conv_id, turn, length(text), -1]) AS tok, unnest([0, 1, 2, 3]) AS i FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY k, i) - 1 AS p FROM t)
SELECT role, p // 16 AS run, string_agg(tok, ',' ORDER BY p) AS ids, string_agg(CASE WHEN i = 3 THEN -100 ELSE tok END, ',' ORDER BY p) AS labels FROM p GROUP BY 1, 2 HAVING count(*) = 16""")
_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS e, label < 5 AS pos FROM embeddings)"
_POS = lambda v: v.withColumn("pos", F.col("label") < 5)
on("embeddings", "vector_norms", lambda v: v.select("vec_id", A.r6(V.norm(F.col("embedding"))).alias("norm")), f"SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM {_E}")
on("embeddings", "centroid_separation", lambda v: M.separation(_POS(v), "pos"), f"""WITH x AS (SELECT pos, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM {_E}), c AS (SELECT d, avg(v) FILTER (pos) AS p, avg(v) FILTER (NOT pos) AS n FROM x GROUP BY d)
SELECT count(*) FILTER (pos) AS positives, count(*) FILTER (NOT pos) AS negatives, round(avg(sqrt(list_inner_product(e, e))) FILTER (pos), 6) AS positive_norm, round(avg(sqrt(list_inner_product(e, e))) FILTER (NOT pos), 6) AS negative_norm,
 round(avg(sqrt(list_inner_product(e, e))) FILTER (NOT pos) - avg(sqrt(list_inner_product(e, e))) FILTER (pos), 6) AS norm_gap, (SELECT round(sqrt(sum((p - n) * (p - n))), 6) FROM c) AS centroid_l2 FROM {_E}""")
on("embeddings", "linear_probe", lambda v: M.probe_accuracy(_POS(v), "pos"), f"""WITH x AS (SELECT pos, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM {_E}), a AS (SELECT list(avg_p - avg_n ORDER BY d) AS axis FROM (SELECT d, avg(v) FILTER (pos) AS avg_p, avg(v) FILTER (NOT pos) AS avg_n FROM x GROUP BY d)),
s AS (SELECT pos, list_inner_product(e, axis) AS s FROM {_E}, a), m AS (SELECT avg(s) AS m FROM s) SELECT round(avg(((s > m) = pos)::INT), 6) AS accuracy FROM s, m""")
on("embeddings", "group_similarity", lambda v: M.group_similarity(v, "label", "vec_id"), f"SELECT a.label, (SELECT count(*) FROM embeddings c WHERE c.label = a.label) AS n, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean_cosine FROM {_E} a JOIN {_E} b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
on("embeddings", "score_auc", lambda v: S.auc("s", "pos", _POS(v).withColumn("s", F.round(F.col("embedding")[0].cast("double"), 3))).select(A.r6(F.col("auc")).alias("auc")),
   f"WITH s AS (SELECT pos, round(e[1], 3) AS s FROM {_E}) SELECT round(avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auc FROM s a, s b WHERE a.pos AND NOT b.pos")
on("embeddings", "energy_metrics", lambda v: M.energy_metrics(v.select(F.slice("embedding", 1, 6).cast("array<double>").alias("energies")), 0.1), f"""WITH x AS (SELECT e[1:6] AS e, e[1] AS p FROM {_E}), n AS (SELECT vec_id, e[1] AS p, unnest(e[2:6]) AS n FROM {_E}), g AS (SELECT vec_id, any_value(p) AS p, min(n) AS least FROM n GROUP BY 1)
SELECT round((SELECT avg(p) FROM x), 6) AS pos_mean, round(avg(n), 6) AS neg_mean, round(avg(n) - (SELECT avg(p) FROM x), 6) AS gap, round((SELECT avg((p < least)::INT) FROM g), 6) AS rank_accuracy, round(avg((p < n)::INT), 6) AS pairwise_accuracy, round(avg((0.1 + p - n > 0)::INT), 6) AS active_fraction,
 round((SELECT stddev_pop(v) FROM (SELECT unnest(e) AS v FROM x)), 6) AS std, round((SELECT avg(e[1] + ln(list_sum(list_transform(e, lambda v: exp(-v))))) FROM x), 6) AS info_nce, round(sum(greatest(0, 0.1 + p - n)) / (count(*) FILTER (0.1 + p - n > 0) + 1e-8), 6) AS margin_loss FROM n""")
over("mlp_scores", lambda spark, d: _scores(spark.read.parquet(f"{d}/embeddings.parquet")))
over("contrastive_samples", lambda spark, d: C.contrastive_samples(traces.labelled(spark, d), 50, 8))
over("nearest_preceding_error", lambda spark, d: _as_of(spark.read.parquet(f"{d}/events.parquet")),
     "SELECT e.event_id, (SELECT s.event_id FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'view' AND (s.ts < e.ts OR s.ts = e.ts AND s.event_id < e.event_id) ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) AS view_id FROM events e WHERE e.event_type = 'error'")
over("set_overlap", lambda spark, d: _sets(spark.read.parquet(f"{d}/events.parquet")),
     "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 50), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 50) SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS in_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b")
over("best_of_attempts", lambda spark, d: A.best_of(_attempts(spark.read.parquet(f"{d}/events.parquet"))),
     "SELECT name, attempt, proved, nodes, time_secs FROM (SELECT 'u' || user_id AS name, event_id AS attempt, event_type = 'purchase' AS proved, event_id % 50 AS nodes, value AS time_secs, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'purchase', event_id) AS r FROM events) WHERE r = 1")
over("eta_moving_window", lambda spark, d: incremental.remaining_time(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")), 100).withColumn("eta_secs", A.r6(F.col("eta_secs"))),
     "SELECT event_id AS id, round(CASE WHEN count(*) OVER w > 1 THEN (ms - first_value(ms) OVER w) / 1000 / (count(*) OVER w - 1) * 100 END, 6) AS eta_secs FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events) WINDOW w AS (ORDER BY ms, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)")
over("pricing_summary", lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(A.r6(F.sum("l_quantity")).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")),
     "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")


def _scores(v):
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    sizes = (64, 32, 16, 8, 1)
    w = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:]), 1):
        m = rng.standard_normal((a, b))
        w |= {f"w{i}": m / M.spectral_norm(m), f"b{i}": np.zeros(b)}
    return v.select("vec_id", (-M.energies(w)(F.col("embedding"))).alias("score"))


def _as_of(e):
    """The last view before each error of a user."""
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return SC.last_value(e, view, "view_id", ["ts", "event_id"], ["user_id"], inclusive=False).filter("event_type = 'error'").select("event_id", "view_id")


def _sets(e):
    rows = e.filter("value > 50").groupBy("user_id").agg(F.max(F.col("event_type") == "error").alias("a"), F.max(F.col("event_type") == "purchase").alias("b"))
    return rows.agg(F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


def _attempts(e):
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("proved"), (F.col("event_id") % 50).alias("nodes"), F.col("value").alias("time_secs"))
