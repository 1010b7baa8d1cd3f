"""Queries over training records, manifests, signatures and vectors, with SQL to compare them with."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import proofs as P
from ..functions import text as T
from ..operators import analytics as A
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import training as N
from . import traces

QUERIES, ORACLE_SQL = {}, {}


def over(name, op, sql):
    QUERIES[name], ORACLE_SQL[name] = op, sql


def traj(name, op, sql):
    over(name, lambda spark, sf_dir: op(traces.labelled(spark, sf_dir)), traces.SQL + sql)


def prep(name, op, sql):
    over(name, lambda spark, sf_dir: op(traces.prepared(spark, sf_dir)), traces.SQL + sql)


def on(table, name, op, sql):
    over(name, lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet")), sql)


def _cache(t):
    return t.filter("state_id % 3 <> 0").groupBy("state_pp").agg(F.array(F.max("depth_from_root").cast("float")).alias("embedding"))


_CACHE = ", cache AS (SELECT state_pp, max(depth_from_root)::FLOAT AS first FROM traj WHERE state_id % 3 <> 0 GROUP BY 1)\n"
traj("records_with_vectors", lambda t: N.with_vectors(t, _cache(t)).select("theorem_name", "state_id"), _CACHE + "SELECT theorem_name, state_id FROM traj WHERE EXISTS (SELECT 1 FROM cache c WHERE c.state_pp = traj.state_pp)")
traj("vector_counts", lambda t: N.vector_counts(t, _cache(t), "label"), _CACHE + "SELECT label, count(*) AS before, count(first) AS kept, count(*) - count(first) AS dropped FROM traj LEFT JOIN cache USING (state_pp) GROUP BY 1")
traj("state_vectors", lambda t: N.vectors_of(t, _cache(t)).select("state_pp", F.col("embedding")[0].alias("first")), _CACHE + "SELECT DISTINCT state_pp, first FROM traj LEFT JOIN cache USING (state_pp)")
over("merged_pairs", lambda spark, sf_dir: N.merged_pairs(traces.labelled(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('thm_', cast(2 * user_id as string)) as theorem", "event_type as state")).groupBy("theorem_name", "label").agg(F.count("*").alias("n"), F.count_distinct("state_pp").alias("states")),
     traces.SQL + "SELECT theorem_name, label, count(*) AS n, count(DISTINCT state_pp) AS states FROM (SELECT theorem_name, state_pp, label FROM traj UNION ALL SELECT 'thm_' || 2 * user_id, event_type, 'positive' FROM events WHERE 'thm_' || 2 * user_id IN (SELECT theorem_name FROM traj)) GROUP BY 1, 2")
traj("first_theorems", lambda t: N.first_theorems(t, 7, "timestamp_ms").select("theorem_name", "state_id"), "SELECT theorem_name, state_id FROM traj WHERE theorem_name IN (SELECT theorem_name FROM traj GROUP BY 1 ORDER BY min(timestamp_ms), theorem_name LIMIT 7)")
prep("head_counts", lambda p: R.head_counts(A.steps(p), 3), "SELECT head, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM step), 6) AS pct FROM step GROUP BY 1 ORDER BY n DESC, head LIMIT 3")
prep("compared_heads", lambda p: R.compared_heads({"everywhere": A.steps(p), "path": A.steps(p).filter("proved and on_path"), "dead": A.steps(p).filter("proved and not on_path and head <> 'simp'")}, 4), """, h AS (SELECT 'everywhere' AS c, head FROM step UNION ALL SELECT 'path', head FROM step WHERE proved AND on_path UNION ALL SELECT 'dead', head FROM step WHERE proved AND NOT on_path AND head <> 'simp'),
k AS (SELECT c, head, 100 * count(*) / sum(count(*)) OVER (PARTITION BY c) AS pct, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, head) AS r FROM h GROUP BY 1, 2)
SELECT head, round(coalesce(max(pct) FILTER (c = 'everywhere'), 0), 6) AS everywhere, round(coalesce(max(pct) FILTER (c = 'path'), 0), 6) AS path, round(coalesce(max(pct) FILTER (c = 'dead'), 0), 6) AS dead FROM k WHERE r <= 4 GROUP BY 1""")
on("events", "compile_counts", lambda e: R.compile_counts(e.select(F.expr("CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'timeout' END").alias("status"))),
   "SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS timeouts, round(100 * count(*) FILTER (event_type IN ('click', 'view')) / count(*), 1) AS pass_rate FROM events")


def _manifest(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 3 <> 0").selectExpr("concat('p', cast(n_nationkey as string)) as problem_id", "n_name as filename", "n_nationkey as seq")


over("clean_files", lambda spark, sf_dir: R.with_files(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('p', cast(s_nationkey as string)) as problem_id"), _manifest(spark, sf_dir)), "SELECT DISTINCT 'p' || s_nationkey AS problem_id, n_name AS filename FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 3 <> 0")
over("source_problems", lambda spark, sf_dir: R.with_problems(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", "s_nationkey as seq"), _manifest(spark, sf_dir)).select("s_suppkey", "problem_id"), "SELECT s_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN 'p' ELSE 'unknown_' END || s_nationkey AS problem_id FROM supplier")
on("embeddings", "pair_similarities", lambda v: M.pair_similarities(v.withColumn("g", F.expr("vec_id div 20")).withColumn("positive", F.col("label") < 5), "g", "vec_id", "positive"), """WITH v AS (SELECT vec_id, vec_id // 20 AS g, label < 5 AS p, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT CASE WHEN a.p AND b.p THEN 'positive' WHEN a.p OR b.p THEN 'mixed' ELSE 'negative' END AS kind, list_cosine_similarity(a.e, b.e) AS c, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.g = b.g AND a.vec_id < b.vec_id)
SELECT kind, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(min(c), 6) AS least, round(list_sort(list(c))[count(*) // 10 + 1], 6) AS p10, round(list_sort(list(c))[count(*) // 2 + 1], 6) AS p50, round(list_sort(list(c))[9 * count(*) // 10 + 1], 6) AS p90, round(max(c), 6) AS most, round(avg(d), 6) AS l2 FROM x GROUP BY 1""")
on("embeddings", "cosine_gap", lambda v: M.cosine_gap(v.withColumn("positive", F.col("label") < 5), "vec_id", "positive", 60), """WITH v AS (SELECT vec_id, label < 5 AS p, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) AS r FROM embeddings),
w AS (SELECT avg(list_cosine_similarity(a.e, b.e)) AS within FROM v a JOIN v b ON a.p AND b.p AND a.r <= 60 AND b.r <= 60 AND a.r <> b.r), x AS (SELECT avg(list_cosine_similarity(a.e, b.e)) AS across FROM v a JOIN v b ON a.p AND NOT b.p AND a.r <= 60 AND b.r <= 60)
SELECT round(within, 6) AS within, round(across, 6) AS "cross", round(within - across, 6) AS gap FROM w, x""")
on("events", "renamed_sources", lambda e: e.select("event_id", T.renamed_source(F.expr("concat('rw [', CASE event_id % 5 WHEN 0 THEN 'le_div_iff' WHEN 1 THEN 'div_le_div_iff, add_left_neg' WHEN 2 THEN 'true_and_iffy' WHEN 3 THEN 'le_div_iff₀' ELSE 'and_true_iff' END, '] ∑ i in S, ', event_type, ' ∏  j  in T x in y')")).alias("source")),
   "SELECT event_id, 'rw [' || (['le_div_iff₀', 'div_le_div_iff₀, neg_add_cancel', 'true_and_iffy', 'le_div_iff₀', 'and_true'])[event_id % 5 + 1] || '] ∑ i ∈ S, ' || event_type || ' ∏  j ∈ T x in y' AS source FROM events")
_SIGNED = "CASE n_nationkey % 5 WHEN 0 THEN concat('(x : ', n_name, ') [inst] {y z : ℕ} : x = (y : ℝ)') WHEN 1 THEN concat(': ', n_name) WHEN 2 THEN concat('(h : a ∣ b) ', n_name, ' : p') WHEN 3 THEN concat('(x : f (a) {b}) {y}\\n, ', n_name) ELSE concat('(a : T) : ', n_name) END"
on("nation", "signatures", lambda n: n.select("n_nationkey", P.signature_of(F.expr(_SIGNED)).alias("signature"), P.typed_of(F.expr(_SIGNED)).alias("typed")), """SELECT n_nationkey,
  CASE n_nationkey % 5 WHEN 0 THEN '∀ (x : ' || n_name || ') [inst] {y z : ℕ}, x = (y : ℝ)' WHEN 1 THEN n_name WHEN 2 THEN '(h : a ∣ b) ' || n_name || ' : p' WHEN 3 THEN '(x : f (a) {b}) {y}' || chr(10) || ', ' || n_name ELSE '∀ (a : T), ' || n_name END AS signature,
  CASE n_nationkey % 5 WHEN 0 THEN '(x : ' || n_name || ') [inst] {y z : ℕ} : x = (y : ℝ)' WHEN 1 THEN n_name WHEN 2 THEN '(h : a ∣ b) ' || n_name || ' : p' WHEN 3 THEN '∀ (x : f (a) {b}) {y}, ' || n_name ELSE '∀ (a : T), ' || n_name END AS typed FROM nation""")
