"""Reports over the test tables, with SQL to compare them with."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import proofs as P
from ..operators import curate as C
from ..operators import reports as R
from ..operators import search as S
from . import traces

QUERIES, ORACLE_SQL = {}, {}


def over(name, op, sql=None):
    QUERIES[name] = op
    if sql:
        ORACLE_SQL[name] = sql


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _tried(e):
    """Users as theorems: all of them, those with a large purchase, those with a large error."""
    who = lambda cond: e.filter(cond).select(F.col("user_id").alias("theorem")).distinct()
    return who("true"), who("event_type = 'purchase' AND value > 40"), who("event_type = 'error' AND value > 60")


def on(make, name, op, sql, prefix=""):
    over(name, lambda spark, sf_dir: op(make(spark, sf_dir)), prefix + sql)


def traj(name, op, sql):
    on(traces.labelled, name, op, sql, traces.SQL)


def prep(name, op, sql):
    on(traces.prepared, name, op, sql, traces.SQL)


on(events, "latency_percentiles", lambda e: R.latency_percentiles(e, "value", "event_type"), """SELECT event_type, v[n // 2 + 1] AS p50, v[least(floor(n * 0.95), n - 1)::INT + 1] AS p95, v[least(floor(n * 0.99), n - 1)::INT + 1] AS p99
  FROM (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)""")
on(events, "throughput", lambda e: R.throughput(e.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), "ms", "user_id"), """SELECT round(60 * count(DISTINCT user_id) / s, 6) AS keys_per_minute, round(count(*) / s, 6) AS rows_per_second
  FROM events, (SELECT (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 1000 AS s FROM events) GROUP BY s""")
on(events, "interval_means", lambda e: R.interval_means(e, "event_id", 100, "value"), "SELECT event_id // 100 AS \"interval\", round(avg(value), 6) AS value FROM events GROUP BY 1")
on(events, "metric_improving", lambda e: R.improving(e, "event_id", "value", 5, "user_id").select("event_id", "improving"), """SELECT event_id, count(*) OVER w > 1 AND last_value(value) OVER w > first_value(value) OVER w AS improving FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
on(events, "metric_best", lambda e: R.best_so_far(e, "event_id", "value", "user_id").select("event_id", "best"), """SELECT event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM events""")
on(events, "nearest_before", lambda e: R.nearest_before(e.withColumn("name", F.when(F.col("event_type") == "signup", F.col("event_id"))), "user_id", "event_id", "name").filter("event_type = 'error'").select("event_id", "nearest"), """SELECT event_id, nearest FROM (
  SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS nearest FROM events) WHERE event_type = 'error'""")
on(events, "attempts_rollup", lambda e: R.attempts_rollup(e.select(F.col("user_id").alias("theorem"), F.col("event_type").alias("temperature"), (F.col("event_id") % 3 == 0).alias("compiled"), F.col("props").alias("proof"))), """SELECT user_id AS theorem, event_type AS temperature, count(*) AS attempts,
  count(*) FILTER (event_id % 3 = 0) AS compiled, count(DISTINCT props) FILTER (event_id % 3 = 0) AS proofs, count(DISTINCT trim(split_part(props, chr(10), 1))) FILTER (event_id % 3 = 0) AS first_lines FROM events GROUP BY 1, 2""")
on(events, "counts_with_totals", lambda e: R.counted(e.withColumn("third", F.col("event_id") % 3), "event_type", "third"), """SELECT event_type, event_id % 3 AS third, count(*) AS n, 2 - grouping(event_type) - grouping(event_id % 3) AS level FROM events GROUP BY ROLLUP (event_type, event_id % 3)""")
on(events, "key_overlap", lambda e: R.overlap(e.filter("event_type = 'signup'"), e.filter("event_type = 'error'"), "user_id"), """SELECT count(*) AS "either", count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b
  FROM (SELECT user_id, bool_or(event_type = 'signup') AS a, bool_or(event_type = 'error') AS b FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1)""")
on(events, "run_totals", lambda e: R.run_totals(e.select((F.col("event_id") % 3 == 0).alias("proved"), F.when(F.col("event_id") % 7 == 0, "timeout").when(F.col("event_id") % 11 == 0, "error").otherwise("none").alias("reason"), F.col("user_id").alias("nodes"), (F.col("event_id") % 5).alias("generate_ms"), (F.col("event_id") % 4).alias("verify_ms"), (F.col("event_id") % 2).alias("score_ms")), 1e6), """SELECT count(*) AS theorems,
  count(*) FILTER (event_id % 3 = 0) AS proved, round(100 * avg((event_id % 3 = 0)::INT), 6) AS proved_pct, count(*) FILTER (event_id % 3 <> 0) AS failed, count(*) FILTER (event_id % 7 = 0) AS timeouts, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 = 0) AS errors,
  sum(user_id)::BIGINT AS nodes, round(100 * sum(event_id % 5) / 1e6, 6) AS generate_pct, round(100 * sum(event_id % 4) / 1e6, 6) AS verify_pct, round(100 * sum(event_id % 2) / 1e6, 6) AS score_pct,
  greatest(0, 1e6 - sum(event_id % 5 + event_id % 4 + event_id % 2))::DOUBLE AS overhead_ms FROM events""")
traj("labels_by_depth", R.labels_by_depth, "SELECT depth_from_root, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative FROM traj GROUP BY 1")
traj("deep_negatives", R.deep_negatives, "SELECT count(DISTINCT theorem_name) AS theorems FROM traj WHERE label = 'negative' AND depth_from_root > 2")
traj("class_balance", R.class_balance, """SELECT min(pos) AS min_pos, list_sort(list(pos))[count(*) // 2 + 1] AS mid_pos, max(pos) AS max_pos, min(neg) AS min_neg, list_sort(list(neg))[count(*) // 2 + 1] AS mid_neg, max(neg) AS max_neg,
  count(*) FILTER (pos > 0 AND neg > 0) AS eligible, count(*) FILTER (neg < 3) AS few_negatives
  FROM (SELECT theorem_name, count(*) FILTER (label = 'positive') AS pos, count(*) FILTER (label = 'negative') AS neg FROM traj GROUP BY 1)""")
traj("unchanged_chains", lambda t: R.unchanged_chains(t.withColumn("state_pp", F.expr("concat(repeat('h : ℕ\\n', depth_from_root), '⊢ goal_', cast(state_id % 2 as string))"))), """, rp AS (SELECT theorem_name, state_id, parent_state_id, state_id % 2 AS g FROM raw),
ch AS (SELECT c.theorem_name, c.state_id AS s, p.parent_state_id AS up, c.g, 1 AS k FROM rp c JOIN rp p ON p.theorem_name = c.theorem_name AND p.state_id = c.parent_state_id AND p.g = c.g
  UNION ALL SELECT ch.theorem_name, ch.s, r.parent_state_id, ch.g, ch.k + 1 FROM ch JOIN rp r ON r.theorem_name = ch.theorem_name AND r.state_id = ch.up AND r.g = ch.g)
SELECT r.theorem_name, r.state_id, coalesce(max(k), 0)::BIGINT AS chain FROM rp r LEFT JOIN ch ON ch.theorem_name = r.theorem_name AND ch.s = r.state_id GROUP BY 1, 2""")
traj("step_pairs_summary", lambda t: R.pairs_summary(t.select(F.col("theorem_name").alias("theorem"), F.col("state_pp").alias("state"), F.col("tactic_applied").alias("tactic"))), """SELECT count(DISTINCT theorem_name) AS theorems, count(*) AS pairs, round(count(*) / count(DISTINCT theorem_name), 6) AS per_theorem,
  round(avg(length(tactic_applied)), 6) AS avg_length, max(length(tactic_applied)) AS max_length, round(100 * avg((length(state_pp) - length(replace(state_pp, '⊢', '')) > 1)::INT), 6) AS multi_goal_pct FROM traj""")
prep("depth_stats", lambda p: R.depth_stats(p.filter("on_path"), "theorem_name", "depth_from_root"), """SELECT count(*) AS n, round(median(d), 6) AS median, round(avg(d), 6) AS mean, count(*) FILTER (d >= 3) AS deep, round(100 * avg((d >= 3)::INT), 6) AS deep_pct
  FROM (SELECT theorem_name, max(depth_from_root) AS d FROM prep WHERE on_path GROUP BY 1)""")
prep("rate_by_depth", R.rate_by_depth, "SELECT CASE WHEN max_depth < 2 THEN '0-1' WHEN max_depth < 4 THEN '2-3' WHEN max_depth < 6 THEN '4-5' ELSE '6+' END AS bucket, count(*) AS theorems, count(*) FILTER (proved) AS proved, round(100 * avg(proved::INT), 6) AS rate FROM roll GROUP BY 1")
prep("random_rank_one", R.random_rank_one, "SELECT count(*) AS points, round(100 * avg(share), 6) AS rank_one FROM (SELECT count(*) FILTER (on_path) / count(*) AS share FROM branch GROUP BY theorem_name, parent_state_id)")
_HEADS = ["rw [a]", "intro", "linarith", "norm_cast at h", "simp", "push_cast", " field_simp", "have h", "ring", "omega", "nlinarith", "aesop", "decide", "exact_mod_cast h"]
prep("sensitive_heads", lambda p: R.sensitive_heads(p.withColumn("tactic_applied", F.when(F.col("is_root"), "").otherwise(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), F.expr(f"CAST(state_id % {len(_HEADS)} AS INT) + 1"))))), f""", hd AS (SELECT split_part(trim(({_HEADS!r})[state_id % {len(_HEADS)} + 1]), ' ', 1) AS head, label = 'positive' AS good FROM step)
SELECT head, count(*) FILTER (good) AS path, count(*) FILTER (NOT good) AS dead, round(100 * count(*) FILTER (good) / (SELECT count(*) FROM hd WHERE good), 6) AS path_pct, round(100 * count(*) FILTER (NOT good) / (SELECT count(*) FROM hd WHERE NOT good), 6) AS dead_pct,
  head IN ('rw', 'simp', 'linarith', 'norm_cast', 'push_cast', 'field_simp', 'ring', 'omega', 'exact_mod_cast') AS sensitive FROM hd GROUP BY 1 HAVING count(*) >= 5""")
traj("positive_sources", lambda t: R.positive_sources(t.filter("label = 'negative'").select(F.col("theorem_name").alias("theorem"), F.col("depth_from_root").alias("depth")), t.filter("state_id % 5 <> 4")), """, s AS (SELECT * FROM traj WHERE state_id % 5 <> 4), r AS (SELECT 'pairs' AS source, theorem_name AS t FROM traj WHERE label = 'negative' UNION ALL SELECT 'search', theorem_name FROM s WHERE label = 'positive')
SELECT source, count(*) AS "rows", count(DISTINCT t) AS theorems, count(DISTINCT t) FILTER (t IN (SELECT theorem_name FROM s WHERE label = 'negative')) AS with_negatives FROM r GROUP BY 1""")
traj("pair_depths", lambda t: R.depth_histogram(t, "depth_from_root"), "SELECT depth_from_root AS depth, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM traj), 6) AS pct FROM traj GROUP BY 1")
traj("separation_probe", lambda t: C.separation_probe(t.withColumn("state_pp", F.when(F.col("state_id") % 11 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit(" "), F.element_at(F.split("state_pp", "\n"), -1)))), "state_pp", "label", "depth_from_root", ["theorem_name", "state_id"]),
     """SELECT state, label FROM (SELECT 'x' || '', trim(list_last(string_split(state_pp, chr(10)))) AS state, label, row_number() OVER (PARTITION BY trim(list_last(string_split(state_pp, chr(10)))) ORDER BY theorem_name, state_id) AS k FROM traj WHERE depth_from_root > 1 AND state_id % 11 <> 0) WHERE k = 1""")
prep("deepest_by_outcome", lambda p: C.deepest(p, "depth_from_root", "proved", "theorem_name"), "SELECT proved, theorem_name, max_depth FROM roll")
over("blocked_impact", lambda spark, sf_dir: R.impact(*_tried(events(spark, sf_dir))), """WITH u AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 40) AS ok, bool_or(event_type = 'error' AND value > 60) AS bad FROM events GROUP BY 1), c AS (SELECT count(*) AS t, count(*) FILTER (ok) AS p, count(*) FILTER (bad) AS b FROM u)
SELECT t AS tried, p AS proved, b AS broken, t - b AS pool, round(100 * p / t, 6) AS rate, round(100 * r, 6) AS adjusted_rate, CAST(floor(r * b) AS BIGINT) AS extra, round(100 * (p + floor(r * b)) / t, 6) AS upper_rate FROM (SELECT *, coalesce(p / nullif(t - b, 0), 0) AS r FROM c)""")
prep("best_candidates", lambda p: R.best_candidates(p.filter("not is_root"), ["theorem_name", "parent_state_id"], "tactic_applied", "llm_log_prob", "state_id").select("theorem_name", "state_id", "place"), """SELECT theorem_name, state_id, row_number() OVER (PARTITION BY theorem_name, parent_state_id ORDER BY llm_log_prob DESC, state_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY theorem_name, parent_state_id, tactic_applied ORDER BY state_id) AS k FROM step) WHERE k = 1""")
def _runs(p):
    """Two runs: all nodes; the even ones, with proofs that start at some complete even node."""
    some = p.filter("state_id % 2 = 0")
    return [p.groupBy(F.col("theorem_name").alias("theorem")).agg(F.max("is_proof_complete").alias("proved"), F.count("*").alias("nodes")).filter("nodes % 5 <> 0"), some.groupBy(F.col("theorem_name").alias("theorem")).agg(F.max("is_proof_complete").alias("proved"), F.count("*").alias("nodes"))]


prep("hardest_unproved", lambda p: R.hardest(_runs(p)), """, r1 AS (SELECT theorem_name AS theorem, bool_or(is_proof_complete) AS proved, count(*) AS nodes FROM raw GROUP BY 1 HAVING count(*) % 5 <> 0), r2 AS (SELECT theorem_name AS theorem, bool_or(is_proof_complete) AS proved, count(*) AS nodes FROM raw WHERE state_id % 2 = 0 GROUP BY 1)
SELECT theorem, coalesce(r1.nodes, 0) + coalesce(r2.nodes, 0) AS nodes FROM r1 FULL JOIN r2 USING (theorem) WHERE NOT coalesce(r1.proved, false) AND NOT coalesce(r2.proved, false) ORDER BY nodes DESC, theorem LIMIT 15""")
_NAME = "CASE CAST(substr(theorem_name, 5) AS INT) % 4 WHEN 0 THEN concat('imo_', theorem_name) WHEN 1 THEN concat('putnam.', theorem_name) WHEN 2 THEN 'single' ELSE theorem_name END"
prep("subjects", lambda p: R.subjects(p.groupBy("theorem_name").agg(F.max("proved").alias("proved")).withColumn("name", F.expr(_NAME)), "name", "proved"), f"SELECT split_part(replace({_NAME}, '.', '_'), '_', 1) AS subject, count(*) AS total, count(*) FILTER (proved) AS proved FROM roll GROUP BY 1")
prep("depth_ramps", lambda p: p.select("theorem_name", "state_id", N.whole_ramp(F.col("depth_from_root"), 1024, 256, 8).alias("tokens"), F.round(N.ramp(F.col("depth_from_root"), 0.8, 1.2, 8), 6).alias("temperature")), """SELECT theorem_name, state_id, 1024 - floor(768 * depth_from_root / 8)::BIGINT AS tokens, round(0.8 + 0.4 * depth_from_root / 8, 6) AS temperature FROM prep""")


def replayed(spark, sf_dir):
    """Searches whose environment answers as the derived trees do, from proposals that follow each tree's path."""
    t = traces.labelled(spark, sf_dir)
    tactic = F.concat("tactic_applied", F.lit(" at "), F.col("state_id").cast("string"))
    moves = t.filter("parent_state_id is not null").select("theorem_name", F.col("parent_state_id").alias("state_id"), tactic.alias("tactic"), F.when(F.col("is_proof_complete"), "complete").otherwise("success").alias("kind"), F.col("state_id").alias("next_state_id"), F.array("state_pp").alias("goals"))
    steps = t.filter("label = 'positive' AND parent_state_id IS NOT NULL").groupBy("theorem_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth_from_root", tactic.alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    policy = steps.select("theorem_name", F.lit("").alias("pattern"), F.lit("default").alias("match"), F.lit(0).alias("ord"), "text", F.lit(-1.0).alias("log_prob"))
    theorems = t.filter("parent_state_id is null").select("theorem_name", F.col("state_pp").alias("statement"))
    return S.results(S.best_first(theorems, moves, policy, S.Settings(probes=(), have_limit=0, unchanged_limit=0))).select("theorem_name", "proved", "states")


over("best_first_replay", replayed, traces.SQL + "SELECT r.theorem_name, r.proved AND r.nodes > 1 AS proved, CASE WHEN r.proved THEN r.positives ELSE 1 END AS states FROM roll r")
over("document_steps", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(P.flat_steps_of(F.col("text"))).alias("steps")))
