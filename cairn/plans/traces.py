"""Trajectories derived from the events table, one search tree for each user, and their SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analytics, tree


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ternary tree for each user: the k-th event, by time, is the child of event (k - 1) / 3."""
    w = W.partitionBy("user_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")
    e = e.withColumn("s", F.row_number().over(w.orderBy("ts", "event_id")).cast("long") - 1).withColumn("n", F.count("*").over(w))
    s, kind = F.col("s"), F.col("event_type")
    depth = F.when(s < 1, 0).when(s < 4, 1).when(s < 13, 2).when(s < 40, 3).when(s < 121, 4).when(s < 364, 5).otherwise(6)
    tactic = F.when(s == 0, "").when(kind == "click", F.concat(F.lit("intro "), F.col("n").cast("string"))).when(kind == "view", "have h1 : p := by simp").when(kind == "purchase", "exact h1").when(kind == "error", "simp [mul_comm]").otherwise("rw [le_div_iff]")
    body = F.concat(F.repeat(F.lit("h : ℕ\n"), depth), F.lit("⊢ goal_"), s.cast("string"))
    return e.select(
        F.concat(F.lit("thm_"), F.col("user_id").cast("string")).alias("theorem_name"), s.alias("state_id"),
        F.concat(F.expr("repeat(concat(repeat('h : ℕ\n', 1), '⊢ side\n\n'), cast(event_id % 3 as int))"), body).alias("state_pp"),
        tactic.alias("tactic_applied"), F.when(s > 0, F.floor((s - 1) / 3)).cast("long").alias("parent_state_id"), depth.alias("depth_from_root"),
        (-F.col("value")).alias("llm_log_prob"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value") / 2 - depth).alias("ebm_score"),
        ((kind == "purchase") & (3 * s + 1 >= F.col("n")) & (F.col("event_id") % 7 == 0)).alias("is_proof_complete"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), ((F.col("event_id") % 10) / 10).alias("q_value"), (F.col("event_id") % 5).alias("visits"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.label_paths(raw(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.prepare(labelled(spark, sf_dir))


#: the same, for DuckDB: common tables raw, traj (labelled) and prep
SQL = """
WITH RECURSIVE ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events),
ev2 AS (SELECT *, CASE WHEN s < 1 THEN 0 WHEN s < 4 THEN 1 WHEN s < 13 THEN 2 WHEN s < 40 THEN 3 WHEN s < 121 THEN 4 WHEN s < 364 THEN 5 ELSE 6 END AS d FROM ev),
raw AS (
  SELECT 'thm_' || user_id AS theorem_name, s AS state_id,
    repeat('h : ℕ' || chr(10) || '⊢ side' || chr(10) || chr(10), CAST(event_id % 3 AS INTEGER)) || repeat('h : ℕ' || chr(10), d) || '⊢ goal_' || s AS state_pp,
    CASE WHEN s = 0 THEN '' WHEN event_type = 'click' THEN 'intro ' || n WHEN event_type = 'view' THEN 'have h1 : p := by simp' WHEN event_type = 'purchase' THEN 'exact h1' WHEN event_type = 'error' THEN 'simp [mul_comm]' ELSE 'rw [le_div_iff]' END AS tactic_applied,
    CASE WHEN s > 0 THEN (s - 1) // 3 END AS parent_state_id, d AS depth_from_root, -value AS llm_log_prob,
    CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value / 2 - d END AS ebm_score,
    event_type = 'purchase' AND 3 * s + 1 >= n AND event_id % 7 = 0 AS is_proof_complete, epoch_us(ts) // 1000 AS timestamp_ms, (event_id % 10) / 10 AS q_value, event_id % 5 AS visits
  FROM ev2),
first_done AS (SELECT theorem_name, min(state_id) AS state_id FROM raw WHERE is_proof_complete GROUP BY theorem_name),
path AS (
  SELECT r.theorem_name, r.state_id, r.parent_state_id, 0 AS steps FROM raw r JOIN first_done f ON r.theorem_name = f.theorem_name AND r.state_id = f.state_id
  UNION ALL
  SELECT r.theorem_name, r.state_id, r.parent_state_id, p.steps + 1 FROM path p JOIN raw r ON r.theorem_name = p.theorem_name AND r.state_id = p.parent_state_id),
traj AS (
  SELECT r.*, CASE WHEN p.steps IS NULL THEN 'negative' ELSE 'positive' END AS label, coalesce(p.steps, -1) AS remaining_depth
  FROM raw r LEFT JOIN path p ON r.theorem_name = p.theorem_name AND r.state_id = p.state_id),
prep AS (
  SELECT *, tactic_applied = '' AS is_root, CASE WHEN tactic_applied = '' THEN '(root)' ELSE split_part(tactic_applied, ' ', 1) END AS head,
    label = 'positive' AS on_path, bool_or(is_proof_complete) OVER (PARTITION BY theorem_name) AS proved, length(state_pp) AS state_size,
    len(string_split(state_pp, chr(10) || chr(10))) AS goal_count,
    len(list_filter(string_split(split_part(state_pp, '⊢', 1), chr(10)), lambda x: x LIKE '%:%')) AS hypotheses
  FROM traj),
step AS (SELECT * FROM prep WHERE NOT is_root),
branch AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY theorem_name, parent_state_id) AS n_siblings, sum(on_path::INT) OVER (PARTITION BY theorem_name, parent_state_id) AS n_on_path FROM step WHERE parent_state_id IS NOT NULL)
  WHERE n_siblings >= 2 AND n_on_path >= 1),
roll AS (
  SELECT theorem_name, bool_or(proved) AS proved, count(*) AS nodes, count(*) FILTER (on_path) AS positives, max(depth_from_root) AS max_depth, count(*) FILTER (NOT is_root) AS steps,
    coalesce(count(*) FILTER (NOT is_root AND head = 'have') / nullif(count(*) FILTER (NOT is_root), 0), 0) AS have_frac, count(DISTINCT head) FILTER (NOT is_root) AS heads, max(q_value) AS max_q
  FROM prep GROUP BY theorem_name)
"""
