"""Queries over the derived trajectories, each with SQL for comparison."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import tree as G
from . import traces

QUERIES, ORACLE_SQL = {}, {}


def _on(make, op):
    return lambda spark, sf_dir: op(make(spark, sf_dir))


def prep(name, op, sql=None):
    QUERIES[name] = _on(traces.prepared, op)
    if sql:
        ORACLE_SQL[name] = traces.SQL + sql


def traj(name, op, sql=None):
    QUERIES[name] = _on(traces.labelled, op)
    if sql:
        ORACLE_SQL[name] = traces.SQL + sql


def raw(name, op, sql=None):
    QUERIES[name] = _on(traces.raw, op)
    if sql:
        ORACLE_SQL[name] = traces.SQL + sql


traj("trajectory_summary", A.summary, """SELECT count(*) AS n_rows, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(DISTINCT theorem_name) AS theorems,
  count(DISTINCT theorem_name) FILTER (is_proof_complete) AS proved, count(*) - count(*) FILTER (label IN ('positive', 'negative')) AS unknown, round(100 * count(DISTINCT theorem_name) FILTER (is_proof_complete) / count(DISTINCT theorem_name), 6) AS prove_rate FROM traj""")
traj("label_paths", lambda t: t.select("theorem_name", "state_id", "label", "remaining_depth"), "SELECT theorem_name, state_id, label, remaining_depth FROM traj")
traj("proof_steps", lambda t: G.proof_steps(t).select("theorem_name", F.array_join("tactics", "; ").alias("tactics")), """SELECT theorem_name, string_agg(tactic_applied, '; ' ORDER BY depth_from_root, state_id) AS tactics FROM traj WHERE label = 'positive' AND tactic_applied <> '' GROUP BY 1""")
traj("export_proof_paths", lambda t: G.exported_paths(t, 2), """, st AS (SELECT *, count(*) OVER (PARTITION BY theorem_name) AS c FROM prep WHERE proved AND label = 'positive' AND tactic_applied <> '')
SELECT s.theorem_name AS theorem, p.state_pp AS state, s.tactic_applied AS tactic, greatest(s.depth_from_root - 1, 0) AS depth FROM st s JOIN prep p ON p.theorem_name = s.theorem_name AND p.state_id = s.parent_state_id WHERE s.c >= 2""")
traj("negative_tiers", lambda t: G.negative_tiers(t).groupBy("label", "tier").agg(F.count("*").alias("n")), """, x AS (SELECT label, CASE WHEN label = 'negative' THEN CASE WHEN parent_state_id IS NOT NULL AND bool_or(label = 'positive') OVER (PARTITION BY theorem_name, parent_state_id) THEN 'sibling' ELSE 'other' END END AS tier FROM traj)
SELECT label, tier, count(*) AS n FROM x GROUP BY ALL""")
raw("leaves", lambda t: G.leaves(t).select("theorem_name", "state_id"), """SELECT theorem_name, state_id FROM raw r WHERE NOT is_proof_complete AND NOT EXISTS (SELECT 1 FROM raw c WHERE c.theorem_name = r.theorem_name AND c.parent_state_id = r.state_id)""")
raw("success_backup", lambda t: G.backed_up(t).withColumn("q", A.r6(F.col("q"))), """, up AS (SELECT theorem_name, state_id, parent_state_id FROM raw WHERE is_proof_complete UNION ALL SELECT r.theorem_name, r.state_id, r.parent_state_id FROM up u JOIN raw r ON r.theorem_name = u.theorem_name AND r.state_id = u.parent_state_id),
c AS (SELECT theorem_name, state_id, count(*) AS k FROM up GROUP BY ALL)
SELECT r.theorem_name, r.state_id, coalesce(k, 0) AS successes, round(CASE WHEN visits > 0 THEN coalesce(k, 0) / visits ELSE 0 END, 6) AS q FROM raw r LEFT JOIN c ON c.theorem_name = r.theorem_name AND c.state_id = r.state_id""")
prep("frontier_scores", lambda p: G.scored(p, penalty=0.1).withColumn("score", A.r6(F.col("score"))), """SELECT c.theorem_name, c.state_id, round(0.5 / (1 + c.visits) * coalesce(c.ebm_score, c.llm_log_prob) + (1 - 0.5 / (1 + c.visits)) * c.q_value + sqrt(ln(p.visits + 1.0) / (1 + c.visits)) - 0.1 * greatest(c.goal_count - 1, 0), 6) AS score
FROM prep c JOIN prep p ON p.theorem_name = c.theorem_name AND p.state_id = c.parent_state_id""")
prep("combined_scores", lambda p: p.select("theorem_name", "state_id", A.r6(G.combined_score(F.col("llm_log_prob"), F.col("ebm_score"), 0.7, 0.3, 2.0, 0.0)).alias("score")), "SELECT theorem_name, state_id, round(0.7 * llm_log_prob / 2 + 0.3 * ebm_score, 6) AS score FROM prep")
prep("have_chains", G.have_chains, """, ch AS (SELECT theorem_name, state_id AS s, parent_state_id AS p, 1 AS k FROM raw WHERE tactic_applied LIKE 'have %' UNION ALL SELECT c.theorem_name, c.s, r.parent_state_id, c.k + 1 FROM ch c JOIN raw r ON r.theorem_name = c.theorem_name AND r.state_id = c.p WHERE r.tactic_applied LIKE 'have %')
SELECT theorem_name, state_id, coalesce((SELECT max(k) FROM ch WHERE ch.theorem_name = r.theorem_name AND ch.s = r.state_id), 0) AS chain FROM raw r""")
traj("fewer_children", lambda t: G.fewer_children(t, 2).select("theorem_name", "state_id"), """SELECT theorem_name, state_id FROM (SELECT *, row_number() OVER (PARTITION BY theorem_name, parent_state_id ORDER BY llm_log_prob + ebm_score DESC, state_id) AS r FROM traj) WHERE r <= 2 OR parent_state_id IS NULL""")
prep("head_distribution", A.head_distribution, """, b AS (SELECT head, count(*) FILTER (on_path) AS p, count(*) FILTER (NOT on_path) AS d FROM step WHERE proved GROUP BY head), t AS (SELECT *, 100 * p / sum(p) OVER () AS pp, 100 * d / sum(d) OVER () AS dp FROM b)
SELECT head, p AS path_n, d AS dead_n, round(pp, 6) AS path_pct, round(dp, 6) AS dead_pct, CASE WHEN d = 0 THEN 'inf'::DOUBLE ELSE round(pp / dp, 6) END AS enrichment FROM t""")
prep("sibling_outcomes", A.sibling_outcomes, "SELECT head, count(*) FILTER (on_path) AS wins, count(*) AS total, round(100 * count(*) FILTER (on_path) / count(*), 6) AS win_pct FROM branch GROUP BY head HAVING count(*) >= 5")
prep("have_against_others", A.have_against_others, """, b AS (SELECT bool_or(head IN ('have', 'let')) AS h, bool_and(head IN ('have', 'let')) AS a, bool_or(head IN ('have', 'let') AND on_path) AS hw, bool_or(head NOT IN ('have', 'let') AND on_path) AS ow FROM branch GROUP BY theorem_name, parent_state_id)
SELECT count(*) AS mixed, count(*) FILTER (hw) AS have_wins, count(*) FILTER (ow) AS other_wins FROM b WHERE h AND NOT a""")
for _name, _path, _least in (("goal_delta_path", True, 3), ("goal_delta_all", False, 10)):
    prep(_name, lambda p, a=_path, b=_least: A.goal_delta(p, a, b), f""", d AS (SELECT c.head, coalesce(p.goal_count, 0) - CASE WHEN c.is_proof_complete THEN 0 ELSE c.goal_count END AS d FROM step c LEFT JOIN prep p ON p.theorem_name = c.theorem_name AND p.state_id = c.parent_state_id WHERE c.parent_state_id IS NOT NULL AND {'c.on_path' if _path else 'true'})
SELECT head, count(*) AS n, round(avg(d), 6) AS mean_delta, round(100 * count(*) FILTER (d > 0) / count(*), 6) AS up_pct, round(100 * count(*) FILTER (d < 0) / count(*), 6) AS down_pct, round(100 * count(*) FILTER (d = 0) / count(*), 6) AS same_pct FROM d GROUP BY head HAVING count(*) >= {_least}""")
prep("state_size_by_depth", A.state_size_by_depth, """SELECT depth_from_root, count(*) FILTER (on_path) AS path_n, round(avg(state_size) FILTER (on_path), 6) AS path_mean, median(state_size) FILTER (on_path) AS path_median, count(*) FILTER (NOT on_path) AS dead_n, round(avg(state_size) FILTER (NOT on_path), 6) AS dead_mean,
  median(state_size) FILTER (NOT on_path) AS dead_median, round(avg(state_size) FILTER (on_path) / avg(state_size) FILTER (NOT on_path), 6) AS ratio FROM prep WHERE proved GROUP BY 1""")
prep("top_heads_by_depth", A.top_heads_by_depth, "SELECT * FROM (SELECT depth_from_root, head, count(*) AS n, CAST(row_number() OVER (PARTITION BY depth_from_root ORDER BY count(*) DESC, head) AS INTEGER) AS rank FROM step WHERE proved AND on_path GROUP BY 1, 2) WHERE rank <= 10")
prep("closing_heads_by_depth", lambda p: A.top_heads_by_depth(p, closing=True), "SELECT * FROM (SELECT depth_from_root, head, count(*) AS n, CAST(row_number() OVER (PARTITION BY depth_from_root ORDER BY count(*) DESC, head) AS INTEGER) AS rank FROM step WHERE proved AND on_path AND is_proof_complete GROUP BY 1, 2) WHERE rank <= 10")
prep("closing_heads", A.closing_heads, "SELECT head, count(*) AS n FROM step WHERE on_path AND is_proof_complete GROUP BY head ORDER BY n DESC, head LIMIT 10")
prep("first_step_diversity", A.first_step_diversity, """, b AS (SELECT theorem_name, proved, count(*) AS n, count(DISTINCT head) AS h, avg((head IN ('have', 'let'))::INT) AS f FROM step WHERE depth_from_root = 1 GROUP BY 1, 2), every AS (FROM b UNION ALL SELECT * REPLACE (NULL AS proved) FROM b)
SELECT proved, count(*) AS theorems, round(avg(n), 6) AS mean_n, round(avg(h), 6) AS mean_heads, median(h) AS median_heads, round(quantile_cont(f, 0.25), 6) AS have_q25, round(quantile_cont(f, 0.5), 6) AS have_median, round(quantile_cont(f, 0.75), 6) AS have_q75, round(avg(f), 6) AS mean_have, round(100 * count(*) FILTER (f = 0) / count(*), 6) AS no_have_pct FROM every GROUP BY proved""")
prep("completion_groups", A.completion_groups, ", b AS (SELECT count(*) AS n FROM step WHERE proved AND parent_state_id IS NOT NULL GROUP BY theorem_name, parent_state_id, llm_log_prob) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS nodes, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM b")
prep("log_prob_by_depth", A.log_prob_by_depth, "SELECT depth_from_root, count(*) FILTER (on_path) AS pos_n, round(avg(llm_log_prob) FILTER (on_path), 6) AS pos_mean, count(*) FILTER (NOT on_path) AS neg_n, round(avg(llm_log_prob) FILTER (NOT on_path), 6) AS neg_mean FROM step WHERE proved AND depth_from_root BETWEEN 1 AND 12 GROUP BY 1")
_RANKS = """, rk AS (SELECT *, row_number() OVER (PARTITION BY theorem_name, parent_state_id ORDER BY {} , state_id) AS r FROM branch),
ranks AS (SELECT theorem_name, parent_state_id, min(depth_from_root) AS depth, max(n_siblings) AS n_siblings, min(r) FILTER (on_path) AS rank FROM rk GROUP BY 1, 2)
"""
_LP = _RANKS.format("llm_log_prob DESC")
_SUM = "count(*) AS n, round(avg((rank = 1)::INT), 6) AS rank1, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, round(avg(1 / n_siblings), 6) AS random_rank1 FROM ranks"
prep("sibling_ranks", lambda p: A.sibling_ranks(p).withColumn("rank", F.col("rank").cast("long")), _LP + "SELECT * FROM ranks")
prep("rank_summary", lambda p: A.rank_summary(A.sibling_ranks(p)), _LP + "SELECT " + _SUM)
prep("rank_summary_by_depth", lambda p: A.rank_summary(A.sibling_ranks(p), "depth"), _LP + "SELECT depth, " + _SUM + " GROUP BY depth")
prep("rank_summary_by_siblings", lambda p: A.rank_summary(A.with_sibling_bucket(A.sibling_ranks(p)), "bucket"), _LP + "SELECT CASE WHEN n_siblings <= 3 THEN '2-3' WHEN n_siblings <= 10 THEN '4-10' ELSE '11+' END AS bucket, " + _SUM + " GROUP BY 1")
prep("rank_summary_ebm", lambda p: A.rank_summary(A.sibling_ranks(p, "ebm_score")), _RANKS.format("ebm_score DESC") + "SELECT " + _SUM)
prep("rank_summary_ebm_lower_better", lambda p: A.rank_summary(A.sibling_ranks(p, "ebm_score", False)), _RANKS.format("ebm_score") + "SELECT " + _SUM)
prep("rank_summary_combined", lambda p: A.rank_summary(A.combined_ranks(p)), _RANKS.format("0.5 * llm_log_prob + 0.5 * ebm_score DESC") + "SELECT " + _SUM)
prep("rank_summary_scored", lambda p: A.rank_summary(A.scored_ranks(p)), _RANKS.format("ebm_score") + "SELECT " + _SUM + " r WHERE EXISTS (SELECT 1 FROM branch b WHERE b.theorem_name = r.theorem_name AND b.parent_state_id = r.parent_state_id AND b.on_path AND b.ebm_score <> 0)")
prep("rank_histogram", lambda p: A.rank_histogram(A.sibling_ranks(p)), _LP + "SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n FROM ranks GROUP BY 1 ORDER BY 1 LIMIT 10")
prep("hypotheses_by_depth", A.hypotheses_by_depth, "SELECT depth_from_root, count(*) FILTER (on_path) AS path_n, round(avg(hypotheses) FILTER (on_path), 6) AS path_hypotheses, count(*) FILTER (NOT on_path) AS dead_n, round(avg(hypotheses) FILTER (NOT on_path), 6) AS dead_hypotheses, round(avg(state_size / greatest(goal_count, 1)), 6) AS chars_per_goal FROM step WHERE proved GROUP BY 1")
prep("root_description", A.root_description, "SELECT proved, count(*) AS n, round(avg(state_size), 6) AS mean, round(stddev_samp(state_size), 6) AS std, CAST(min(state_size) AS INTEGER) AS least, quantile_cont(state_size, 0.25) AS q25, quantile_cont(state_size, 0.5) AS q50, quantile_cont(state_size, 0.75) AS q75, CAST(max(state_size) AS INTEGER) AS most, round(avg(hypotheses), 6) AS mean_hypotheses FROM prep WHERE is_root GROUP BY 1")
prep("root_goals", A.root_goals, "SELECT proved, CAST(goal_count AS INTEGER) AS goal_count, count(*) AS n FROM prep WHERE is_root GROUP BY 1, 2")
_USER, _TELLING = "CAST(substr(theorem_name, 5) AS INT)", ["prime p", "Continuous f", "subgroup H", "Finset.card s", "Matrix n", "triangle ABC", "∑ i, f i", "ℝ → ℚ", "x = y", "prime p, Matrix n", None, "deriv f : ℝ"]
prep("topic_rates", lambda p: A.topic_rates(p.withColumn("state_pp", F.element_at(F.array(*[F.lit(x) for x in _TELLING]), F.expr(f"{_USER} % {len(_TELLING)} + 1")))), f""", t AS (SELECT unnest(([['number_theory'], ['analysis'], ['abstract_algebra'], ['combinatorics'], ['linear_algebra'], ['geometry'], ['series_sums'], ['real_arithmetic'], ['other'], ['number_theory', 'linear_algebra'], ['other'], ['analysis']])[{_USER} % {len(_TELLING)} + 1]) AS topic, proved FROM prep WHERE is_root)
SELECT topic, count(*) AS total, count(*) FILTER (proved) AS solved, round(100 * count(*) FILTER (proved) / count(*), 6) AS rate FROM t GROUP BY topic""")
prep("theorem_rollup", lambda p: A.rollup(p).withColumn("have_frac", A.r6(F.col("have_frac"))), "SELECT * REPLACE (round(have_frac, 6) AS have_frac) FROM roll")
prep("rollup_summary", A.rollup_summary, "SELECT proved, count(*) AS theorems, round(avg(nodes), 6) AS mean_nodes, median(nodes) AS median_nodes, round(avg(max_depth), 6) AS mean_depth, round(avg(have_frac), 6) AS mean_have, round(sum(positives) / sum(nodes), 6) AS efficiency FROM roll GROUP BY proved")
prep("dead_have_fraction", A.dead_have_fraction, ", b AS (SELECT avg((head = 'have')::INT) AS f FROM step WHERE proved AND NOT on_path GROUP BY theorem_name) SELECT count(*) AS theorems, round(avg(f), 6) AS mean_fraction FROM b")
prep("fanout", A.fanout, ", b AS (SELECT count(*) AS children FROM prep WHERE parent_state_id IS NOT NULL GROUP BY theorem_name, parent_state_id) SELECT children, count(*) AS parents FROM b WHERE children >= 2 GROUP BY 1 ORDER BY 1 LIMIT 15")
prep("failure_modes", A.failure_modes, "SELECT CASE WHEN steps = 0 OR max_depth <= 2 THEN 'shallow_exhaust' WHEN have_frac > 0.7 THEN 'have_spiral' WHEN heads <= 3 THEN 'low_diversity' ELSE 'deep_exhaust' END AS mode, count(*) AS n FROM roll WHERE NOT proved GROUP BY 1")
prep("failed_depths", A.failed_depths, "SELECT max_depth, count(*) AS n FROM roll WHERE NOT proved GROUP BY 1")
prep("near_misses", lambda p: A.near_misses(p, 4), "SELECT theorem_name, max_q, max_depth, nodes FROM roll WHERE NOT proved AND (max_q > 0 OR max_depth >= 4) ORDER BY max_q DESC, max_depth DESC, theorem_name LIMIT 25")
# the derived steps have no exact? of their own: every third exact step becomes one
_SEARCH = lambda p: p.withColumn("head", F.when((F.col("head") == "exact") & (F.col("state_id") % 3 != 0), "exact?").otherwise(F.col("head")))
prep("training_signal", lambda p: A.training_signal(_SEARCH(p)), """, x AS (SELECT *, head = 'exact' AND state_id % 3 <> 0 AS ex, (state_size + length(tactic_applied)) / 3.5 AS tok, parent_state_id IS NOT NULL AND EXISTS (SELECT 1 FROM step o WHERE o.theorem_name = s.theorem_name AND o.parent_state_id = s.parent_state_id AND o.on_path) AS beside FROM step s WHERE proved),
q AS (SELECT count(*) AS n FROM prep WHERE is_proof_complete GROUP BY theorem_name)
SELECT count(*) FILTER (on_path) AS positives, count(*) FILTER (NOT on_path AND beside) AS hard_negatives, count(*) FILTER (NOT on_path AND NOT beside) AS easy_negatives, count(*) FILTER (on_path AND ex) AS exact_search, count(*) FILTER (on_path AND ex AND is_proof_complete) AS exact_search_closes,
  round(quantile_cont(tok, 0.95) FILTER (on_path), 6) AS tokens_p95, count(*) FILTER (on_path AND tok > 2048) AS over_2048, count(*) FILTER (on_path AND tok > 4096) AS over_4096, (SELECT count(*) FILTER (n = 1) FROM q) AS single_proof, (SELECT count(*) FILTER (n > 1) FROM q) AS multi_proof FROM x""")
prep("positive_depths", A.positive_depths, "SELECT depth_from_root, count(*) AS n FROM step WHERE proved AND on_path GROUP BY 1")
prep("preference_pairs", A.preference_pairs, """SELECT count(*) AS pairs, count(*) FILTER (a.head <> 'have' AND b.head = 'have') AS other_beats_have, count(*) FILTER (a.head = 'have' AND b.head <> 'have') AS have_beats_other FROM branch a JOIN branch b ON a.theorem_name = b.theorem_name AND a.parent_state_id = b.parent_state_id AND a.on_path AND NOT b.on_path""")
prep("score_stats", A.score_stats, f""", x AS (SELECT *, CASE WHEN ebm_score <> 0 THEN ebm_score END AS nz, tactic_applied IN ({', '.join(repr(x) for x in A.PROBES)}) AS probe FROM prep)
SELECT theorem_name, count(*) AS nodes, count(*) FILTER (is_root) AS roots, count(*) FILTER (NOT is_root AND probe) AS probe_nodes, count(*) FILTER (NOT is_root AND NOT probe) AS model_nodes, count(*) FILTER (ebm_score = 0) AS zero_ebm, round(median(nz), 6) AS ebm_median, round(sum(nz::DECIMAL(28,9))::DOUBLE / count(nz), 6) AS ebm_mean, round(min(nz), 6) AS ebm_min, round(max(nz), 6) AS ebm_max, round(median(llm_log_prob), 6) AS lp_median, round(sum(llm_log_prob::DECIMAL(28,9))::DOUBLE / count(llm_log_prob), 6) AS lp_mean, round(min(llm_log_prob), 6) AS lp_min, round(max(llm_log_prob), 6) AS lp_max FROM x GROUP BY ROLLUP (theorem_name)""")
prep("theorem_summary", A.theorem_summary, "SELECT theorem_name, count(*) AS nodes, count(*) FILTER (on_path) AS positive, count(*) FILTER (NOT on_path) AS negative, max(depth_from_root) AS max_depth, round(min(llm_log_prob), 6) AS lp_min, round(max(llm_log_prob), 6) AS lp_max, coalesce(string_agg(tactic_applied, ' → ' ORDER BY depth_from_root, state_id) FILTER (on_path AND NOT is_root), '') AS proof FROM prep GROUP BY 1")
prep("depth_counts", A.depth_counts, ", b AS (SELECT depth_from_root, count(*) AS n FROM prep GROUP BY 1) SELECT depth_from_root, n, round(lead(n) OVER (ORDER BY depth_from_root) / n, 6) AS branching FROM b")
prep("proof_multiplicity", A.proof_multiplicity, ", b AS (SELECT count(*) AS n FROM prep WHERE is_proof_complete GROUP BY theorem_name) SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS bucket, count(*) AS theorems FROM b GROUP BY 1")
_TTP = ", o AS (SELECT *, row_number() OVER (PARTITION BY theorem_name ORDER BY state_id) - 1 AS pos FROM prep), ttp AS (SELECT theorem_name, min(pos) FILTER (is_proof_complete) AS position, count(*) AS n FROM o GROUP BY 1 HAVING min(pos) FILTER (is_proof_complete) IS NOT NULL AND count(*) > 1)\n"
prep("time_to_proof", A.time_to_proof, _TTP + "SELECT theorem_name, position, n, round(position / n, 6) AS ratio FROM ttp")
prep("time_to_proof_buckets", A.time_to_proof_buckets, _TTP + "SELECT count(*) AS n, count(*) FILTER (position / n < 0.1) AS below_10, count(*) FILTER (position / n < 0.25) AS below_25, count(*) FILTER (position / n < 0.5) AS below_50, count(*) FILTER (position / n >= 0.75) AS from_75 FROM ttp")
_DIST = "count({0}) AS n, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.75), 6) AS p75, round(min({0}), 6) AS least, round(max({0}), 6) AS most"
prep("time_to_proof_spread", A.time_to_proof_spread, _TTP + ", r AS (SELECT position, round(position / n, 6) AS ratio FROM ttp) SELECT " + _DIST.format("ratio") + ", quantile_cont(position, 0.5) AS median_position, quantile_cont(position, 0.9) AS p90_position FROM r")
prep("log_prob_distribution", A.log_prob_distribution, "SELECT on_path, " + _DIST.format("llm_log_prob") + " FROM step WHERE proved GROUP BY on_path")
prep("tactic_bigrams", A.bigrams, ", b AS (SELECT head AS a, lead(head) OVER (PARTITION BY theorem_name ORDER BY depth_from_root, state_id) AS b FROM step WHERE on_path) SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 20")
prep("path_strings", A.path_strings, "SELECT theorem_name, string_agg('d' || depth_from_root || ':' || head || '(' || state_size || ')', ' → ' ORDER BY depth_from_root, state_id) AS path FROM prep WHERE on_path GROUP BY 1")
prep("nodes_per_depth", A.nodes_per_depth, "SELECT proved, count(*) AS n, round(avg(nodes / nullif(max_depth, 0)), 6) AS nodes_per_depth FROM roll GROUP BY proved")
_OLD = ["rw [le_div_iff]", "rw [div_le_div_iff]", "simp [add_left_neg]", "rw [∑ i in S, f i]", "exact nat.succ_pos x", "split", "push_cast at h", "norm_num", "exact_mod_cast h", "rw [le_div_iff₀]", "simp [true_and_iff] ; norm_cast"]
prep("pattern_hits", lambda p: A.pattern_hits(p.withColumn("tactic_applied", F.element_at(F.array(*[F.lit(x) for x in _OLD]), F.expr(f"CAST(state_id % {len(_OLD)} AS INT) + 1")))), f""", old AS (SELECT on_path, ({_OLD!r})[state_id % {len(_OLD)} + 1] AS tactic, unnest(([['le_div_iff (missing ₀ suffix)'], ['div_le_div_iff (missing ₀ suffix)'], ['add_left_neg (renamed to neg_add_cancel)'], ['old BigOperators notation (∑ x in S)'], ['old Nat namespace (nat. → Nat.)'], ['split (context: may need constructor in Lean 4)'], ['push_cast (check compatibility)'], [],
  ['exact_mod_cast (may be deprecated)'], [], ['true_and_iff (renamed to true_and)', 'norm_cast (check compatibility)']])[state_id % {len(_OLD)} + 1]) AS pattern FROM step)
SELECT pattern, on_path, count(*) AS n, list_sort(list(DISTINCT tactic))[1:3] AS examples FROM old GROUP BY 1, 2""")
# steps that name lemmas in every way, and things that are none, dealt by state; the names expected beside them
_NAMING = ["rw [← foo_bar, Nat.succ_le]", "simp only [↑Int.cast_one, h]", "exact fun x => hx", "exact mul_comm", "simp[foo_bar] ; exact Nat.succ_le", "rw [fun y => z, ←↑ab_cd]", "norm_num", "exact  ↓Set.mem_iff,foo_bar", "intro x"]
_NAMES = [["foo_bar", "Nat.succ_le"], ["Int.cast_one"], ["fun"], ["mul_comm"], ["foo_bar", "Nat.succ_le"], ["ab_cd"], [], ["Set.mem_iff", "foo_bar"], []]
_naming = lambda p: p.withColumn("tactic_applied", F.when(F.col("is_root"), "").otherwise(F.element_at(F.array(*[F.lit(x) for x in _NAMING]), F.expr(f"CAST(state_id % {len(_NAMING)} AS INT) + 1"))))
_REFS = f", ref AS (SELECT on_path, theorem_name, state_id, ({_NAMING!r})[state_id % {len(_NAMING)} + 1] AS tactic, unnest(({_NAMES!r})[state_id % {len(_NAMING)} + 1]) AS lemma FROM step)\n"
prep("lemma_references", lambda p: A.lemma_references(_naming(p)), _REFS + "SELECT lemma, count(*) AS n, count(*) FILTER (on_path) AS path_n FROM ref GROUP BY 1 ORDER BY n DESC, lemma LIMIT 50")
prep("lemma_examples", lambda p: A.lemma_examples(_naming(p)), _REFS + "SELECT * FROM (SELECT lemma, theorem_name, state_id, tactic, CAST(row_number() OVER (PARTITION BY lemma ORDER BY theorem_name, state_id) AS INTEGER) AS place FROM ref) WHERE place <= 2")
prep("head_profile", A.head_profile, ", b AS (SELECT count(*) AS n FROM step GROUP BY head), c AS (SELECT n, n / sum(n) OVER () AS s FROM b) SELECT CAST(sum(n) AS BIGINT) AS steps, count(*) AS heads, round(sum(-s * log2(s)), 6) AS entropy_bits FROM c")
prep("depth_buckets", A.depth_buckets, ", b AS (SELECT max_depth, count(*) AS n, count(*) FILTER (proved) AS proved FROM roll GROUP BY 1) SELECT max_depth, n, proved, round(100 * sum(n) OVER (ORDER BY max_depth) / sum(n) OVER (), 6) AS cumulative_pct, round(100 * proved / n, 6) AS rate FROM b")
prep("eval_rollup", A.eval_rollup, "SELECT theorem_name, bool_or(is_proof_complete) AS proved, count(*) AS nodes, max(depth_from_root) AS max_depth, min(depth_from_root) FILTER (is_proof_complete) AS proof_depth, (max(timestamp_ms) - min(timestamp_ms)) / 1000 AS time_secs FROM prep GROUP BY 1")
prep("eval_totals", A.eval_totals, ", b AS (SELECT bool_or(is_proof_complete) AS proved, count(*) AS nodes, (max(timestamp_ms) - min(timestamp_ms)) / 1000 AS t FROM prep GROUP BY theorem_name) SELECT count(*) FILTER (proved) AS solved, count(*) AS total, round_even(count(*) FILTER (proved) / count(*), 4) AS rate, round_even(avg(nodes), 1) AS avg_nodes, round(avg(t), 6) AS avg_time, round(coalesce(median(t), 0), 6) AS median_time FROM b")
traj("tree_render", lambda t: G.rendered(t).select("theorem_name", "tree"), """, kid AS (SELECT *, llm_log_prob + ebm_score AS score, row_number() OVER (PARTITION BY theorem_name, parent_state_id ORDER BY llm_log_prob + ebm_score DESC, state_id) AS r FROM traj),
walk AS (SELECT theorem_name, state_id, [r] AS place, 0 AS level FROM kid WHERE parent_state_id IS NULL UNION ALL SELECT k.theorem_name, k.state_id, list_append(w.place, k.r), w.level + 1 FROM walk w JOIN kid k ON k.theorem_name = w.theorem_name AND k.parent_state_id = w.state_id)
SELECT w.theorem_name, string_agg(repeat('  ', w.level) || CASE WHEN k.is_proof_complete THEN '✓' WHEN k.label = 'positive' THEN '★' ELSE '✗' END || ' ' || CASE WHEN k.tactic_applied = '' THEN '(root)' ELSE k.tactic_applied END || ' [' || printf('%.3f', k.score) || ']', chr(10) ORDER BY w.place) AS tree
FROM walk w JOIN kid k ON k.theorem_name = w.theorem_name AND k.state_id = w.state_id GROUP BY 1""")
