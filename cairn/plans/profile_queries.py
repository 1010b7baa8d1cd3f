"""Profiles, stratified samples and statistics of pairs over the test tables, with SQL to compare them with."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import profile as R
from . import traces

QUERIES, ORACLE_SQL = {}, {}


def pairs(name, op, sql=None):
    """Over the derived steps as pairs (theorem, state, tactic, depth); a theorem keeps those down to a depth that its number tells."""
    QUERIES[name] = lambda spark, sf_dir: op(traces.raw(spark, sf_dir).filter("tactic_applied <> '' AND depth_from_root <= CAST(substr(theorem_name, 5) AS INT) % 6").select(F.col("theorem_name").alias("theorem"), F.col("state_pp").alias("state"), F.col("tactic_applied").alias("tactic"), F.col("depth_from_root").alias("depth")))
    if sql:
        ORACLE_SQL[name] = traces.SQL + ", pair AS (SELECT theorem_name AS theorem, state_pp AS state, tactic_applied AS tactic, depth_from_root AS depth, head FROM step WHERE depth_from_root <= CAST(substr(theorem_name, 5) AS INT) % 6)" + sql


def vectors(name, op, sql=None):
    QUERIES[name] = lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("positive", F.col("label") < 5))
    if sql:
        ORACLE_SQL[name] = sql


_BUCKETS = """, deep AS (SELECT theorem, max(depth) AS d FROM pair GROUP BY 1), b AS (SELECT theorem, CASE WHEN d >= 7 THEN 4 WHEN d >= 4 THEN 3 WHEN d >= 2 THEN 2 WHEN d >= 1 THEN 1 ELSE 0 END AS bucket FROM deep),
h AS (SELECT bucket, head, count(*) AS n FROM pair JOIN b USING (theorem) GROUP BY 1, 2), m AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS steps, count(*) AS heads, list(head ORDER BY n DESC, head)[1] AS top_head, max(n) AS most FROM h GROUP BY 1),
e AS (SELECT bucket, -sum(n / steps * log2(n / steps)) AS bits FROM h JOIN m USING (bucket) GROUP BY 1), t AS (SELECT bucket, count(*) AS theorems FROM b GROUP BY 1)
"""
pairs("profile_by_depth", R.by_depth, _BUCKETS + """SELECT bucket, theorems, round(100 * theorems / sum(theorems) OVER (), 6) AS pct, round(100 * sum(theorems) OVER (ORDER BY bucket) / sum(theorems) OVER (), 6) AS cumulative_pct, steps, heads, round(abs(bits), 6) AS entropy_bits, top_head, round(100 * most / steps, 6) AS top_pct
FROM t JOIN m USING (bucket) JOIN e USING (bucket)""")
_SPREAD = "round(avg({0}), 6) AS {1}_mean, max({0}) AS {1}_max, round(quantile_cont({0}, 0.5), 6) AS {1}_median, round(quantile_cont({0}, 0.9), 6) AS {1}_p90, round(quantile_cont({0}, 0.95), 6) AS {1}_p95, round(quantile_cont({0}, 0.99), 6) AS {1}_p99"
pairs("profile_sizes", R.sizes, ", per AS (SELECT count(*) AS n FROM pair GROUP BY theorem), a AS (SELECT " + _SPREAD.format("n", "steps") + " FROM per), z AS (SELECT " + _SPREAD.format("length(state)", "state") + ", " + _SPREAD.format("length(tactic)", "tactic") + " FROM pair) SELECT * FROM a, z")
# the derived goals claim nothing: by state they get every kind of claim
_CLAIMS = ["⊢ a ≤ b", "⊢ ∀ x, x = x", "⊢ ∃ y, y < 2", "⊢ p ↔ q = r", "⊢ 3 ∣ n", "⊢ f x = 2", "⊢ x ≠ y", "h : a = b\n⊢ Continuous f", "⊢ x > 1\n\n⊢ y = 2", "no goal"]
_KINDS = ["inequality", "universal", "existential", "iff", "divisibility", "equality", "other", "other", "inequality", "other"]
pairs("profile_goals", lambda p: R.goal_mix(p.withColumn("state", F.element_at(F.array(*[F.lit(x) for x in _CLAIMS]), F.pmod(F.length("state") + F.col("depth"), F.lit(len(_CLAIMS))).cast("int") + 1)), "state"),
      f" SELECT type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT ({_KINDS!r})[(length(state) + depth) % {len(_CLAIMS)} + 1] AS type FROM pair) GROUP BY 1")
pairs("profile_lemmas", lambda p: R.lemma_counts(p.withColumn("tactic", F.concat("tactic", F.lit(" [Nat."), F.substring("theorem", 5, 1), F.lit(", h.le.symm]")))), " SELECT * FROM (SELECT 'Nat.' || substr(theorem, 5, 1) AS lemma, count(*) AS n FROM pair GROUP BY 1 UNION ALL SELECT 'h.le.symm', count(*) FROM pair) ORDER BY n DESC, lemma LIMIT 20")
# quotas by largest remainders over the entropies, in two rounds: one bucket is short
pairs("stratified_theorems", lambda p: R.stratified_theorems(p, 110), _BUCKETS.rstrip() + """, w AS (SELECT bucket, theorems, round(abs(bits), 6) AS bits FROM t JOIN e USING (bucket)), x AS (SELECT *, least(110, (SELECT sum(theorems) FROM t)) * bits / sum(bits) OVER () AS exact FROM w),
r AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, bucket) <= least(110, (SELECT sum(theorems) FROM t)) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS seats FROM x),
s1 AS (SELECT *, least(seats, theorems) AS got FROM r), left1 AS (SELECT least(110, (SELECT sum(theorems) FROM t)) - sum(got) AS n FROM s1),
x2 AS (SELECT *, (SELECT n FROM left1) * bits / sum(bits) OVER () AS exact2 FROM s1 WHERE got < theorems),
r2 AS (SELECT *, floor(exact2) + CASE WHEN row_number() OVER (ORDER BY floor(exact2) - exact2, bucket) <= (SELECT n FROM left1) - sum(floor(exact2)) OVER () THEN 1 ELSE 0 END AS more FROM x2),
q AS (SELECT s1.bucket, s1.got + coalesce(r2.more, 0) AS quota FROM s1 LEFT JOIN r2 USING (bucket))
SELECT theorem, bucket FROM (SELECT theorem, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(theorem), theorem) AS k FROM b) JOIN q USING (bucket) WHERE k <= quota""")
vectors("pair_moments", lambda v: M.pair_moments(v.withColumn("g", F.expr("vec_id % 7")), "g", "positive"), """WITH v AS (SELECT vec_id, vec_id % 7 AS g, label < 5 AS p, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT CASE WHEN a.p AND b.p THEN 'positive' WHEN a.p OR b.p THEN 'mixed' ELSE 'negative' END AS kind, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.g = b.g AND a.vec_id < b.vec_id)
SELECT kind, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM x GROUP BY 1""")
vectors("drawn_similarities", lambda v: M.drawn_similarities(v, "vec_id"))
vectors("sampled_accuracy", lambda v: M.sampled_accuracy(v.withColumn("s", F.col("embedding")[0].cast("double")), "s", "positive"))
