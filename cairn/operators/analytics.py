"""Analyses of prepared trajectories (:func:`prepare`): every function takes and returns a frame.

Ties are broken by name or id throughout, and figures that sum floating-point numbers are given
to six decimals, as their order of summation is open.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranks, topk
from .tree import siblings, theorem

HAVE_LET = ("have", "let")
#: fixed values: tactics that the search tries by itself
PROBES = ["simp", "ring", "omega", "norm_num", "decide", "trivial", "rfl", "tauto", "linarith", "push_neg", "contradiction", "exfalso", "constructor", "left", "right", "ext", "simp_all"]


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def prepare(traj: DataFrame) -> DataFrame:
    """Adds is_root, head, on_path, proved, state_size, goal_count, hypotheses.

    on_path goes by key: all rows of a (theorem, state) of which one is positive.
    """
    tactic = F.coalesce("tactic_applied", F.lit(""))
    # rows dealt by theorem serve both windows, if the wider one comes first
    known = traj.withColumn("proved", F.max("is_proof_complete").over(theorem()))
    known = known.withColumn("on_path", F.max(F.col("label") == "positive").over(W.partitionBy("theorem_name", "state_id")))
    return known.select(
        *traj.columns, (tactic == "").alias("is_root"), F.when(tactic == "", "(root)").otherwise(T.tactic_head(tactic)).alias("head"), "on_path", "proved",
        F.coalesce(F.length("state_pp"), F.lit(0)).alias("state_size"), T.count_goals(F.col("state_pp")).alias("goal_count"), T.count_hypotheses(F.col("state_pp")).alias("hypotheses"))


def steps(p: DataFrame) -> DataFrame:
    return p.filter("not is_root")


def summary(traj: DataFrame) -> DataFrame:
    out = traj.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"),
        F.count_distinct("theorem_name").alias("theorems"), F.count_distinct(F.when(F.col("is_proof_complete"), F.col("theorem_name"))).alias("proved"))
    return out.select("*", (F.col("n_rows") - F.col("positive") - F.col("negative")).alias("unknown"), r6(100 * F.col("proved") / F.col("theorems")).alias("prove_rate"))


def head_distribution(p: DataFrame) -> DataFrame:
    """Heads on paths and on dead branches of proved theorems; enrichment is infinite for heads without dead ones."""
    by = steps(p).filter("proved").groupBy("head").agg(F.count_if("on_path").alias("path_n"), F.count_if(~F.col("on_path")).alias("dead_n"))
    everything = by.agg(F.sum("path_n").alias("pt"), F.sum("dead_n").alias("dt"))
    out = by.join(F.broadcast(everything))  # one row
    path, dead = F.try_divide(100 * F.col("path_n"), F.col("pt")), F.try_divide(100 * F.col("dead_n"), F.col("dt"))
    return out.select("head", "path_n", "dead_n", r6(path).alias("path_pct"), r6(dead).alias("dead_pct"), F.when(dead == 0, float("inf")).otherwise(r6(path / dead)).alias("enrichment"))


def branches(p: DataFrame) -> DataFrame:
    """Steps that have siblings, one of them on the path: adds n_siblings, n_on_path."""
    rows = steps(p).filter("parent_state_id is not null")
    rows = rows.withColumn("n_siblings", F.count("*").over(siblings())).withColumn("n_on_path", F.sum(F.col("on_path").cast("int")).over(siblings()))
    return rows.filter("n_siblings >= 2 AND n_on_path >= 1")


def sibling_outcomes(p: DataFrame, least: int = 5) -> DataFrame:
    by = branches(p).groupBy("head").agg(F.count_if("on_path").alias("wins"), F.count("*").alias("total")).filter(F.col("total") >= least)
    return by.select("*", r6(100 * F.col("wins") / F.col("total")).alias("win_pct"))


def have_against_others(p: DataFrame) -> DataFrame:
    have = F.col("head").isin(*HAVE_LET)
    by = branches(p).groupBy("theorem_name", "parent_state_id").agg(F.max(have).alias("h"), F.min(have).alias("all_h"), F.max(have & F.col("on_path")).alias("hw"), F.max(~have & F.col("on_path")).alias("ow"))
    return by.filter("h AND NOT all_h").agg(F.count("*").alias("mixed"), F.count_if("hw").alias("have_wins"), F.count_if("ow").alias("other_wins"))


def goal_delta(p: DataFrame, path_only: bool = True, least: int = 3) -> DataFrame:
    """By how many goals a step has fewer than its parent, by head; a complete state has none, an unknown parent counts as 0.

    Steps without a parent are left out. up_pct is the share of steps that close goals.
    """
    parent = p.select(F.col("theorem_name").alias("t"), F.col("state_id").alias("s"), F.col("goal_count").alias("pg"))
    rows = steps(p).filter("parent_state_id is not null").filter("on_path" if path_only else "true")
    rows = rows.join(parent, (F.col("theorem_name") == F.col("t")) & (F.col("parent_state_id") == F.col("s")), "left")
    d = F.coalesce("pg", F.lit(0)) - F.when(F.col("is_proof_complete"), 0).otherwise(F.col("goal_count"))
    rows = rows.select("head", d.alias("d"))
    share = lambda c: r6(100 * F.count_if(c) / F.count("*"))
    return rows.groupBy("head").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_delta"), share(F.col("d") > 0).alias("up_pct"), share(F.col("d") < 0).alias("down_pct"), share(F.col("d") == 0).alias("same_pct")).filter(F.col("n") >= least)


def state_size_by_depth(p: DataFrame) -> DataFrame:
    on, off = (F.when(F.col("on_path") == v, F.col("state_size")) for v in (True, False))
    rows = p.filter("proved").select("depth_from_root", on.alias("on"), off.alias("off"))
    by = rows.groupBy("depth_from_root").agg(F.count("on").alias("path_n"), F.avg("on").alias("a"), F.count("off").alias("dead_n"), F.avg("off").alias("b"))
    by = ranks.beside(by, ranks.percentiles(rows, {"path_median": ("on", ranks.linear(0.5)), "dead_median": ("off", ranks.linear(0.5))}, "depth_from_root"), "depth_from_root")
    return by.select("depth_from_root", "path_n", r6(F.col("a")).alias("path_mean"), "path_median", "dead_n", r6(F.col("b")).alias("dead_mean"), "dead_median", r6(F.try_divide(F.col("a"), F.col("b"))).alias("ratio"))


def top_heads_by_depth(p: DataFrame, k: int = 10, closing: bool = False) -> DataFrame:
    """The commonest heads at each depth on paths of proved theorems; of the steps that complete a proof, if ``closing``."""
    rows = steps(p).filter("proved AND on_path").filter("is_proof_complete" if closing else "true")
    by = rows.groupBy("depth_from_root", "head").agg(F.count("*").alias("n")).withColumn("least", -F.col("n"))
    return topk.first_k(by, ["depth_from_root"], ["least", "head"], k, "rank").drop("least")


def closing_heads(p: DataFrame, k: int = 10) -> DataFrame:
    return steps(p).filter("proved AND on_path AND is_proof_complete").groupBy("head").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "head").limit(k)


def first_step_diversity(p: DataFrame) -> DataFrame:
    """By outcome, and over all (proved null): how many first steps theorems have, how many heads among them, what share is have or let."""
    by = p.filter("depth_from_root = 1 AND NOT is_root").groupBy("theorem_name", "proved").agg(F.count("*").alias("n"), F.count_distinct("head").alias("heads"), F.avg(F.col("head").isin(*HAVE_LET).cast("int")).alias("have"))
    each = by.select(F.explode(F.array(F.col("proved"), F.lit(None).cast("boolean"))).alias("proved"), "n", "heads", "have")
    stats = each.groupBy("proved").agg(
        F.count("*").alias("theorems"), r6(F.avg("n")).alias("mean_n"), r6(F.avg("heads")).alias("mean_heads"), r6(F.avg("have")).alias("mean_have"), r6(100 * F.count_if(F.col("have") == 0) / F.count("*")).alias("no_have_pct"))
    spread = ranks.percentiles(each, {"median_heads": ("heads", ranks.linear(0.5)), "have_q25": ("have", ranks.linear(0.25)), "have_median": ("have", ranks.linear(0.5)), "have_q75": ("have", ranks.linear(0.75))}, "proved")
    return ranks.beside(stats, spread, "proved").withColumns({c: r6(F.col(c)) for c in ("have_q25", "have_median", "have_q75")})


def completion_groups(p: DataFrame) -> DataFrame:
    """Siblings of one log probability come from one completion: how many groups, of how many nodes, and how large, in proved theorems."""
    by = steps(p).filter("proved AND parent_state_id IS NOT NULL").groupBy("theorem_name", "parent_state_id", "llm_log_prob").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), r6(F.coalesce(F.avg("n"), F.lit(0.0))).alias("mean_size"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"))


def log_prob_by_depth(p: DataFrame, deepest: int = 12) -> DataFrame:
    on, off = (F.when(F.col("on_path") == v, F.col("llm_log_prob")) for v in (True, False))
    return steps(p).filter("proved").filter(F.col("depth_from_root").between(1, deepest)).groupBy("depth_from_root").agg(F.count(on).alias("pos_n"), r6(F.avg(on)).alias("pos_mean"), F.count(off).alias("neg_n"), r6(F.avg(off)).alias("neg_mean"))


def sibling_ranks(p: DataFrame, score: str = "llm_log_prob", higher_better: bool = True) -> DataFrame:
    """Of each branch the rank of the first child on the path: theorem, parent, depth, n_siblings, rank."""
    order = F.desc(score) if higher_better else F.asc(score)
    ranked = branches(p).withColumn("r", F.row_number().over(siblings().orderBy(order, "state_id")))
    return ranked.groupBy("theorem_name", "parent_state_id").agg(F.min("depth_from_root").alias("depth"), F.first("n_siblings").alias("n_siblings"), F.min(F.when(F.col("on_path"), F.col("r"))).alias("rank"))


def combined_ranks(p: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """As :func:`sibling_ranks`, by alpha times the log probability and beta times the score together, higher being better."""
    return sibling_ranks(p.withColumn("combined", alpha * F.col("llm_log_prob") + beta * F.col("ebm_score")), "combined")


def scored_ranks(p: DataFrame, score: str = "ebm_score", higher_better: bool = False) -> DataFrame:
    """As :func:`sibling_ranks`, over the branches whose on-path child has a score at all: states that weren't scored hold 0."""
    scored = p.filter(F.col("on_path") & (F.col(score) != 0)).select("theorem_name", "parent_state_id").distinct()
    return sibling_ranks(p, score, higher_better).join(scored, ["theorem_name", "parent_state_id"], "left_semi")


def rank_summary(ranked: DataFrame, *by: str) -> DataFrame:
    stats = ranked.groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg((F.col("rank") == 1).cast("int"))).alias("rank1"), r6(F.avg("rank")).alias("mean_rank"), r6(F.avg(1 / F.col("n_siblings"))).alias("random_rank1"))
    return ranks.beside(stats, ranks.percentiles(ranked, {"median_rank": ("rank", ranks.linear(0.5))}, *by), *by).select(*by, "n", "rank1", "mean_rank", "median_rank", "random_rank1")


def with_sibling_bucket(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("bucket", F.when(F.col("n_siblings") <= 3, "2-3").when(F.col("n_siblings") <= 10, "4-10").otherwise("11+"))


def rank_histogram(ranks: DataFrame, k: int = 10) -> DataFrame:
    return ranks.groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").limit(k)


def hypotheses_by_depth(p: DataFrame) -> DataFrame:
    """Mean hypotheses of steps of proved theorems, on paths and off, and characters by goal."""
    on, off = (F.when(F.col("on_path") == v, F.col("hypotheses")) for v in (True, False))
    per_goal = F.col("state_size") / F.greatest("goal_count", F.lit(1))
    return steps(p).filter("proved").groupBy("depth_from_root").agg(F.count(on).alias("path_n"), r6(F.avg(on)).alias("path_hypotheses"), F.count(off).alias("dead_n"), r6(F.avg(off)).alias("dead_hypotheses"), r6(F.avg(per_goal)).alias("chars_per_goal"))


def root_description(p: DataFrame) -> DataFrame:
    roots = p.filter("is_root").select("proved", "state_size", "hypotheses")
    stats = roots.groupBy("proved").agg(F.count("*").alias("n"), r6(F.avg("state_size")).alias("mean"), r6(F.stddev_samp("state_size")).alias("std"), F.min("state_size").alias("least"), F.max("state_size").alias("most"), r6(F.avg("hypotheses")).alias("mean_hypotheses"))
    spread = {f"q{int(100 * q)}": ("state_size", ranks.linear(q)) for q in (0.25, 0.5, 0.75)}
    return ranks.beside(stats, ranks.percentiles(roots, spread, "proved"), "proved")


def root_goals(p: DataFrame) -> DataFrame:
    """How many roots have so many goals, by outcome."""
    return p.filter("is_root").groupBy("proved", "goal_count").agg(F.count("*").alias("n"))


def topic_rates(p: DataFrame) -> DataFrame:
    by = p.filter("is_root").select("proved", F.explode(T.topics(F.col("state_pp"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("total"), F.count_if("proved").alias("solved"))
    return by.select("*", r6(100 * F.col("solved") / F.col("total")).alias("rate"))


def rollup(p: DataFrame) -> DataFrame:
    """A row for each theorem; have_frac over its steps (0 of none)."""
    step = ~F.col("is_root")
    return p.groupBy("theorem_name").agg(
        F.max("proved").alias("proved"), F.count("*").alias("nodes"), F.count_if("on_path").alias("positives"), F.max("depth_from_root").alias("max_depth"),
        F.count_if(step).alias("steps"), F.coalesce(F.try_divide(F.count_if(step & (F.col("head") == "have")), F.count_if(step)), F.lit(0.0)).alias("have_frac"),
        F.count_distinct(F.when(step, F.col("head"))).alias("heads"), F.max("q_value").alias("max_q"))


def rollup_summary(p: DataFrame) -> DataFrame:
    by = rollup(p)
    stats = by.groupBy("proved").agg(F.count("*").alias("theorems"), r6(F.avg("nodes")).alias("mean_nodes"), r6(F.avg("max_depth")).alias("mean_depth"), r6(F.avg("have_frac")).alias("mean_have"), r6(F.sum("positives") / F.sum("nodes")).alias("efficiency"))
    return ranks.beside(stats, ranks.percentiles(by, {"median_nodes": ("nodes", ranks.linear(0.5))}, "proved"), "proved")


def dead_have_fraction(p: DataFrame) -> DataFrame:
    by = steps(p).filter("proved AND NOT on_path").groupBy("theorem_name").agg(F.avg((F.col("head") == "have").cast("int")).alias("f"))
    return by.agg(F.count("*").alias("theorems"), r6(F.avg("f")).alias("mean_fraction"))


def fanout(p: DataFrame, k: int = 15) -> DataFrame:
    by = p.filter("parent_state_id is not null").groupBy("theorem_name", "parent_state_id").agg(F.count("*").alias("children"))
    return by.filter("children >= 2").groupBy("children").agg(F.count("*").alias("parents")).orderBy("children").limit(k)


def failure_modes(p: DataFrame) -> DataFrame:
    mode = (F.when((F.col("steps") == 0) | (F.col("max_depth") <= 2), "shallow_exhaust").when(F.col("have_frac") > 0.7, "have_spiral").when(F.col("heads") <= 3, "low_diversity").otherwise("deep_exhaust"))
    return rollup(p).filter("not proved").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def failed_depths(p: DataFrame) -> DataFrame:
    return rollup(p).filter("not proved").groupBy("max_depth").agg(F.count("*").alias("n"))


def near_misses(p: DataFrame, depth: int = 8, k: int = 25) -> DataFrame:
    return rollup(p).filter("not proved").filter((F.col("max_q") > 0) | (F.col("max_depth") >= depth)).select("theorem_name", "max_q", "max_depth", "nodes").orderBy(F.desc("max_q"), F.desc("max_depth"), "theorem_name").limit(k)


def training_signal(p: DataFrame) -> DataFrame:
    """Over steps of proved theorems: positives, negatives beside a positive and others; on paths also the steps whose head is exact?, how many of
    those close a proof, and lengths in tokens of state and step together, at 3.5 characters each. Theorems by how many proofs they have."""
    beside = F.max("on_path").over(siblings()) & F.col("parent_state_id").isNotNull()
    rows = steps(p).filter("proved").withColumn("hard", ~F.col("on_path") & beside)
    rows = rows.withColumn("tokens", F.when(F.col("on_path"), (F.col("state_size") + F.length("tactic_applied")) / 3.5)).withColumn("search", F.col("on_path") & (F.col("head") == "exact?"))
    stats = rows.agg(F.count_if("on_path").alias("positives"), F.count_if("hard").alias("hard_negatives"), F.count_if(~F.col("on_path") & ~F.col("hard")).alias("easy_negatives"), F.count_if("search").alias("exact_search"),
                     F.count_if(F.col("search") & F.col("is_proof_complete")).alias("exact_search_closes"), F.count_if(F.col("tokens") > 2048).alias("over_2048"), F.count_if(F.col("tokens") > 4096).alias("over_4096"))
    proofs = p.filter("is_proof_complete").groupBy("theorem_name").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("single_proof"), F.count_if(F.col("n") > 1).alias("multi_proof"))
    out = ranks.beside(ranks.beside(stats, proofs), ranks.percentiles(rows, {"tokens_p95": ("tokens", ranks.linear(0.95))}))
    return out.withColumn("tokens_p95", r6(F.coalesce("tokens_p95", F.lit(0.0))))


def positive_depths(p: DataFrame) -> DataFrame:
    """Steps on paths of proved theorems, by depth."""
    return steps(p).filter("proved AND on_path").groupBy("depth_from_root").agg(F.count("*").alias("n"))


def preference_pairs(p: DataFrame) -> DataFrame:
    """Pairs of a child on the path and one off it, counted by products within siblings, never formed."""
    have = F.col("head") == "have"
    on, off = F.col("on_path"), ~F.col("on_path")
    by = branches(p).groupBy("theorem_name", "parent_state_id").agg(F.count_if(on).alias("p"), F.count_if(off).alias("n"), F.count_if(on & have).alias("ph"), F.count_if(off & have).alias("nh"))
    return by.agg(F.sum(F.col("p") * F.col("n")).alias("pairs"), F.sum((F.col("p") - F.col("ph")) * F.col("nh")).alias("other_beats_have"), F.sum(F.col("ph") * (F.col("n") - F.col("nh"))).alias("have_beats_other"))


def score_stats(p: DataFrame) -> DataFrame:
    """By theorem and over all (theorem_name null): nodes by kind, and the spread of scores that aren't zero and of log probabilities.

    Means are of nine decimals, so that they don't hang on the order of summation.
    """
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("double") / F.count(c)
    rows = p.select(F.explode(F.array(F.col("theorem_name"), F.lit(None).cast("string"))).alias("theorem_name"), "is_root", F.col("tactic_applied").isin(*PROBES).alias("probe"),
                    F.when(F.col("ebm_score") != 0, F.col("ebm_score")).alias("nz"), (F.col("ebm_score") == 0).alias("zero"), F.col("llm_log_prob").alias("lp"))
    spread = [r6(f(c)).alias(f"{name}_{what}") for name, c in (("ebm", "nz"), ("lp", "lp")) for what, f in (("mean", mean), ("min", F.min), ("max", F.max))]
    stats = rows.groupBy("theorem_name").agg(F.count("*").alias("nodes"), F.count_if("is_root").alias("roots"), F.count_if(~F.col("is_root") & F.col("probe")).alias("probe_nodes"), F.count_if(~F.col("is_root") & ~F.col("probe")).alias("model_nodes"), F.count_if("zero").alias("zero_ebm"), *spread)
    middle = ranks.percentiles(rows, {"ebm_median": ("nz", ranks.linear(0.5)), "lp_median": ("lp", ranks.linear(0.5))}, "theorem_name")
    return ranks.beside(stats, middle, "theorem_name").withColumns({c: r6(F.col(c)) for c in ("ebm_median", "lp_median")})


def theorem_summary(p: DataFrame) -> DataFrame:
    proof = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("on_path") & ~F.col("is_root"), F.struct("depth_from_root", "state_id", "tactic_applied")))), lambda r: r["tactic_applied"]), " → ")
    return p.groupBy("theorem_name").agg(F.count("*").alias("nodes"), F.count_if("on_path").alias("positive"), F.count_if(~F.col("on_path")).alias("negative"), F.max("depth_from_root").alias("max_depth"), r6(F.min("llm_log_prob")).alias("lp_min"), r6(F.max("llm_log_prob")).alias("lp_max"), proof.alias("proof"))


def depth_counts(p: DataFrame) -> DataFrame:
    """Nodes at each depth and the branching factor to the next."""
    by = p.groupBy("depth_from_root").agg(F.count("*").alias("n"))
    return by.select("depth_from_root", "n", r6(F.lead("n").over(W.orderBy("depth_from_root")) / F.col("n")).alias("branching"))


def proof_multiplicity(p: DataFrame) -> DataFrame:
    by = p.filter("is_proof_complete").groupBy("theorem_name").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 10, "6-10").otherwise(">10")
    return by.groupBy(b.alias("bucket")).agg(F.count("*").alias("theorems"))


def time_to_proof(p: DataFrame) -> DataFrame:
    """theorem_name, position (from 0) of the first complete row in order of states, n, ratio; theorems of one row left out.

    The position is the number of states below the first complete one, counted, not sorted.
    """
    first = F.min(F.when(F.col("is_proof_complete"), F.col("state_id"))).over(theorem())
    rows = p.select("theorem_name", "state_id", first.alias("first")).filter("first is not null")
    by = rows.groupBy("theorem_name").agg(F.count_if(F.col("state_id") < F.col("first")).alias("position"), F.count("*").alias("n"))
    return by.filter("n > 1").select("*", r6(F.col("position") / F.col("n")).alias("ratio"))


def time_to_proof_spread(p: DataFrame) -> DataFrame:
    """One row: theorems, median and 90th percentile of how many states come before the first complete one, and the spread of the ratio."""
    rows = time_to_proof(p)
    counts = ranks.percentiles(rows, {"median_position": ("position", ranks.linear(0.5)), "p90_position": ("position", ranks.linear(0.9))})
    return ranks.beside(distribution(rows, "ratio"), counts)


def time_to_proof_buckets(p: DataFrame) -> DataFrame:
    """Counts that overlap: they are no partition."""
    r = F.col("ratio")
    return time_to_proof(p).agg(F.count("*").alias("n"), F.count_if(r < 0.1).alias("below_10"), F.count_if(r < 0.25).alias("below_25"), F.count_if(r < 0.5).alias("below_50"), F.count_if(r >= 0.75).alias("from_75"))


def distribution(df: DataFrame, c: str, *by: str) -> DataFrame:
    stats = df.groupBy(*by).agg(F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.min(c)).alias("least"), r6(F.max(c)).alias("most"))
    spread = {"median": (c, ranks.linear(0.5)), "p25": (c, ranks.linear(0.25)), "p75": (c, ranks.linear(0.75))}
    return ranks.beside(stats, ranks.percentiles(df, spread, *by), *by).select(*by, "n", "mean", *[r6(F.col(x)).alias(x) for x in spread], "least", "most")


def log_prob_distribution(p: DataFrame) -> DataFrame:
    """Log probabilities of steps of proved theorems, on paths and off."""
    return distribution(steps(p).filter("proved"), "llm_log_prob", "on_path")


def bigrams(p: DataFrame, k: int = 20) -> DataFrame:
    """Heads that follow each other on paths."""
    nxt = F.lead("head").over(theorem().orderBy("depth_from_root", "state_id"))
    return steps(p).filter("on_path").select(F.col("head").alias("a"), nxt.alias("b")).filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)


def path_strings(p: DataFrame) -> DataFrame:
    rows = p.filter("on_path").groupBy("theorem_name").agg(F.array_sort(F.collect_list(F.struct("depth_from_root", "state_id", "head", "state_size"))).alias("r"))
    one = lambda r: F.concat(F.lit("d"), r["depth_from_root"].cast("string"), F.lit(":"), r["head"], F.lit("("), r["state_size"].cast("string"), F.lit(")"))
    return rows.select("theorem_name", F.array_join(F.transform("r", one), " → ").alias("path"))


def nodes_per_depth(p: DataFrame) -> DataFrame:
    return rollup(p).groupBy("proved").agg(F.count("*").alias("n"), r6(F.avg(F.try_divide(F.col("nodes"), F.col("max_depth")))).alias("nodes_per_depth"))


def pattern_hits(p: DataFrame) -> DataFrame:
    """Hits of each old pattern by path and dead steps, with up to three examples."""
    rules = F.array(*[F.when(F.col("tactic_applied").rlike("(?U)" + rule), F.lit(name)) for rule, name in T.OLD_PATTERNS])
    rows = steps(p).select("on_path", "tactic_applied", F.explode(F.array_compact(rules)).alias("pattern"))
    by = rows.groupBy("pattern", "on_path", "tactic_applied").agg(F.count("*").alias("n"))
    some = topk.first_k(by.drop("n"), ["pattern", "on_path"], ["tactic_applied"], 3).groupBy("pattern", "on_path").agg(F.array_sort(F.collect_list("tactic_applied")).alias("examples"))
    return by.groupBy("pattern", "on_path").agg(F.sum("n").alias("n")).join(some, ["pattern", "on_path"])


#: a fixed value: where steps name lemmas
_NAMED = r"(?U)(?:rw|simp(?:\s*only)?)\s*\[([^\]]+)\]|exact\s+(\S+)"


def named_lemmas(p: DataFrame) -> DataFrame:
    """A row for each lemma a step names in rw [..], simp [..] or exact, arrows before it taken off; functions and names of two characters or fewer left out."""
    t = F.col("tactic_applied")
    inside = F.concat(*[F.regexp_extract_all(t, F.lit(_NAMED), F.lit(group)) for group in (1, 2)])
    clean = F.transform(F.flatten(F.transform(inside, lambda x: F.split(x, ","))), lambda x: T.strip(F.regexp_replace(T.strip(x), "^←*↑*↓*", "")))
    return steps(p).select("on_path", "theorem_name", "state_id", F.substring(t, 1, 100).alias("tactic"), F.posexplode(clean).alias("at", "lemma")).filter((F.length("lemma") > 2) & ~F.col("lemma").startswith("fun "))


def lemma_references(p: DataFrame, k: int = 50) -> DataFrame:
    return named_lemmas(p).groupBy("lemma").agg(F.count("*").alias("n"), F.count_if("on_path").alias("path_n")).orderBy(F.desc("n"), "lemma").limit(k)


def lemma_examples(p: DataFrame, k: int = 2) -> DataFrame:
    """lemma, theorem_name, state_id, tactic, place: the first ``k`` steps that name each lemma."""
    return topk.first_k(named_lemmas(p).select("lemma", "theorem_name", "state_id", "at", "tactic"), ["lemma"], ["theorem_name", "state_id", "at"], k).drop("at")


def head_profile(p: DataFrame) -> DataFrame:
    """Steps, different heads, and the entropy of heads in bits."""
    by = steps(p).groupBy("head").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))
    return by.select("n", (-share * F.log2(share)).alias("h")).agg(F.sum("n").alias("steps"), F.count("*").alias("heads"), r6(F.sum("h")).alias("entropy_bits"))


def depth_buckets(p: DataFrame) -> DataFrame:
    d = rollup(p).groupBy("max_depth").agg(F.count("*").alias("n"), F.count_if("proved").alias("proved"))
    w = W.orderBy("max_depth").rowsBetween(W.unboundedPreceding, 0)
    return d.select("max_depth", "n", "proved", r6(100 * F.sum("n").over(w) / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("cumulative_pct"), r6(100 * F.col("proved") / F.col("n")).alias("rate"))


def eval_rollup(p: DataFrame) -> DataFrame:
    """theorem_name, proved, nodes, max_depth, proof_depth (least depth of a complete state), time_secs."""
    return p.groupBy("theorem_name").agg(F.max("is_proof_complete").alias("proved"), F.count("*").alias("nodes"), F.max("depth_from_root").alias("max_depth"), F.min(F.when(F.col("is_proof_complete"), F.col("depth_from_root"))).alias("proof_depth"), ((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000).alias("time_secs"))


def eval_totals(p: DataFrame) -> DataFrame:
    by = eval_rollup(p)
    stats = by.agg(F.count_if("proved").alias("solved"), F.count("*").alias("total"), F.bround(F.try_divide(F.count_if("proved"), F.count("*")), 4).alias("rate"), F.bround(F.avg("nodes"), 1).alias("avg_nodes"), r6(F.avg("time_secs")).alias("avg_time"))
    return ranks.beside(stats, ranks.percentiles(by, {"median_time": ("time_secs", ranks.linear(0.5))})).withColumn("median_time", r6(F.coalesce("median_time", F.lit(0.0))))


def best_of(attempts: DataFrame) -> DataFrame:
    """Of each name the first attempt, unless a later one proves: name, attempt, proved, nodes, time_secs."""
    key = F.struct(~F.col("proved"), "attempt")
    return attempts.groupBy("name").agg(F.min_by(F.struct("attempt", "proved", "nodes", "time_secs"), key).alias("b")).select("name", "b.*")


def compared(results: DataFrame) -> DataFrame:
    """Adds delta, the change of the rate, if there are exactly two results (columns label, rate)."""
    w = W.orderBy("label")
    return results.withColumn("delta", F.when(F.count("*").over(W.partitionBy(F.lit(1))) == 2, r6(F.col("rate") - F.lag("rate").over(w))))
