"""Reports over runs, attempts, logs and metrics."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import proofs as P
from ..functions import text as T
from . import analytics, ranks, scans
from .forest import in_trees, runs

#: fixed values: heads whose behaviour changed between versions
SENSITIVE = ["rw", "simp", "simp_all", "norm_num", "linarith", "field_simp", "ring", "omega", "positivity", "norm_cast", "push_cast", "exact_mod_cast"]


def r6(c: Column) -> Column:
    return F.round(c, 6)


def latency_percentiles(df: DataFrame, c: str, *by: str) -> DataFrame:
    """p50, p95, p99: the values at places n / 2, 0.95 n, 0.99 n (rounded down) of the sorted values."""
    return ranks.percentiles(df, {"p50": (c, ranks.indexed(0.5)), "p95": (c, ranks.indexed(0.95)), "p99": (c, ranks.indexed(0.99))}, *by)


def evaluation(p: DataFrame) -> DataFrame:
    """One row, ``document``: an evaluation as JSON, from prepared trajectories: totals, how deep the proofs are, and each theorem by name.

    A theorem that isn't proved has spent its budget. The document holds a line for each theorem, so it is of a benchmark's size.
    """
    by = analytics.eval_rollup(p)
    each = F.struct(F.col("theorem_name").alias("name"), "proved", F.col("nodes").alias("nodes_used"), F.bround("time_secs", 2).alias("time_secs"), F.when(F.col("proved"), "").otherwise("budget_exhausted").alias("failure_reason"), "max_depth", "proof_depth")
    totals = by.agg(F.count("*").alias("total_theorems"), F.count_if("proved").alias("solved"), F.count("*").alias("total"), F.bround(F.coalesce(F.try_divide(F.count_if("proved"), F.count("*")), F.lit(0.0)), 4).alias("rate"),
                    F.bround(F.coalesce(F.avg("nodes"), F.lit(0.0)), 1).alias("avg_nodes"), F.bround(F.coalesce(F.avg("time_secs"), F.lit(0.0)), 1).alias("avg_time_secs"), F.array_sort(F.collect_list(each)).alias("per_theorem"))
    middle = ranks.percentiles(by, {"median_time_secs": ("time_secs", ranks.linear(0.5))})
    depths = by.filter("proof_depth is not null").groupBy("proof_depth").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("proof_depth", "n")))).alias("depth_distribution"))
    row = ranks.beside(ranks.beside(totals, middle.select(F.bround("median_time_secs", 1).alias("median_time_secs"))), depths)
    row = row.withColumn("median_time_secs", F.coalesce("median_time_secs", F.lit(0.0)))
    return row.select(F.to_json(F.struct("total_theorems", "solved", "total", "rate", "avg_nodes", "avg_time_secs", "median_time_secs", "depth_distribution", "per_theorem")).alias("document"))


def run_totals(outcomes: DataFrame, wall_ms: float) -> DataFrame:
    """Of theorems (proved, reason, nodes, generate_ms, verify_ms, score_ms): how they ended and where the time went."""
    part = lambda c: r6(F.coalesce(100 * F.sum(c) / wall_ms, F.lit(0.0)))
    spent = F.coalesce(F.sum(F.col("generate_ms") + F.col("verify_ms") + F.col("score_ms")), F.lit(0))
    return outcomes.agg(
        F.count("*").alias("theorems"), F.count_if("proved").alias("proved"), r6(100 * F.avg(F.col("proved").cast("int"))).alias("proved_pct"), F.count_if(~F.col("proved")).alias("failed"),
        F.count_if(F.col("reason") == "timeout").alias("timeouts"), F.count_if(F.col("reason") == "error").alias("errors"), F.sum("nodes").alias("nodes"),
        part("generate_ms").alias("generate_pct"), part("verify_ms").alias("verify_pct"), part("score_ms").alias("score_pct"), F.greatest(F.lit(0), wall_ms - spent).cast("double").alias("overhead_ms"))


def throughput(done: DataFrame, ts_ms: str, key: str) -> DataFrame:
    """keys_per_minute, rows_per_second between the first and the last row."""
    secs = (F.max(ts_ms) - F.min(ts_ms)) / 1000
    return done.agg(r6(F.when(secs > 0, 60 * F.count_distinct(key) / secs).otherwise(0.0)).alias("keys_per_minute"), r6(F.when(secs > 0, F.count("*") / secs).otherwise(0.0)).alias("rows_per_second"))


def labels_by_depth(traj: DataFrame) -> DataFrame:
    return traj.groupBy("depth_from_root").agg(F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"))


def deep_negatives(traj: DataFrame, deeper_than: int = 2) -> DataFrame:
    """How many theorems have a negative below a depth."""
    return traj.filter((F.col("label") == "negative") & (F.col("depth_from_root") > deeper_than)).agg(F.count_distinct("theorem_name").alias("theorems"))


def class_balance(traj: DataFrame) -> DataFrame:
    """Positives and negatives of theorems: least, upper median, most; how many have both, and fewer than three negatives."""
    per = traj.groupBy("theorem_name").agg(F.count_if(F.col("label") == "positive").alias("pos"), F.count_if(F.col("label") == "negative").alias("neg"))
    stats = per.agg(*[f.alias(f"{name}_{c}") for c in ("pos", "neg") for name, f in (("min", F.min(c)), ("max", F.max(c)))],
                    F.count_if((F.col("pos") > 0) & (F.col("neg") > 0)).alias("eligible"), F.count_if(F.col("neg") < 3).alias("few_negatives"))
    middle = ranks.percentiles(per, {"mid_pos": ("pos", ranks.upper_median()), "mid_neg": ("neg", ranks.upper_median())})
    return ranks.beside(stats, middle.select(F.col("mid_pos").cast("long").alias("mid_pos"), F.col("mid_neg").cast("long").alias("mid_neg"))).select("min_pos", "mid_pos", "max_pos", "min_neg", "mid_neg", "max_neg", "eligible", "few_negatives")


def positive_sources(pairs: DataFrame, traj: DataFrame) -> DataFrame:
    """source, rows, theorems, with_negatives: positives of a pair file (theorem, depth) beside those a search found, and how many of
    the theorems have negatives from the search to contrast them with."""
    negative = traj.filter("label = 'negative'").select(F.col("theorem_name").alias("theorem")).distinct().withColumn("has", F.lit(True))
    rows = pairs.select(F.lit("pairs").alias("source"), "theorem").unionByName(traj.filter("label = 'positive'").select(F.lit("search").alias("source"), F.col("theorem_name").alias("theorem")))
    per = rows.groupBy("source", "theorem").agg(F.count("*").alias("n")).join(negative, "theorem", "left")
    return per.groupBy("source").agg(F.sum("n").alias("rows"), F.count("*").alias("theorems"), F.count_if(F.coalesce("has", F.lit(False))).alias("with_negatives"))


def depth_histogram(pairs: DataFrame, depth: str) -> DataFrame:
    """Pairs at each depth, and their per cent."""
    by = pairs.groupBy(F.col(depth).alias("depth")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("total")))).select("depth", "n", r6(100 * F.col("n") / F.col("total")).alias("pct"))  # one row of totals


def pairs_summary(pairs: DataFrame) -> DataFrame:
    """Of pairs (theorem, state, tactic): how many, how long, how many with more than one goal."""
    return pairs.agg(
        F.count_distinct("theorem").alias("theorems"), F.count("*").alias("pairs"), r6(F.count("*") / F.count_distinct("theorem")).alias("per_theorem"),
        r6(F.avg(F.length("tactic"))).alias("avg_length"), F.max(F.length("tactic")).alias("max_length"), r6(100 * F.avg((T.count_turnstiles(F.col("state")) > 1).cast("int"))).alias("multi_goal_pct"))


def depth_stats(pairs: DataFrame, key: str, depth: str) -> DataFrame:
    """Over keys' deepest rows: median, mean, how many at 3 or more."""
    per = pairs.groupBy(key).agg(F.max(depth).alias("d"))
    stats = per.agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean"), F.count_if(F.col("d") >= 3).alias("deep"), r6(100 * F.avg((F.col("d") >= 3).cast("int"))).alias("deep_pct"))
    return ranks.beside(stats, ranks.percentiles(per, {"median": ("d", ranks.linear(0.5))})).select("n", r6(F.col("median")).alias("median"), "mean", "deep", "deep_pct")


def counted(df: DataFrame, *by: str) -> DataFrame:
    """Counts by columns, with totals over the later ones and over all; ``level`` tells how many columns are kept."""
    return df.rollup(*by).agg(F.count("*").alias("n"), (F.lit(len(by)) - sum(F.grouping(c).cast("int") for c in by)).cast("int").alias("level"))


def rate_by_depth(p: DataFrame) -> DataFrame:
    """Share of theorems proved, by their greatest depth: 0-1, 2-3, 4-5, 6 and more."""
    per = p.groupBy("theorem_name").agg(F.max("depth_from_root").alias("d"), F.max("proved").alias("proved"))
    bucket = F.when(F.col("d") < 2, "0-1").when(F.col("d") < 4, "2-3").when(F.col("d") < 6, "4-5").otherwise("6+")
    return per.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("theorems"), F.count_if("proved").alias("proved"), r6(100 * F.avg(F.col("proved").cast("int"))).alias("rate"))


def year_stats(p: DataFrame) -> DataFrame:
    """Theorems and proofs by the contest year that names tell."""
    per = p.groupBy("theorem_name").agg(F.max("proved").alias("proved")).withColumn("year", T.contest_parts(F.col("theorem_name"))["year"])
    return per.filter("year is not null").groupBy("year").agg(F.count("*").alias("total"), F.count_if("proved").alias("proved"))


def subjects(names: DataFrame, name: str, proved: str) -> DataFrame:
    """By the first part of names (up to _ or .): how many, how many proved."""
    return names.groupBy(F.regexp_extract(name, r"^[^_.]+", 0).alias("subject")).agg(F.count("*").alias("total"), F.count_if(proved).alias("proved"))


def random_rank_one(p: DataFrame) -> DataFrame:
    """How often a random order of siblings would put an on-path one first."""
    per = analytics.branches(p).groupBy("theorem_name", "parent_state_id").agg((F.count_if("on_path") / F.count("*")).alias("share"))
    return per.agg(F.count("*").alias("points"), r6(100 * F.avg("share")).alias("rank_one"))


def sensitive_heads(p: DataFrame, least: int = 5) -> DataFrame:
    """Every head seen ``least`` times, over the steps of all theorems: positive rows and others, shares in both, whether versions changed it.

    A head is a step's first word here.
    """
    word = F.regexp_extract("tactic_applied", r"(?U)^\s*(\S*)", 1)
    per = analytics.steps(p).groupBy(word.alias("head")).agg(F.count_if(F.col("label") == "positive").alias("path"), F.count_if(~F.col("label").eqNullSafe("positive")).alias("dead"))
    totals = per.agg(F.sum("path").alias("all_path"), F.sum("dead").alias("all_dead"))
    share = lambda a, b: r6(F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b)).otherwise(0.0))
    rows = per.filter(F.col("path") + F.col("dead") >= least).crossJoin(F.broadcast(totals))  # one row of totals
    return rows.select("head", "path", "dead", share("path", "all_path").alias("path_pct"), share("dead", "all_dead").alias("dead_pct"), F.col("head").isin(SENSITIVE).alias("sensitive"))


def best_candidates(rows: DataFrame, by: list[str], text: str, score: str, order: str) -> DataFrame:
    """Of candidates with one text the first; ``place`` by falling score."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by, text).orderBy(order))).filter("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), order)))


def unchanged_chains(traj: DataFrame) -> DataFrame:
    """theorem_name, state_id, chain: how many steps in a row, this one and up, left all targets as they were."""
    goals = F.filter(F.split("state_pp", "\n\n"), lambda g: T.strip(g) != "")
    targets = F.array_join(F.transform(goals, lambda g: F.when(g.contains("⊢"), T.strip(F.substring_index(g, "⊢", -1))).otherwise(g)), "\n\n")
    def walk(f):
        target = f.codes("target")
        return [pa.array(runs(f, (f.up >= 0) & (target >= 0) & (target == target[np.maximum(f.up, 0)])))]

    rows = traj.select("theorem_name", "state_id", "parent_state_id", targets.alias("target"))
    return in_trees(rows, "chain bigint", walk).select("theorem_name", "state_id", "chain")


def hardest(runs: list[DataFrame], k: int = 15) -> DataFrame:
    """Theorems (theorem, proved, nodes) that no run proved, by the nodes of all runs."""
    rows = reduce(DataFrame.unionByName, [r.select("theorem", "proved", "nodes") for r in runs])
    return rows.groupBy("theorem").agg(F.max("proved").alias("proved"), F.sum("nodes").alias("nodes")).filter(~F.col("proved")).orderBy(F.desc("nodes"), "theorem").limit(k).select("theorem", "nodes")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are in either table, in both, in one alone."""
    marked = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return marked.agg(F.count("*").alias("either"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def nearest_before(lines: DataFrame, file: str, line: str, name: str) -> DataFrame:
    """Adds ``nearest``: the last non-null ``name`` at or above each line of its file."""
    return scans.last_value(lines, F.col(name), "nearest", [line], [file])


def failing_theorems(errors: DataFrame, theorems: DataFrame) -> DataFrame:
    """file, name, errors: compiler errors (file, line, message) by the theorem (file, line, name) they lie in."""
    rows = theorems.select("file", "line", "name", F.lit(None).cast("string").alias("message")).unionByName(errors.select("file", "line", F.lit(None).cast("string").alias("name"), "message"))
    rows = rows.withColumn("later", F.col("name").isNull()).withColumn("tie", F.coalesce("message", "name"))
    placed = scans.last_value(rows, F.col("name"), "nearest", ["line", "later", "tie"], ["file"]).filter("message is not null AND nearest is not null")
    return placed.groupBy("file", F.col("nearest").alias("name")).agg(F.count("*").alias("errors"))


def attempts_rollup(attempts: DataFrame) -> DataFrame:
    """By theorem and temperature: attempts, compiled ones, different compiled proofs and their first lines."""
    ok = lambda c: F.count_distinct(F.when(F.col("compiled"), c))
    first = T.strip(F.substring_index(T.strip(F.col("proof")), "\n", 1))
    return attempts.groupBy("theorem", "temperature").agg(F.count("*").alias("attempts"), F.count_if("compiled").alias("compiled"), ok(F.col("proof")).alias("proofs"), ok(first).alias("first_lines"))


#: fixed values: how sources that compiled are marked
COMPILED = ("ok", "warn")


def integrity(sources: DataFrame) -> DataFrame:
    """Of sources (seq, status, text) that compiled: clean, contaminated, suspicious, trivial ones; whether 90 % are clean."""
    rows = sources.filter(F.col("status").isin(*COMPILED)).select("seq", P.integrity_of(F.col("text")).alias("i")).select("seq", "i.*")
    clean = F.count_if(~F.col("contaminated"))
    return rows.agg(F.count("*").alias("passing"), clean.alias("clean"), F.count_if("contaminated").alias("contaminated"), F.count_if(F.size("suspicious") > 0).alias("suspicious"), F.count_if("trivial").alias("trivial"),
                    r6(F.coalesce(100 * clean / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))).alias("clean_pct"), F.coalesce(100 * clean / F.nullif(F.count("*"), F.lit(0)) >= 90, F.lit(False)).alias("gate"))


def contamination_words(sources: DataFrame) -> DataFrame:
    """word, sources: how many sources hold each word that proves nothing."""
    words = F.array_distinct(F.transform(P.integrity_of(F.col("text"))["reasons"], lambda r: F.substring_index(r, " ", 1)))
    return sources.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("sources"))


def integrity_document(sources: DataFrame) -> DataFrame:
    """One row, ``document``: the figures of :func:`integrity` as JSON, with how many sources hold each word, and how many texts are missing."""
    passing = sources.filter(F.col("status").isin(*COMPILED))
    words = contamination_words(passing).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "sources")))).alias("contamination_breakdown"))  # a row for each word
    whole = sources.agg(F.count("*").alias("total_compiled"), F.count_if(F.col("status").isin(*COMPILED) & F.col("text").isNull()).alias("files_not_found"))
    rows = integrity(sources).join(F.broadcast(whole)).join(F.broadcast(words))
    share = lambda c: F.round(F.coalesce(F.try_divide(100 * F.col(c), F.col("passing")), F.lit(0.0)), 2)
    return rows.select(F.to_json(F.struct("total_compiled", F.col("passing").alias("total_passing"), F.col("clean").alias("total_clean"), F.col("contaminated").alias("total_contaminated"), share("clean").alias("clean_percentage"), share("contaminated").alias("contaminated_percentage"),
                                          "contamination_breakdown", F.col("suspicious").alias("suspicious_axiom_count"), F.col("trivial").alias("trivial_proof_count"), "files_not_found")).alias("document"))


def compile_document(results: DataFrame) -> DataFrame:
    """One row, ``document``: of files (file, status) how many compiled, as JSON, with those that failed and those that ran out of time, by name."""
    failed = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("file"))))
    lists = results.filter("status IN ('error', 'timeout')").agg(failed("error").alias("error_files"), failed("timeout").alias("timeout_files"))
    rate = F.coalesce(F.concat(F.format_number("pass_rate", 1), F.lit("%")), F.lit("N/A"))
    return compile_counts(results).join(F.broadcast(lists)).select(F.to_json(F.struct(F.col("total").alias("total_processed"), "ok", "warnings", "errors", "timeouts", rate.alias("pass_rate"), "error_files", "timeout_files")).alias("document"))


def probe_document(found: DataFrame, elapsed_secs: float) -> DataFrame:
    """One row, ``document``: of theorems (name, statement, split: easy, hard or error) which are easy and which hard, by name, as JSON, with counts."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct("name", "statement"))))
    n = lambda s: F.count_if(F.col("split") == s)
    stats = F.struct(F.count("*").alias("total"), n("easy").alias("easy"), n("hard").alias("hard"), n("error").alias("errors"), F.lit(float(elapsed_secs)).alias("elapsed_secs"))
    return found.agg(stats.alias("stats"), of("easy").alias("easy"), of("hard").alias("hard")).select(F.to_json(F.struct("stats", "easy", "hard")).alias("document"))


def error_counts(log: DataFrame, message: str) -> DataFrame:
    """error, n: the classes of start-up errors."""
    return log.groupBy(T.error_class(F.col(message)).alias("error")).agg(F.count("*").alias("n"))


#: a fixed value: the line of a log that says so
STARTUP_LINE = r'Search error, skipping\s+theorem="([^"]+)"\s+error=(.*)$'
#: fixed values: identifiers by why they are unknown, and those that a contest's files define themselves
IDENTIFIERS = {"neighbourhood filter": ["𝓝"], "type variable": ["X"], "namespace not opened": ["IntegrableOn", "Injective"], "needs qualification": ["card", "coeff", "eval", "prod", "range", "univ", "sqrt", "cexp", "coeHom"], "free variable": ["f", "b"]}
OWN_DEFINITIONS = ["AliceHasWinningStrategy", "is_rational_point", "klimited", "num_ones", "tetration", "descentCount", "Simplex", "dist_to_int"]


def startup_errors(lines: DataFrame, line: str, order: str) -> DataFrame:
    """theorem, error, identifier, identifier_class, version_related: the theorems that a log says couldn't be started, by their last such line.

    Unknown identifiers, unless defined by the benchmark itself, syntax and symbols that aren't found come with a change of version; time-outs and failed calls don't.
    """
    said = lines.select(F.regexp_extract(line, STARTUP_LINE, 1).alias("theorem"), T.strip(F.regexp_extract(line, STARTUP_LINE, 2)).alias("message"), F.col(order).alias("at")).filter("theorem <> ''")
    last = said.groupBy("theorem").agg(F.max_by("message", "at").alias("message")).withColumn("error", T.error_class(F.col("message")))
    name = F.regexp_extract("message", "Unknown identifier `([^`]+)`", 1)
    rows = last.withColumn("identifier", F.when(F.col("error") == "unknown_identifier", F.coalesce(F.nullif(name, F.lit("")), F.lit("???"))))
    kind = F.when(F.col("identifier").isNull(), F.lit(None).cast("string"))
    for what, names in IDENTIFIERS.items():
        kind = kind.when(F.col("identifier").isin(names), what)
    related = F.when(F.col("error") == "unknown_identifier", ~F.col("identifier").isin(OWN_DEFINITIONS)).otherwise(F.col("error").isin("parse_error", "symbol_not_found"))
    return rows.select("theorem", "error", "identifier", kind.otherwise("own definition").alias("identifier_class"), related.alias("version_related"))


def readiness(counts: dict[str, DataFrame], least: dict[str, int], spark) -> DataFrame:
    """name, n, state of tables: PASS at their least number of rows or more, WARN below, FAIL when empty."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(least.get(name, 1)).alias("least")) for name, df in counts.items()]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, n long, least int")
    return rows.select("name", "n", F.when(F.col("n") >= F.col("least"), "PASS").when(F.col("n") > 0, "WARN").otherwise("FAIL").alias("state"))


def interval_means(metrics: DataFrame, step: str, interval: int, *columns: str) -> DataFrame:
    """Means over intervals of steps."""
    return metrics.groupBy(F.floor(F.col(step) / interval).alias("interval")).agg(*[r6(F.avg(c)).alias(c) for c in columns])


def improving(metrics: DataFrame, step: str, c: str, window: int, run: str = "run") -> DataFrame:
    """Adds ``improving``: the last value is above the first among the last ``window`` of a run; false for one."""
    w = W.partitionBy(run).orderBy(step).rowsBetween(-(window - 1), 0)
    return metrics.withColumn("improving", (F.count("*").over(w) > 1) & (F.last(c).over(w) > F.first(c).over(w)))


def best_so_far(metrics: DataFrame, step: str, c: str, run: str = "run") -> DataFrame:
    """Adds ``best``: the value is above all earlier ones of its run."""
    before = F.max(c).over(W.partitionBy(run).orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    return metrics.withColumn("best", F.coalesce(F.col(c) > before, F.lit(True)))


def learning_rates(spark, base: float, warm_up: int, total: int) -> DataFrame:
    """step, rate: linear up to ``warm_up``, then a half cosine down."""
    s = F.col("id")
    fall = 0.5 * base * (1 + F.cos(F.lit(3.141592653589793) * (s - warm_up) / max(1, total - warm_up)))
    return spark.range(total).select(s.alias("step"), F.when(s < warm_up, base * (s + 1) / max(1, warm_up)).otherwise(fall).alias("rate"))


def impact(tried: DataFrame, proved: DataFrame, broken: DataFrame, key: str = "theorem") -> DataFrame:
    """How names that couldn't start weigh: the rate over all tried, over those that could start, and what it would be if the broken
    ones were proved at that second rate, which gives whole proofs only (``extra``)."""
    side = lambda df, name: df.select(key, *[F.lit(int(name == c)).alias(c) for c in ("tried", "proved", "broken")])
    m = side(tried, "tried").unionByName(side(proved, "proved")).unionByName(side(broken, "broken")).groupBy(key).agg(*[F.max(c).alias(c) for c in ("tried", "proved", "broken")])
    t, ok, bad = (F.count_if(c) for c in (F.col("tried") == 1, (F.col("tried") == 1) & (F.col("proved") == 1), (F.col("tried") == 1) & (F.col("broken") == 1)))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    extra = F.floor(rate(ok, t - bad) * bad)
    return m.agg(t.alias("tried"), ok.alias("proved"), bad.alias("broken"), (t - bad).alias("pool"), r6(100 * rate(ok, t)).alias("rate"), r6(100 * rate(ok, t - bad)).alias("adjusted_rate"), extra.alias("extra"), r6(100 * rate(ok + extra, t)).alias("upper_rate"))


def skipped_and_failed(skipped: DataFrame, failed: DataFrame, key: str = "theorem") -> DataFrame:
    """How many names a skip list alone holds, the start-up errors alone, and both."""
    o = overlap(skipped, failed, key)
    return o.select(F.col("only_a").alias("skipped_only"), F.col("only_b").alias("failed_only"), "both", F.col("either").alias("blocked"))


def head_counts(heads: DataFrame, k: int = 30) -> DataFrame:
    """head, n, pct of all: the ``k`` commonest of a column ``head``, ties by name."""
    by = heads.groupBy("head").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("head", "n", r6(100 * F.col("n") / F.col("total")).alias("pct")).orderBy(F.desc("n"), "head").limit(k)


#: fixed values: the heads by which corpora are compared
COMPARED = ["have", "nlinarith", "intro", "exact?", "field_simp", "simp_all", "linarith", "omega", "norm_num", "ring", "constructor", "rcases", "exact", "simp", "rw"]


def compared_heads(corpora: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """head and one column of per cents for each corpus (a frame with ``head``), for the heads compared that any of them has.

    Per cents are of the corpus; a head that isn't among its ``k`` commonest counts as 0.
    """
    parts = [head_counts(df, k).select("head", F.lit(name).alias("corpus"), "pct") for name, df in corpora.items()]
    wide = reduce(DataFrame.unionByName, parts).filter(F.col("head").isin(COMPARED)).groupBy("head")
    return wide.agg(*[F.coalesce(F.max(F.when(F.col("corpus") == name, F.col("pct"))), F.lit(0.0)).alias(name) for name in corpora]).filter(reduce(Column.__or__, [F.col(name) > 0 for name in corpora]))


def compile_counts(results: DataFrame) -> DataFrame:
    """Of files (status: ok, warn, error, timeout): how many of each, and the rate of those that compile; null of none."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), n("ok").alias("ok"), n("warn").alias("warnings"), n("error").alias("errors"), n("timeout").alias("timeouts"),
                       F.round(F.try_divide(100 * (n("ok") + n("warn")), F.count("*")), 1).alias("pass_rate"))


def with_files(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """problem_id, filename: different ids that the manifest knows, with its last filename by ``seq``."""
    files = manifest.groupBy("problem_id").agg(F.max_by("filename", "seq").alias("filename"))
    return ids.select("problem_id").distinct().join(files, "problem_id")


def with_problems(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """``sources`` (seq) with the manifest's problem_id, ``unknown_<seq>`` where it has none."""
    known = manifest.groupBy("seq").agg(F.max("problem_id").alias("problem_id"))
    return sources.join(known, "seq", "left").withColumn("problem_id", F.coalesce("problem_id", F.concat(F.lit("unknown_"), F.col("seq").cast("string"))))
