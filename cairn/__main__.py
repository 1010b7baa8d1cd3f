"""Commands: summary, export-proof-paths, search, probe, eval, evaluation, compare, generate-negatives, sample, report.

An environment's and a policy's answers are read from Parquet tables (see operators.search); paths may be remote.
"""
from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import analytics, curate, ranks, reports, search, tree
from .sources import readers, writers


def _settings(args, **fixed) -> search.Settings:
    path = getattr(args, "config", None)
    return search.settings(readers.config({}, path, {"max_rounds": getattr(args, "max_rounds", None), "budget": getattr(args, "budget", None)} | fixed))


def _theorems(spark: SparkSession, args) -> DataFrame:
    return readers.theorem_index(spark, args.theorems, args.num_theorems).select(F.col("name").alias("theorem_name"), "statement")


def _policy(spark: SparkSession, args) -> DataFrame:
    if args.policy:
        return spark.read.parquet(args.policy)
    return spark.createDataFrame([], "theorem_name string, pattern string, match string, ord long, text string, log_prob double")


def _found(spark: SparkSession, args, settings: search.Settings, names: DataFrame) -> DataFrame:
    return search.best_first(names, spark.read.parquet(args.transitions), _policy(spark, args), settings, now_ms=int(time.time() * 1000))


def summary(spark, args) -> DataFrame:
    return analytics.summary(readers.trajectories(spark, args.input))


def export_proof_paths(spark, args) -> DataFrame:
    """The first file that tells of a theorem's proof counts."""
    rows = readers.with_file_order(spark, args.trajectories)
    # a file's theorem is a theorem of its own until the first file is chosen
    own = rows.withColumn("theorem_name", F.concat(F.lpad(F.col("file_ord").cast("string"), 10, "0"), F.lit(":"), F.col("theorem_name")))
    steps = tree.exported_paths(own, args.min_steps).withColumn("file", F.substring("theorem", 1, 10)).withColumn("theorem", F.expr("substring(theorem, 12)"))
    first = steps.groupBy("theorem").agg(F.min("file").alias("file"))
    steps = steps.join(first, ["theorem", "file"]).drop("file")
    writers.json_lines(steps, args.output)
    return spark.read.json(args.output).agg(F.count_distinct("theorem").alias("theorems"), F.count("*").alias("steps"))


def run_search(spark, args) -> DataFrame:
    names = _theorems(spark, args)
    if args.resume_from:
        names = names.join(readers.theorem_names(readers.trajectories(spark, args.resume_from)), "theorem_name", "left_anti")
    writers.trajectories(tree.label_paths(search.trajectories(_found(spark, args, _settings(args), names))), args.output)
    rows = readers.trajectories(spark, *[p for p in (args.resume_from, args.output) if p])
    return analytics.summary(rows)


def probe(spark, args) -> DataFrame:
    """Theorems that probes alone prove are easy; each theorem goes to easy or hard."""
    args.policy = None
    found = search.results(_found(spark, args, _settings(args), _theorems(spark, args)))
    parts = found.select("theorem_name", F.when(F.col("proved"), "easy").otherwise("hard").alias("split"), "reason", "states")
    writers.split_json_lines(parts, args.output)
    return spark.read.json(args.output).groupBy("split").agg(F.count("*").alias("theorems"), F.avg("states").alias("states")).orderBy("split")


def evaluate(spark, args) -> DataFrame:
    """Best of the attempts that the policy's tables hold, one table for each attempt."""
    attempts, paths = None, args.policies
    for k, path in enumerate(paths):
        args.policy = path
        found = search.results(_found(spark, args, _settings(args), _theorems(spark, args)))
        one = found.select(F.col("theorem_name").alias("name"), F.lit(k).alias("attempt"), "proved", F.col("states").alias("nodes"), F.lit(0.0).alias("time_secs"))
        attempts = one if attempts is None else attempts.unionByName(one)
    writers.trajectories(attempts, f"{args.output}/attempts")
    best = analytics.best_of(spark.read.parquet(f"{args.output}/attempts"))
    totals = best.agg(F.count_if("proved").alias("solved"), F.count("*").alias("total"), F.avg(F.col("proved").cast("int")).alias("rate"), F.avg("nodes").alias("avg_nodes"))
    totals = ranks.beside(totals, ranks.percentiles(best, {"median_nodes": ("nodes", ranks.linear(0.5))}))
    writers.json_lines(totals, f"{args.output}/totals")
    return spark.read.json(f"{args.output}/totals")


def compare(spark, args) -> DataFrame:
    return analytics.compared(readers.evaluations(spark, *args.results).select(F.col("path").alias("label"), "solved", "total", "rate"))


def generate_negatives(spark, args) -> DataFrame:
    pairs = readers.tactic_pairs(spark, args.pairs).withColumnRenamed("theorem", "theorem_name")
    pairs = pairs.join(curate.complete_groups(pairs, "theorem_name", "depth", args.min_steps), "theorem_name", "left_semi")
    found = search.along_proofs(pairs, spark.read.parquet(args.transitions), _policy(spark, args), args.candidates_per_step, args.target_negatives)
    writers.trajectories(search.trajectories(found), args.output)
    return reports.labels_by_depth(readers.trajectories(spark, args.output)).orderBy("depth_from_root")


def sample(spark, args) -> DataFrame:
    """Contrastive training samples."""
    rows = curate.contrastive_samples(readers.trajectories(spark, *args.trajectories), args.samples, args.negatives, args.hard, args.medium, args.seed)
    writers.trajectories(rows, args.output)
    return spark.read.parquet(args.output).groupBy("tier").agg(F.count("*").alias("n")).orderBy("tier")


def report(spark, args) -> DataFrame:
    """Markdown of all analyses, printed one after the other; the prepared rows are made once."""
    p = analytics.prepare(readers.trajectories(spark, args.input)).persist()
    ranked = analytics.sibling_ranks(p)
    sections = {
        "Heads": (analytics.head_distribution, analytics.have_against_others, analytics.sibling_outcomes),
        "Goals": (lambda p: analytics.goal_delta(p, True, 3), lambda p: analytics.goal_delta(p, False, 10)),
        "State sizes": (analytics.state_size_by_depth,),
        "Heads by depth": (analytics.top_heads_by_depth, lambda p: analytics.top_heads_by_depth(p, closing=True), analytics.closing_heads),
        "First steps": (analytics.first_step_diversity,),
        "Ranks by log probability": (lambda p: analytics.rank_summary(ranked), lambda p: analytics.rank_histogram(ranked), lambda p: analytics.rank_summary(ranked, "depth").orderBy("depth"), lambda p: analytics.rank_summary(analytics.with_sibling_bucket(ranked), "bucket"), analytics.log_prob_distribution, analytics.log_prob_by_depth, analytics.completion_groups),
        "States": (analytics.root_description, analytics.root_goals, analytics.hypotheses_by_depth, analytics.topic_rates),
        "Search": (analytics.rollup_summary, analytics.dead_have_fraction, analytics.time_to_proof_buckets, analytics.fanout),
        "Failures": (analytics.failure_modes, analytics.failed_depths, analytics.near_misses),
        "Years": (reports.year_stats,),
        "Depths": (reports.rate_by_depth, analytics.depth_buckets),
        "Training signal": (analytics.training_signal, analytics.positive_depths, analytics.preference_pairs, analytics.proof_multiplicity),
    }
    for name, parts in sections.items():
        print(f"## {name}\n")
        for part in parts:
            print(f"{writers.markdown(part(p))}\n")
    out = spark.createDataFrame(analytics.summary(p).collect())  # one row
    p.unpersist()
    return out


def evaluation(spark, args) -> DataFrame:
    """An evaluation document from stored trajectories."""
    document = reports.evaluation(analytics.prepare(readers.trajectories(spark, args.input)))
    document.write.mode("overwrite").text(args.output)
    return spark.read.schema(schemas.EVALUATION).json(args.output).select("solved", "total", "rate", "avg_nodes", "avg_time_secs", "median_time_secs")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn", description=__doc__)
    top.add_argument("--json", action="store_true", help="print JSON lines, not Markdown")
    sub = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name, help=run.__doc__)
        for flags, kw in options:
            p.add_argument(flags, **kw)
        p.set_defaults(run=run)

    need, many, number = {"required": True}, {"required": True, "nargs": "+"}, lambda d=None: {"type": int, "default": d}
    world = [("--theorems", need), ("--transitions", need), ("--num-theorems", number()), ("--config", {}), ("--max-rounds", number()), ("--budget", number()), ("--output", need)]
    command("summary", summary, ("--input", need))
    command("report", report, ("--input", need))
    command("export-proof-paths", export_proof_paths, ("--trajectories", many), ("--output", need), ("--min-steps", number(1)))
    command("search", run_search, *world, ("--policy", {}), ("--resume-from", {}))
    command("probe", probe, *world)
    command("eval", evaluate, *world, ("--policies", many))
    command("evaluation", evaluation, ("--input", need), ("--output", need))
    command("compare", compare, ("--results", many))
    command("generate-negatives", generate_negatives, ("--pairs", need), ("--transitions", need), ("--policy", {}), ("--output", need), ("--min-steps", number(1)), ("--candidates-per-step", number(8)), ("--target-negatives", number(15)))
    command("sample", sample, ("--trajectories", many), ("--output", need), ("--samples", number(1000)), ("--negatives", number(4)), ("--hard", {"type": float, "default": 0.3}), ("--medium", {"type": float, "default": 0.4}), ("--seed", number(0)))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    out = args.run(spark or SparkSession.builder.appName("cairn").getOrCreate(), args)
    text = "\n".join(out.toJSON().collect()) if args.json else writers.markdown(out)
    print(text)
    return text


if __name__ == "__main__":
    main()
