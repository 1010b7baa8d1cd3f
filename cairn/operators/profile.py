"""Profiles of step corpora (theorem, state, tactic, depth), and samples of theorems stratified by what depths have to teach."""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import curate, ranks, topk
from .analytics import r6

#: least depths of the buckets of proofs
BOUNDS = (0, 1, 2, 4, 7)


def bucket_of(depth: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """The number of the bucket, by least depths in rising order; null below the first."""
    out = F.lit(None).cast("int")
    for i, least in enumerate(bounds):
        out = F.when(depth >= least, i).otherwise(out)
    return out


def _heads(pairs: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """Steps with their head and the bucket of their theorem's greatest depth."""
    deepest = pairs.groupBy("theorem").agg(F.max("depth").alias("deepest"))
    steps = pairs.select("theorem", T.tactic_head(F.col("tactic")).alias("head"))
    return steps.join(deepest, "theorem").withColumn("bucket", bucket_of(F.col("deepest"), bounds)).filter("bucket is not null")


def by_depth(pairs: DataFrame, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """bucket, theorems, pct, cumulative_pct, steps, heads, entropy_bits, top_head, top_pct: theorems by their greatest depth, and how mixed their steps are."""
    steps = _heads(pairs, bounds)
    heads = steps.groupBy("bucket", "head").agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("bucket"))  # a row for each head
    mix = heads.withColumn("share", share).groupBy("bucket").agg(F.sum("n").alias("steps"), F.count("*").alias("heads"), F.sum(-F.col("share") * F.log2("share")).alias("h"))
    top = topk.first_k(heads, ["bucket"], ["less", "head"], 1).select(F.col("bucket").alias("of"), F.col("head").alias("top_head"), F.col("n").alias("most"))
    whole = steps.select("theorem", "bucket").distinct().groupBy("bucket").agg(F.count("*").alias("theorems"))
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # a row for each bucket
    all_ = F.sum("theorems").over(W.partitionBy(F.lit(1)))
    rows = whole.join(mix, "bucket").join(top, F.col("bucket") == F.col("of"))
    return rows.select("bucket", "theorems", r6(100 * F.col("theorems") / all_).alias("pct"), r6(100 * F.sum("theorems").over(upto) / all_).alias("cumulative_pct"), "steps", "heads", r6(F.abs("h")).alias("entropy_bits"), "top_head", r6(100 * F.col("most") / F.col("steps")).alias("top_pct"))


def goal_type(state: Column) -> Column:
    """What the first goal claims: the quantifier it begins with, else its connective, the outermost kind first."""
    target = T.strip(F.regexp_extract(state, "⊢([^\\n]*)", 1))
    kinds = [(target.startswith("∀"), "universal"), (target.startswith("∃"), "existential"), (target.contains("↔"), "iff"), (target.rlike("[≤≥<>]"), "inequality"), (target.contains("∣"), "divisibility"), (target.rlike("(?<!≠)="), "equality")]
    out = F.when(kinds[0][0], kinds[0][1])
    for test, name in kinds[1:]:
        out = out.when(test, name)
    return out.otherwise("other")


def goal_mix(states: DataFrame, state: str) -> DataFrame:
    """type, n, pct of what goals claim."""
    by = states.groupBy(goal_type(F.coalesce(F.col(state), F.lit(""))).alias("type")).agg(F.count("*").alias("n"))
    return by.select("type", "n", r6(100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("pct"))  # a row for each type


def spread(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """For each column its mean, median, 90th, 95th and 99th percentile and greatest value; names are column_what."""
    stats = rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", lambda c: r6(F.avg(c))), ("max", F.max))])
    wanted = {f"{c}_{name}": (c, ranks.linear(p)) for c in columns for name, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))}
    return ranks.beside(stats, ranks.percentiles(rows, wanted, *by), *by).withColumns({name: r6(F.col(name)) for name in wanted})


def sizes(pairs: DataFrame) -> DataFrame:
    """One row: steps by theorem, and characters of states and steps."""
    per = pairs.groupBy("theorem").agg(F.count("*").alias("steps"))
    lengths = pairs.select(F.length(F.coalesce("state", F.lit(""))).cast("long").alias("state"), F.length(F.coalesce("tactic", F.lit(""))).cast("long").alias("tactic"))
    return spread(per, ["steps"]).join(F.broadcast(spread(lengths, ["state", "tactic"])))  # one row each


def lemma_counts(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` commonest dotted names in steps, ties by name."""
    names = F.regexp_extract_all("tactic", F.lit(r"(?U)\b[\p{L}_][\w']*(?:\.[\w']+)+"), F.lit(0))
    return pairs.select(F.explode(names).alias("lemma")).groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(k)


def apportioned(n: int, weights: list[float], available: list[int]) -> list[int]:
    """``n`` seats over buckets by weight, no bucket over what it has: largest remainders first, ties to the earlier bucket.

    What a short bucket leaves goes to the others by their weights. They add up to n, or to all that is available.
    """
    out = [0] * len(weights)
    share = [Fraction(w) for w in weights]
    while (left := min(n, sum(available)) - sum(out)) > 0:
        open_ = [i for i, a in enumerate(available) if out[i] < a]
        if not any(share[i] > 0 for i in open_):
            share = [Fraction(1)] * len(weights)  # buckets of no weight come last, alike
        whole = sum(share[i] for i in open_)
        exact = {i: left * share[i] / whole for i in open_}
        seats = {i: int(x) for i, x in exact.items()}
        for i in sorted(open_, key=lambda i: (seats[i] - exact[i], i))[: left - sum(seats.values())]:
            seats[i] += 1
        for i, s in seats.items():
            out[i] += min(s, available[i] - out[i])
    return out


def stratified_theorems(pairs: DataFrame, n: int, bounds: tuple[int, ...] = BOUNDS, seed: str = "") -> DataFrame:
    """theorem, bucket: ``n`` theorems (all, if there are fewer), the buckets' shares by the entropy of their steps.

    Within a bucket those with the lowest hashes are drawn. A row for each bucket comes to the driver.
    """
    rows = {r.bucket: r for r in by_depth(pairs, bounds).collect()}
    order = sorted(rows)
    quotas = dict(zip(order, apportioned(n, [rows[b].entropy_bits for b in order], [rows[b].theorems for b in order])))
    names = pairs.groupBy("theorem").agg(F.max("depth").alias("deepest")).select("theorem", bucket_of(F.col("deepest"), bounds).alias("bucket"))
    drawn = F.lit(False)
    for b, quota in quotas.items():
        if quota:
            edge = curate.hash_edge(names.filter(F.col("bucket") == b), "theorem", quota, seed)
            drawn = drawn | ((F.col("bucket") == b) & curate.under("theorem", edge, seed))
    return names.filter(drawn)
