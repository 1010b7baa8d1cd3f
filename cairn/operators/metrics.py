"""Embedding separation and contrastive losses."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import ranks, scans
from .analytics import r6


def centroids(v: DataFrame, by: str) -> DataFrame:
    """dim, mean of each group's vectors."""
    return v.select(by, F.posexplode("embedding").alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def separation(v: DataFrame, positive: str) -> DataFrame:
    """One row: counts, mean norms, their gap (negative - positive), distance of the centroids."""
    c = centroids(v, positive).groupBy("dim").agg(F.max(F.when(F.col(positive), F.col("mean"))).alias("p"), F.max(F.when(~F.col(positive), F.col("mean"))).alias("n"))
    gap = c.agg(F.sqrt(F.sum((F.col("p") - F.col("n")) * (F.col("p") - F.col("n")))).alias("l2"))
    n = V.norm(F.col("embedding"))
    sizes = v.agg(F.count_if(positive).alias("positives"), F.count_if(~F.col(positive)).alias("negatives"), F.avg(F.when(F.col(positive), n)).alias("pn"), F.avg(F.when(~F.col(positive), n)).alias("nn"))
    return sizes.join(gap).select("positives", "negatives", r6(F.col("pn")).alias("positive_norm"), r6(F.col("nn")).alias("negative_norm"), r6(F.col("nn") - F.col("pn")).alias("norm_gap"), r6(F.col("l2")).alias("centroid_l2"))


def probe_accuracy(v: DataFrame, positive: str) -> DataFrame:
    """Projects on the line between the centroids and cuts at the mean projection: one row, accuracy."""
    c = centroids(v, positive).groupBy("dim").agg((F.max(F.when(F.col(positive), F.col("mean"))) - F.max(F.when(~F.col(positive), F.col("mean")))).alias("d"))
    axis = c.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "d"))), lambda r: r["d"]).alias("axis"))
    scored = v.join(F.broadcast(axis)).select(positive, V.dot(F.col("embedding"), F.col("axis")).alias("s"))
    mean = scored.agg(F.avg("s").alias("m"))
    return scored.join(F.broadcast(mean)).agg(r6(F.avg(((F.col("s") > F.col("m")) == F.col(positive)).cast("int"))).alias("accuracy"))


def group_similarity(v: DataFrame, by: str, key: str) -> DataFrame:
    """Mean cosine of all pairs within each group, from the sum of its unit vectors: no pair is formed.

    The squared length of that sum is n plus twice the cosines of all pairs.
    """
    unit = v.withColumn("len", V.norm(F.col("embedding"))).filter("len >= 1e-10").select(by, "len", F.posexplode("embedding").alias("dim", "x"))
    sums = unit.groupBy(by, "dim").agg(F.sum(F.col("x").cast("double") / F.col("len")).alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n")).filter("n > 1")
    return out.select(by, "n", r6((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def _unit(v: DataFrame, *columns: str) -> DataFrame:
    """``u``: the vector at length 1, in double precision; all zeros where it has no length, which makes its cosines 0."""
    length = V.norm(F.col("embedding"))
    unit = F.when(length < 1e-10, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.transform("embedding", lambda x: x.cast("double") / length))
    return v.select(*columns, unit.alias("u"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, population deviation, least, the values at places n / 10, n / 2 and 9 n / 10 (rounded down), most."""
    stats = rows.groupBy(*by).agg(F.count(value).alias("n"), r6(F.avg(value)).alias("mean"), r6(F.stddev_pop(value)).alias("std"), r6(F.min(value)).alias("least"), r6(F.max(value)).alias("most"))
    found = ranks.percentiles(rows, {"p10": (value, ranks.part(1, 10)), "p50": (value, ranks.part(1, 2)), "p90": (value, ranks.part(9, 10))}, *by)
    return ranks.beside(stats, found.withColumns({c: r6(F.col(c)) for c in ("p10", "p50", "p90")}), *by)


def pair_similarities(v: DataFrame, group: str, key: str, positive: str) -> DataFrame:
    """kind, n, mean, std, least, p10, p50, p90, most of the cosines, and l2 (mean distance), of pairs within a group.

    kind is ``positive`` or ``negative`` for pairs of one label, each once, ``mixed`` for the others.
    Groups are theorems, which a search's budget bounds; vectors without length have cosine 0. Where only
    mean and deviation are wanted, :func:`pair_moments` has them without forming pairs.
    """
    rows = _unit(v, group, key, positive)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    p, q = F.col(f"a.{positive}"), F.col(f"b.{positive}")
    pairs = pairs.select(F.when(p & q, "positive").when(p | q, "mixed").otherwise("negative").alias("kind"), V.dot(F.col("a.u"), F.col("b.u")).alias("c"), V.distance(F.col("a.e"), F.col("b.e")).alias("d"))
    return ranks.beside(_spread(pairs, "c", "kind"), pairs.groupBy("kind").agg(r6(F.avg("d")).alias("l2")), "kind")


def _moments(v: DataFrame, group: str, positive: str) -> DataFrame:
    """g, p, at, x: for each group and label the sum of its unit vectors (at < d), then the upper triangle of the sum of their outer products, then how many there are and how many of them have a length.

    A task adds up what it meets; sums of tasks are added by place.
    """
    def run(frames):
        held = {}
        for frame in frames:
            for (g, p), part in frame.groupby(["g", "p"], dropna=False):
                u = np.array(part["u"].tolist(), np.float64)
                m = u.T @ u
                sums = np.concatenate([u.sum(0), m[np.triu_indices(len(m))], [len(u), float((u != 0).any(1).sum())]])
                known = held.get((g, p))
                held[g, p] = sums if known is None else known + sums
            if len(held) * len(next(iter(held.values()), [])) > 2_000_000:
                yield from send(held)
                held = {}
        yield from send(held)

    def send(held):
        for (g, p), x in held.items():
            yield pd.DataFrame({"g": g, "p": p, "at": np.arange(len(x)), "x": x})

    sent = _unit(v, F.col(group).cast("string").alias("g"), F.col(positive).alias("p")).select("g", "p", "u").filter("g is not null and p is not null and u is not null")
    return sent.mapInPandas(run, "g string, p boolean, at int, x double").groupBy("g", "p", "at").agg(F.sum("x").alias("x"))


def pair_moments(v: DataFrame, group: str, positive: str) -> DataFrame:
    """kind, n, mean, std of the cosines of all pairs within groups, as in :func:`pair_similarities`, from moments: no pair is formed.

    The cosines of all ordered pairs add up to the squared length of the sum of unit vectors, their squares to the
    squared norm of the sum of outer products; between two labels products of the two labels' moments take
    the squares' place. Vectors have one length d; a group costs (d + 1)(d + 2) / 2 numbers a task, however large it is.
    Rows without group, label or vector take no part.
    """
    d = v.select(F.max(F.size("embedding")).alias("d")).first()[0] or 0
    most = d + d * (d + 1) // 2
    # places on the diagonal of the triangle count once, others twice
    diagonal = F.array(*[F.lit(d + k * d - k * (k - 1) // 2) for k in range(d)]) if d else F.array().cast("array<int>")
    m = _moments(v, group, positive)
    weight = F.when(F.col("at") < d, F.lit(0.0)).when(F.array_contains(diagonal, F.col("at")), 1.0).otherwise(2.0)
    wide = m.groupBy("g", "at").agg(F.coalesce(F.sum(F.when(F.col("p"), F.col("x"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(~F.col("p"), F.col("x"))), F.lit(0.0)).alias("b"))
    a, b, first, inner = F.col("a"), F.col("b"), F.col("at") < d, (F.col("at") >= d) & (F.col("at") < most)
    sums = wide.groupBy("g").agg(*[F.sum(F.when(first, x)).alias(f"s_{n}") for n, x in (("aa", a * a), ("bb", b * b), ("ab", a * b))], *[F.sum(F.when(inner, weight * x)).alias(f"q_{n}") for n, x in (("aa", a * a), ("bb", b * b), ("ab", a * b))],
                                 *[F.max(F.when(F.col("at") == most + k, x)).alias(f"{n}_{y}") for k, n in ((0, "n"), (1, "l")) for y, x in (("a", a), ("b", b))])
    c = F.col
    kinds = [("positive", c("n_a") * (c("n_a") - 1) / 2, (c("s_aa") - c("l_a")) / 2, (c("q_aa") - c("l_a")) / 2), ("negative", c("n_b") * (c("n_b") - 1) / 2, (c("s_bb") - c("l_b")) / 2, (c("q_bb") - c("l_b")) / 2), ("mixed", c("n_a") * c("n_b"), c("s_ab"), c("q_ab"))]
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n"), s.alias("s"), q.alias("q")) for k, n, s, q in kinds])).alias("x")).groupBy("x.kind").agg(*[F.sum(f"x.{y}").alias(y) for y in ("n", "s", "q")]).filter("n > 0")
    mean = c("s") / c("n")
    return each.select("kind", c("n").cast("long").alias("n"), r6(mean).alias("mean"), r6(F.sqrt(F.greatest(c("q") / c("n") - mean * mean, F.lit(0.0)))).alias("std"))


def drawn_similarities(v: DataFrame, key: str, most: int = 5000, seed: int = 0) -> DataFrame:
    """One row: n, mean, std, least, p10, p50, p90, most of the cosines of min(most, all) pairs drawn from all vectors.

    Vectors are numbered by ``key``, which tells them apart; both sides of a draw come from a hash of its number, draws of
    a vector with itself are left out, as is usual. The draw is the feature: it stays as large, whatever the table.
    """
    n = v.count()
    pairs = min(most, n * (n - 1) // 2)
    rows = scans.numbered(_unit(v, key), "at_", [key])
    side = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(name)), F.lit(max(1, n)))
    drawn = v.sparkSession.range(pairs).select("id", side("left").alias("i"), side("right").alias("j")).filter("i <> j")
    one = rows.select(F.col("at_").alias("i"), F.col("u").alias("a")).join(F.broadcast(drawn), "i")  # ``most`` rows of three numbers
    both = rows.select(F.col("at_").alias("j"), F.col("u").alias("b")).join(one, "j")
    return _spread(both.select(V.dot(F.col("a"), F.col("b")).alias("c")), "c")


def sampled_accuracy(v: DataFrame, score: str, positive: str, most: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: gap (mean score of positives less that of others), pairs, accuracy: of up to ``most`` drawn pairs of a positive and another
    the share whose positive scores higher."""
    gap = v.agg((F.avg(F.when(F.col(positive), F.col(score))) - F.avg(F.when(~F.col(positive), F.col(score)))).alias("g"), F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    sizes = gap.first()
    pairs = min(most, sizes.p * sizes.n)
    side = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(name)), F.lit(max(1, n)))
    drawn = v.sparkSession.range(pairs).select(side("good", sizes.p).alias("i"), side("bad", sizes.n).alias("j"))
    rows = scans.numbered(v.select(F.col(positive).alias("ok"), F.col(score).alias("s"), F.monotonically_increasing_id().alias("row")).filter("ok is not null"), "at_", ["s", "row"], ["ok"])
    good = rows.filter("ok").select(F.col("at_").alias("i"), F.col("s").alias("a"))
    bad = rows.filter("not ok").select(F.col("at_").alias("j"), F.col("s").alias("b"))
    met = good.join(F.broadcast(drawn), "i")  # ``most`` rows of two numbers
    hits = bad.join(met, "j").agg(F.count("*").alias("pairs"), r6(F.avg((F.col("a") > F.col("b")).cast("int"))).alias("accuracy"))
    return gap.select(r6(F.col("g")).alias("gap")).join(F.broadcast(hits))


def cosine_gap(v: DataFrame, key: str, positive: str, most: int = 100) -> DataFrame:
    """One row: mean cosine within the first ``most`` positives by key, that between them and as many negatives, and the gap.

    The samples are the feature: two bounded lists of vectors are compared, whatever the table.
    """
    rows = v.select(key, positive, F.col("embedding").alias("e"), V.norm(F.col("embedding")).alias("len"))
    first = lambda ok, k=most: rows.filter(F.col(positive) == ok).orderBy(key).limit(k)
    k = min(first(True).count(), first(False).count())
    cosine = V.dot(F.col("a.e"), F.col("b.e")) / (F.greatest(F.col("a.len"), F.lit(1e-9)) * F.greatest(F.col("b.len"), F.lit(1e-9)))
    within = first(True).alias("a").join(F.broadcast(first(True).alias("b")), F.col(f"a.{key}") != F.col(f"b.{key}")).agg(F.avg(cosine).alias("within"))
    cross = first(True, k).alias("a").crossJoin(F.broadcast(first(False, k).alias("b"))).agg(F.avg(cosine).alias("cross"))
    return within.crossJoin(F.broadcast(cross)).select(r6(F.col("within")).alias("within"), r6(F.col("cross")).alias("cross"), r6(F.col("within") - F.col("cross")).alias("gap"))


def energy_metrics(e: DataFrame, margin: float = 1.0) -> DataFrame:
    """e: energies (array; the positive's first). Means, gap, rank and pairwise accuracy, active share, spread, losses."""
    pos, neg = F.col("energies")[0], F.slice("energies", 2, F.greatest(F.size("energies") - 1, F.lit(0)))
    rows = e.select(pos.alias("pos"), neg.alias("neg"), V.info_nce(F.col("energies")).alias("nce"), "energies").select(
        "pos", "nce", "energies", F.size("neg").alias("k"), V.total(F.col("neg")).alias("ns"), (F.col("pos") < F.array_min("neg")).cast("int").alias("first"),
        F.size(F.filter("neg", lambda x: F.col("pos") < x)).alias("below"), F.filter(F.transform("neg", lambda x: margin + F.col("pos") - x), lambda h: h > 0).alias("active"))
    square = lambda c: V.total(F.transform(c, lambda x: x * x))
    a = rows.agg(F.avg("pos").alias("pm"), (F.sum("ns") / F.sum("k")).alias("nm"), F.avg("first").alias("r"), (F.sum("below") / F.sum("k")).alias("pw"), (F.sum(F.size("active")) / F.sum("k")).alias("af"),
                 F.avg("nce").alias("nce"), (F.sum(V.total(F.col("active"))) / (F.sum(F.size("active")) + 1e-8)).alias("hinge"), (F.sum(F.col("pos") + F.col("ns")) / F.sum(F.col("k") + 1)).alias("m"), (F.sum(square(F.col("energies"))) / F.sum(F.col("k") + 1)).alias("sq"))
    return a.select(r6(F.col("pm")).alias("pos_mean"), r6(F.col("nm")).alias("neg_mean"), r6(F.col("nm") - F.col("pm")).alias("gap"), r6(F.col("r")).alias("rank_accuracy"), r6(F.col("pw")).alias("pairwise_accuracy"), r6(F.col("af")).alias("active_fraction"),
                    r6(F.sqrt(F.greatest(F.col("sq") - F.col("m") * F.col("m"), F.lit(0.0)))).alias("std"), r6(F.col("nce")).alias("info_nce"), r6(F.col("hinge")).alias("margin_loss"))


def health(m: DataFrame) -> DataFrame:
    """Adds warnings to rows with energy_std, energy_gap, rank_accuracy, contrastive_loss, pos_energy_mean, neg_energy_mean, loss, active_fraction."""
    c = F.col
    rules = [
        (c("energy_std") < 0.1, "energies hardly vary"),
        (c("energy_gap") < 0, "negatives score better than positives on average"),
        ((c("rank_accuracy") > 0.95) & (c("contrastive_loss") > 0.5), "ranks are nearly all right but the loss stays high"),
        ((c("pos_energy_mean") > 0) & (c("neg_energy_mean") < 0), "the signs of both means are the wrong way round"),
        (F.isnan("loss") | (F.abs("loss") == float("inf")), "the loss isn't a finite number"),
        (c("active_fraction") < 0.01, "hardly a pair is within the margin"),
    ]
    return m.withColumn("warnings", F.array_compact(F.array(*[F.when(t, F.lit(w)) for t, w in rules])))


def energies(weights: dict, log_temperature: float = 0.0):
    """A column function from embeddings to energies of a small network: three Linear-SiLU layers and a Linear.

    weights: w1, b1 ... w4, b4 as numpy arrays (w: inputs x outputs). The score is the negated energy.
    """
    t = float(np.exp(np.clip(log_temperature, -5, 2)))

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        h = np.array(x.tolist(), np.float64)
        for i in (1, 2, 3):
            z = h @ weights[f"w{i}"] + weights[f"b{i}"]
            h = z / (1 + np.exp(-z))
        return pd.Series((h @ weights["w4"] + weights["b4"]).ravel() / t)

    return run


def spectral_norm(w, rounds: int = 5):
    """The largest singular value by power iteration, on the driver: weights are small."""
    u = np.ones(w.shape[0]) / np.sqrt(w.shape[0])
    for _ in range(rounds):
        v = w.T @ u
        v /= np.linalg.norm(v) + 1e-12
        u = w @ v
        u /= np.linalg.norm(u) + 1e-12
    return float(u @ w @ v)


def depth_loss(e: DataFrame, energy: str = "energy", remaining: str = "remaining_depth") -> DataFrame:
    """depth_loss: mean square of energy less remaining depth over the greatest one (1 at least); rows below 0 don't count; 0 if none do."""
    top = F.greatest(F.max(remaining), F.lit(1))
    # sum((e - d / t)^2) from sums, as the greatest depth is known only at the end
    ok = F.col(remaining) >= 0
    on = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    x, d = F.col(energy), F.col(remaining)
    total = on(x * x) - 2 * on(x * d) / top + on(d * d) / (top * top)
    return e.agg(F.coalesce(r6(total / F.nullif(F.count_if(ok), F.lit(0))), F.lit(0.0)).alias("depth_loss"))
