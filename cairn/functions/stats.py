"""Statistics over scores; order statistics are in ``operators.ranks``."""
from __future__ import annotations

from pyspark.sql import functions as F


def auc(score: str, positive: str, df, cuts: int = 200):
    """Area under the ROC curve by rank sums, ties at their mean rank: one row, column auc.

    Ranks come from counts of different scores, summed up in two levels: within stretches between
    ``cuts`` approximate quantiles, and over the stretches. So no task orders all scores.
    """
    from pyspark.sql import Window as W

    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("p"))
    marks = sorted(set(by.agg(F.percentile_approx("s", [(k + 1) / (cuts + 1) for k in range(cuts)], 1000)).first()[0] or []))
    stretch = F.size(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda m: m < F.col("s"))) if marks else F.lit(0)
    by = by.withColumn("k", stretch)
    whole = by.groupBy("k").agg(F.sum("n").alias("all"))
    whole = whole.select(F.col("k").alias("k2"), (F.sum("all").over(W.orderBy("k")) - F.col("all")).alias("below"))  # a row a stretch
    inside = by.withColumn("before", F.sum("n").over(W.partitionBy("k").orderBy("s")) - F.col("n"))
    ranked = inside.join(F.broadcast(whole), F.col("k") == F.col("k2")).withColumn("before", F.col("before") + F.col("below"))
    agg = ranked.agg(F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"), F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"))
    return agg.select(F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"))
