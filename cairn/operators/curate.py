"""Curation of training pairs: filters, deduplication, splits, samples, packing.

Draws that the usual scripts make with a random stream go by hashes of keys here: the same rows
are drawn however the data are partitioned.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import scans

#: fixed values: steps too common to keep them all
TRIVIAL = ["rfl", "trivial", "decide", "norm_num", "ring", "omega", "simp", "aesop"]
#: rows that are sorted to find the last one drawn
_EDGE = 10_000


def hash_fraction(key: Column, seed: str = "") -> Column:
    """A number from 0 to 1 by the key's md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0


def split_of(key: Column, share: float = 0.05) -> Column:
    return F.when(hash_fraction(key) < share, "val").otherwise("train")


def sft_filter(pairs: DataFrame, state: str, tactic: str, order: str) -> DataFrame:
    """Adds reason: empty, sorry, duplicate, or kept; the first of equal pairs by ``order`` is kept."""
    s, t = T.strip(F.coalesce(state, F.lit(""))), T.strip(F.coalesce(tactic, F.lit("")))
    rows = pairs.withColumn("s_", s).withColumn("t_", t).withColumn("why_", F.when((F.col("s_") == "") | (F.col("t_") == ""), "empty").when(F.col("t_").contains("sorry"), "sorry"))
    rank = F.row_number().over(W.partitionBy("s_", "t_", F.col("why_").isNull()).orderBy(order))
    return rows.withColumn("reason", F.coalesce("why_", F.when(rank > 1, "duplicate").otherwise("kept"))).drop("s_", "t_", "why_")


def without_banned(pairs: DataFrame, key: str, tactic: str, words: tuple[str, ...]) -> DataFrame:
    """Without all rows of a key of which one holds a banned word."""
    bad = pairs.filter(T.gives_up_by_substring(F.col(tactic), words)).select(key).distinct()
    return pairs.join(bad, key, "left_anti")


def short_states(pairs: DataFrame, state: str, most: int = 4096) -> DataFrame:
    return pairs.filter(F.length(state) <= most)


def thinned(pairs: DataFrame, tactic: str, key: Column, share: float = 0.1) -> DataFrame:
    """Keeps a share of the trivial steps."""
    return pairs.filter(~T.strip(F.col(tactic)).isin(*TRIVIAL) | (hash_fraction(key) < share))


def with_depth(pairs: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds depth: the place within the key, from 0, by ``order`` (as strings, so lexicographic)."""
    return pairs.withColumn("depth", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def complete_groups(pairs: DataFrame, key: str, depth: str, least: int = 1, sample: int | None = None, seed: str = "") -> DataFrame:
    """Keys whose depths are 0 to n - 1, each once, with n of ``least`` or more; ``sample`` of them, those with the lowest hashes, if given."""
    by = pairs.groupBy(key).agg(F.min(depth).alias("a"), F.max(depth).alias("b"), F.count("*").alias("n"), F.count_distinct(depth).alias("d"))
    whole = by.filter((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n")) & (F.col("n") >= least)).select(key, "n")
    return whole if sample is None else hash_sample(whole, key, sample, seed)


def deep_keys(pairs: DataFrame, key: str, depth: str, least: int) -> DataFrame:
    return pairs.groupBy(key).agg(F.max(depth).alias("max_depth")).filter(F.col("max_depth") >= least)


def remaining_depth(pairs: DataFrame, key: str, depth: str) -> DataFrame:
    return pairs.withColumn("remaining_depth", F.max(depth).over(W.partitionBy(key)) - F.col(depth))


def separation_probe(states: DataFrame, state: str, label: str, depth: str, order: list[str]) -> DataFrame:
    """state, label: different stripped states deeper than 1 that aren't blank, each with the label of its first row by ``order``.

    Rows of other labels count when the first is chosen, and go then.
    """
    rows = states.filter(F.col(depth) > 1).select(T.strip(F.coalesce(F.col(state), F.lit(""))).alias("state"), F.col(label).alias("label"), F.struct(*order).alias("at")).filter("state <> ''")
    return rows.groupBy("state").agg(F.min_by("label", "at").alias("label")).filter("label IN ('positive', 'negative')")


def deepest(pairs: DataFrame, depth: str, *by: str) -> DataFrame:
    """The greatest depth of each key."""
    return pairs.groupBy(*by).agg(F.max(depth).alias("max_depth"))


def distinct_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return rows.withColumn("rn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def numbered_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds unique_name: repeats of a name get __dup1, __dup2 ..."""
    n = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    return rows.withColumn("unique_name", F.when(n > 0, F.concat(F.col(name), F.lit("__dup"), n.cast("string"))).otherwise(F.col(name)))


def _hash(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def hash_edge(rows: DataFrame, key: str, n: int, seed: str = ""):
    """The ``n``-th smallest (hash, key) of all rows, as a Row; None if there are no more than ``n``.

    Ranges of hashes are counted, the one that holds the ``n``-th is counted more finely, until few rows are
    left to sort: a pass leaves 65,536 counts at most, and no row is shuffled.
    """
    h, prefix, left = _hash(key, seed), "", n
    while True:
        inside = rows.filter(h.startswith(prefix))
        counts = inside.groupBy(F.substring(h, len(prefix) + 1, 4).alias("next")).agg(F.count("*").alias("n")).orderBy("next").collect()
        if not prefix and sum(c.n for c in counts) <= n:
            return None
        for c in counts:
            if left <= c.n:
                break
            left -= c.n
        prefix += c.next
        if c.n <= _EDGE or len(prefix) == 32:
            break
    edge = rows.filter(h.startswith(prefix)).groupBy(h.alias("hash"), key).agg(F.count("*").alias("n")).orderBy("hash", key).limit(_EDGE).collect()
    for e in edge:
        left -= e.n
        if left <= 0:
            return e
    raise ArithmeticError("too many keys share a hash")


def under(key: str, edge, seed: str = "") -> Column:
    """Whether a row's (hash, key) is at or below the edge."""
    if edge is None:
        return F.lit(True)
    h = _hash(key, seed)
    return (h < edge["hash"]) | ((h == edge["hash"]) & (F.col(key) <= F.lit(edge[key])))


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "", *by: str) -> DataFrame:
    """``n`` rows (of each ``by``): those with the lowest hashes, ties by key; all, where there are no more.

    Keys should be unique: without ``by`` rows that share the last one drawn come together. Null keys are never drawn
    without ``by``. With ``by``, counted hash ranges leave little more than ``n`` rows of a group to be sorted.
    """
    if n < 1:
        return rows.limit(0)
    if not by:
        rows = rows.filter(F.col(key).isNotNull())
        return rows.filter(under(key, hash_edge(rows, key, n, seed), seed))
    groups = F.struct(*[F.col(c) for c in by])
    marked = rows.withColumn("h_", _hash(key, seed)).withColumn("g_", groups).withColumn("p_", F.coalesce(F.substring("h_", 1, 3), F.lit("")))
    upto = marked.groupBy("g_", "p_").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("g_").orderBy("p_")) - F.col("n"))  # 4,097 rows a group at most
    last = upto.filter(F.col("before") < n).groupBy(F.col("g_").alias("of_")).agg(F.max("p_").alias("last_"))
    near = marked.join(last, (F.col("g_") == F.col("of_")) & (F.col("p_") <= F.col("last_")))
    return near.withColumn("rn_", F.row_number().over(W.partitionBy("g_").orderBy("h_", key))).filter(F.col("rn_") <= n).select(*rows.columns)


def validation_split(names: DataFrame, key: str, share: float = 0.1, seed: str = "") -> DataFrame:
    """Adds is_val to distinct keys: round(n * share) of them, the lowest hashes."""
    n = int(names.count() * share + 0.5)
    return names.withColumn("is_val", F.coalesce(under(key, hash_edge(names, key, n, seed), seed), F.lit(False)) if n else F.lit(False))


def systematic_sample(ids: DataFrame, key: str, k: int) -> DataFrame:
    """Every max(1, n // k)-th of the sorted ids, the first ``k`` of them."""
    step = max(1, ids.count() // k)
    return ranked(ids, key).filter((F.col("rank_") % step == 0) & (F.col("rank_") < k * step)).drop("rank_")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds rank_, the place by ``key`` from 0."""
    return scans.numbered(rows, "rank_", [key])


def chunk_of(rank: Column, n: int, k: int) -> Column:
    """Contiguous chunks of ceil(n / k) rows; the last may be short or missing."""
    return F.floor(rank / -(-n // k)).cast("int")


def packed(rows: DataFrame, key: str, tokens: str, length: int, eos: int, *by: str) -> DataFrame:
    """Streams of tokens, an end token after each row, cut into runs of ``length``; the rest is dropped.

    Labels are the tokens, but -100 for end tokens. Runs are made within each ``by``; see :func:`scans.packed`.
    """
    return scans.packed(rows, tokens, length, eos, [key], by)


def completion_labels(tokens: Column, template: list[int]) -> Column:
    """-100 up to the end of the first match of the template; all of a sequence without one."""
    t, n = F.array(*[F.lit(x) for x in template]), len(template)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, F.lit(n)) == t)
    end = F.when(F.size(starts) > 0, F.element_at(starts, 1) + n - 1).otherwise(F.size(tokens))
    return F.transform(tokens, lambda x, i: F.when(i < end, -100).otherwise(x))


def contrastive_samples(records: DataFrame, n: int, k: int, hard: float = 0.3, medium: float = 0.4, seed: int = 0) -> DataFrame:
    """sample, slot (0 positive, then negatives), tier, theorem_name, state_id: ``n`` samples of ``k`` negatives.

    records: theorem_name, state_id, label, parent_state_id. A theorem is drawn, then a positive of
    it; then round(k * hard) negatives beside a positive, round(k * medium) others of the theorem,
    the rest from other theorems; draws that a tier can't supply fall to the next one.
    """
    from .tree import negative_tiers

    tiers = negative_tiers(records)
    half_up = lambda x: int(x + 0.5)
    n_hard, n_medium = half_up(k * hard), half_up(k * medium)
    draw = lambda what, m: F.pmod(F.xxhash64(F.lit(seed), F.col("sample"), F.col("slot"), F.lit(what)), m)
    numbered = tiers.filter("label = 'positive' OR tier is not null").withColumn("kind", F.coalesce("tier", F.lit("positive")))
    numbered = numbered.withColumn("i", F.row_number().over(W.partitionBy("theorem_name", "kind").orderBy("state_id")) - 1).select("theorem_name", "kind", "i", "state_id")
    counts = numbered.groupBy("theorem_name").agg(*[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in ("positive", "sibling", "other")])
    names = ranked(counts.filter("n_positive > 0 AND n_sibling + n_other > 0").select("theorem_name"), "theorem_name").withColumnRenamed("theorem_name", "owner").withColumnRenamed("rank_", "t")
    total = names.count()
    if not total:
        return records.sparkSession.createDataFrame([], "sample long, slot int, tier string, theorem_name string, state_id long")
    slots = records.sparkSession.range(n).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("slot"))
    owned = slots.withColumn("t", F.pmod(F.xxhash64(F.lit(seed), F.col("sample")), F.lit(total))).join(names, "t")
    c = owned.join(counts.withColumnRenamed("theorem_name", "owner"), "owner")
    wanted = F.when(F.col("slot") == 0, "positive").when(F.col("slot") <= n_hard, "sibling").when(F.col("slot") <= n_hard + n_medium, "other").otherwise("easy")
    kind = F.when((wanted == "sibling") & (F.col("n_sibling") == 0), "other").otherwise(wanted)
    kind = F.when((kind == "other") & (F.col("n_other") == 0), "easy").otherwise(kind)
    c = c.withColumn("tier", kind).withColumn("t2", F.when((kind == "easy") & (F.lit(total) > 1), F.pmod(F.col("t") + 1 + draw("far", F.lit(max(1, total - 1))), F.lit(total))).otherwise(F.col("t"))).drop("n_positive", "n_sibling", "n_other")
    c = c.join(names.select(F.col("t").alias("t2"), F.col("owner").alias("theorem_name")), "t2").join(counts, "theorem_name")
    source = F.when(F.col("tier") != "easy", F.col("tier")).when(F.col("n_other") > 0, "other").otherwise("sibling")
    c = c.withColumn("kind", source).withColumn("i", draw("row", F.when(source == "positive", F.col("n_positive")).when(source == "sibling", F.col("n_sibling")).otherwise(F.col("n_other"))).cast("int"))
    return c.join(numbered, ["theorem_name", "kind", "i"]).select("sample", "slot", "tier", "theorem_name", "state_id")


def depth_quotas(rows: DataFrame, key: str, depth: str, quotas: list[tuple[int, int]], seed: str = "") -> DataFrame:
    """By depth bucket, given as (least depth, rows to keep) in rising order, the rows with the smallest key hashes.

    Depths below the first bucket are left out.
    """
    bucket, keep = F.lit(None).cast("int"), F.lit(0)
    for i, (least, n) in enumerate(quotas):
        bucket, keep = F.when(F.col(depth) >= least, i).otherwise(bucket), F.when(F.col(depth) >= least, n).otherwise(keep)
    order = W.partitionBy("_bucket").orderBy(hash_fraction(F.col(key).cast("string"), seed), key)
    marked = rows.withColumn("_bucket", bucket).withColumn("_keep", keep).filter("_bucket is not null")
    return marked.withColumn("_n", F.row_number().over(order)).filter("_n <= _keep").drop("_bucket", "_keep", "_n")


def renamed_references(references: DataFrame, renames: DataFrame) -> DataFrame:
    """References (lemma, n) that are an old name or end with one behind a dot: lemma, n, old, new.

    Every ending of a lemma is looked up, so the join has a key.
    """
    parts = F.split("lemma", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return references.select("lemma", "n", F.explode(ends).alias("old")).join(renames.select("old", "new"), "old").select("lemma", "n", "old", "new")


def extended_skip_list(names: DataFrame, failing: DataFrame, name: str = "name") -> DataFrame:
    """The list with failing names added, each once."""
    return names.select(name).unionByName(failing.select(name)).filter(F.col(name).isNotNull()).distinct()
