"""Collapse of cumulative conversation snapshots, and rendering in a chat template.

Loggers often write a conversation anew after every turn, so that one logged conversation is a
prefix of a longer one. Every turn gets a rolling hash of all turns up to it: two 64-bit hashes of
its place, role and text, combined by exclusive or with those before it in one window pass. A
conversation whose last hash is also that of an inner turn of another is a prefix of it; an
anti-join against the inner hashes leaves the maximal conversations, and of equal ones the one with
the smallest conv_id. Texts are gathered for these alone. Everything is SQL functions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; the order and type of the columns below."""
    c = conversations
    return c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1), a, b, last: a row for each turn, with the rolling hashes after it."""
    own = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turn = F.struct("turn", "role", "text")
    rows = _turns(conversations).withColumn("before", F.lag(turn).over(own)).withColumn("at", F.row_number().over(own))
    new = (F.col("at") == 1) | ~turn.eqNullSafe(F.col("before"))
    rows = rows.withColumn("k", F.sum(new.cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0))).filter(new)
    a = F.xxhash64("k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    b = F.xxhash64("text", F.lit("|"), "role", "k", F.lit(1))
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    return rows.select("conv_id", F.col("k").cast("int").alias("k"), F.bit_xor(a).over(upto).alias("a"), F.bit_xor(b).over(upto).alias("b"), F.lead("k").over(own).isNull().alias("last"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, n_turns of the conversations that are no prefix of another and no copy of one
    with a smaller conv_id, and n_collapsed, the conversations with the same turns or prefixes of them.

    Turns are ordered by (turn, role, text), nulls first; rows that repeat a turn exactly count
    once. Rows without conv_id belong together as one conversation, id null, which counts as the
    largest id. Null roles or texts equal each other only. An empty table gives an empty result;
    further columns are ignored. n_collapsed counts a snapshot under every maximal conversation
    that extends it. A conversation of any length is one row, so its turns must fit a row.
    """
    hashed = materialise(hashed_turns(conversations), "turns")
    # copies: one row for each different conversation
    whole = hashed.filter("last").groupBy("k", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"), F.count("*").alias("copies"))
    inner = hashed.filter(~F.col("last")).select("k", "a", "b").distinct()
    kept = whole.join(inner, ["k", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("kept"), F.col("k").alias("n_turns"))
    kept = materialise(kept, "kept")
    # how many conversations each kept one stands for: its prefixes' copies; only hashes that are some conversation's last ones matter
    own = hashed.join(kept.select("kept"), F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    stands = own.join(whole.select("k", "a", "b", "copies"), ["k", "a", "b"]).groupBy("conv_id").agg((F.sum("copies") - 1).alias("n_collapsed"))
    stands = stands.select(F.col("conv_id").alias("c"), "n_collapsed")
    kept = kept.join(stands, F.col("kept").eqNullSafe(F.col("c"))).select("kept", "n_turns", "n_collapsed")
    texts = _turns(conversations).join(kept.select("kept"), F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    gathered = texts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    gathered = gathered.select("conv_id", F.filter("all", lambda t, i: (i == 0) | ~t.eqNullSafe(F.get("all", i - 1))).alias("turns"))
    return gathered.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", "turns", "n_turns", "n_collapsed")


def rendered(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """The maximal conversations, each in one string of ChatML: conv_id, n_turns, n_collapsed, text.

    A null role renders as ``user``, a null text as empty. A marker within a role or text gets a
    blank after its first character, and line ends within a role become blanks, so that neither can
    forge a turn: the markers of the result are the template's own, whatever the texts nest.
    """
    for m in (start, end):
        # a marker that can begin inside another one would survive being broken up
        if len(m) < 2 or set(m) & set(" \n") or any(m[i:] == o[: len(m) - i] for o in (start, end) for i in range(1, len(m))):
            raise ValueError(f"{m!r} can't serve as a marker")
    broken = lambda m: m[0] + " " + m[1:]
    clean = lambda c: F.replace(F.replace(c, F.lit(start), F.lit(broken(start))), F.lit(end), F.lit(broken(end)))
    one = lambda t: F.concat(F.lit(start), F.coalesce(F.translate(clean(t["role"]), "\n\r", "  "), F.lit("user")), F.lit("\n"), F.coalesce(clean(t["text"]), F.lit("")), F.lit(f"{end}\n"))
    return maximal(conversations).select("conv_id", "n_turns", "n_collapsed", F.array_join(F.transform("turns", one), "").alias("text"))


def op4_query(spark, sf_dir):
    return rendered(table(spark, sf_dir, "conversations"))


#: cuts texts at markers by a pattern, where the query replaces strings
OP4_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n,
         list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || regexp_replace(regexp_replace(role, '<([|]im_(start|end)[|]>)', '< \\1', 'g'), '[\\n\\r]', ' ', 'g') || chr(10) || regexp_replace(text, '<([|]im_(start|end)[|]>)', '< \\1', 'g') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS body
  FROM d GROUP BY conv_id),
kept AS (
  SELECT * FROM c a WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns AND (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id)))
SELECT k.conv_id, CAST(k.n AS INTEGER) AS n_turns,
       (SELECT count(*) - 1 FROM c s WHERE s.turns[1] = k.turns[1] AND s.n <= k.n AND k.turns[1:s.n] = s.turns) AS n_collapsed,
       k.body AS text
FROM kept k
"""
