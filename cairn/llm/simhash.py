"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the per-bit majority of the XXH64 hashes (seed 42) of its 3-word
shingles. Only distinct fingerprints are searched. The 64 bits are cut into two segments of 32;
two fingerprints at distance 2 or less differ by at most 1 in the upper segment, or not at all in
the lower one (1 + 1 > 2), so the search enumerates the ball of radius 1 around the upper segment
and the ball of radius 0 around the lower one, fetches the table's matches for each probe, and
keeps those whose whole distance is 2 or less. Of a pair whose upper segments differ by one bit,
only the side with that bit clear probes. The distance test is part of the join condition, so
candidates never leave the join; a fingerprint has at most 2,080 others in reach, so the rows
that do leave it are bounded by that multiple of the distinct fingerprints, whatever the groups.
"""
from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, each_text, materialise

#: by byte value, its eight bits from the lowest up
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of one UTF-8 text's shingles in order; no words: none; fewer than ``shingle``: of the whole sequence."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # on bytes: A-Z only, and the blanks 0x20 and 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends]]
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text; no words: zero; fewer than ``shingle``: the whole sequence."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of 64 bits times ``words``: the majorities of the hashes, and of the hashes mixed anew for each further word."""
    x = hashes[None, :] + np.arange(words, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x[1:] = (x[1:] ^ (x[1:] >> np.uint64(shift))) * np.uint64(factor)
    places = x.view(np.uint8).reshape(words, -1, 8) + (np.arange(words * 8) * 256).reshape(words, 1, 8)
    counts = np.bincount(places.ravel(), minlength=words * 2048).reshape(words * 8, 256).astype(float) @ _BITS.astype(float)
    return np.packbits(counts.reshape(words, 64) * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) for every row; null texts count as empty."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in each_text(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at distance 1 or 2, each pair once or more."""
    seg = lambda c: F.shiftrightunsigned(c, 32)
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    table = fps.select(F.explode(F.array(
        F.struct(F.lit(1).alias("s"), seg(F.col("fp")).alias("k")),
        F.struct(F.lit(0).alias("s"), low(F.col("fp")).alias("k")))).alias("e"), F.col("fp").alias("b")).select("e.s", "e.k", "b")
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(seg(F.col("fp")), i) == 0),
        lambda i: F.struct(F.lit(1).alias("s"), seg(F.col("fp")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("k"), F.lit(True).alias("flip")))
    same = F.array(
        F.struct(F.lit(1).alias("s"), seg(F.col("fp")).alias("k"), F.lit(False).alias("flip")),
        F.struct(F.lit(0).alias("s"), low(F.col("fp")).alias("k"), F.lit(False).alias("flip")))
    probes = fps.select(F.explode(F.concat(same, flips)).alias("e"), F.col("fp").alias("a")).select("e.s", "e.k", "e.flip", "a")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2) & (F.col("a") != F.col("b")) & (F.col("flip") | (F.col("a") < F.col("b")))
    return probes.hint("merge").join(table, (probes.s == table.s) & (probes.k == table.k) & near).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of an undirected edge list (a, b).

    Alternating large-star and small-star rounds, each written to the shared folder; the rounds
    needed grow with the logarithm of the nodes, and only two numbers a round reach the driver.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialise(small, "edges")
        seen = after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        discard(edges)
        edges = after
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the document itself included. Null texts
    and texts without words have fingerprint zero and link like others; repeated rows come out
    repeated; a null doc_id stays and is never the smallest unless it is alone (then null). An
    empty table gives an empty result; further columns are ignored.
    """
    return rooted(docs).drop("root")


def rooted(docs: DataFrame) -> DataFrame:
    """:func:`simhash_groups` with ``root``, which tells groups apart even if no document of them has an id."""
    marked = materialise(fingerprints(docs), "fps")
    return by_roots(marked, lambda distinct: components(links(distinct.select("fp"))))


def by_roots(marked: DataFrame, roots_of) -> DataFrame:
    """doc_id, fp, root, component_id of every row of ``marked`` (doc_id, fp); ``roots_of`` turns the distinct fp into (node, root) of those that are linked."""
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = roots_of(distinct)
    owner = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = materialise(owner, "owner")
    discard(distinct, roots)
    lowest = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = owner.join(lowest, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return marked.hint("merge").join(owner.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", "fp", "root", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame | None = None, mark=None) -> DataFrame:
    """The documents of which one row of each group stays: that with the smallest doc_id, null ids last.

    ``groups`` (doc_id, fp, root) are those of :func:`rooted` by default; ``mark`` gives the fp of
    (row, text), as :func:`marked_rows` does with :func:`fingerprint`. Of rows with the same doc_id
    that one stays whose fp is smallest, of those with the same fp too the one with the smallest
    hash of its columns; of rows that repeat throughout, one. So a row goes only if another of its
    own group stays, whatever ids repeat. Columns and their names are those of ``docs``.
    """
    own = materialise(rooted(docs) if groups is None else groups, "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    first = materialise(own.groupBy("root").agg(F.min(rank).alias("first")).select("first.*"), "first")
    counts = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    again = materialise(counts.filter("n > 1 or doc_id is null").select("doc_id"), "again")
    surplus = materialise(own.join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id").distinct(), "surplus")
    discard(own)
    if again.isEmpty():
        return docs.join(surplus, "doc_id", "left_anti").select(*docs.columns)
    single = docs.filter("doc_id is not null").join(surplus.unionByName(again), "doc_id", "left_anti").select(*docs.columns)
    d, f = docs.alias("d"), F.broadcast(again.alias("a")) if again.count() < 100_000 else again.alias("a")
    rows = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")), "left_semi").select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), F.col("d.text").cast("string").alias("text"))
    rows = (mark or marked_rows)(rows).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), "fp")
    one = first.select(F.col("doc_id").alias("id"), F.col("fp").alias("f"))
    rows = rows.join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("f"))).groupBy("doc_id", "fp").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(rows.select("row.*"))


def marked_rows(rows: DataFrame, value=fingerprint) -> DataFrame:
    """row, fp of (row, text): ``value`` of each text, as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((value(t) for t in each_text(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["row", "fp"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp long")


def op3_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
