"""Exact order statistics of groups of any size; no group is ever gathered.

Rows become counts of different values, added up before they are shuffled. Where no group has more than
``CELL`` different values, one running sum by group finds the value at every place asked for. A
group with more is cut into ranges of values between the marks of a quantile sketch; the range that
holds a place is known from the ranges' counts, and only that one is looked at again, in
the same way, until it is small enough. So no task orders more than ``CELL`` values of a group, or
what is between two of ``MARKS`` marks; ties never matter, as they are one value with a count.

Rules name the places, and must not be mixed up: :func:`linear` (between the two values around
p (n - 1)), :func:`indexed` (at floor(p n), the last at most), :func:`part` (the same in whole numbers) and :func:`upper_median` (at n // 2).
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: different values of a group that one window orders, and marks that cut a larger group
CELL, MARKS = 100_000, 1_000
#: from a count, the lower and upper place (from 0) and the weight of the upper one
Rule = Callable[[Column], tuple[Column, Column, Column]]


def linear(p: float) -> Rule:
    def places(n: Column):
        at = F.lit(float(p)) * (n - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    return places


def indexed(p: float) -> Rule:
    def places(n: Column):
        at = F.least(F.floor(F.lit(float(p)) * n), n - 1)
        return at, at, F.lit(0.0)

    return places


def part(a: int, b: int) -> Rule:
    """At n a / b, rounded down, the last at most; in whole numbers."""
    def places(n: Column):
        at = F.least(F.floor((n * a - F.pmod(n * a, F.lit(b))) / b), n - 1)
        return at, at, F.lit(0.0)

    return places


def upper_median() -> Rule:
    def places(n: Column):
        at = F.floor(n / 2)
        return at, at, F.lit(0.0)

    return places


def percentiles(rows: DataFrame, wanted: dict[str, tuple[str, Rule]], *by: str, cell: int = CELL, marks: int = MARKS) -> DataFrame:
    """``by`` and a double for each name of ``wanted``, given as (numeric column, rule).

    Null values don't count; a group without any is null there, one without any in all columns is left out
    (:func:`beside` keeps it). NaN is above all numbers, null keys are a group. An empty table gives
    no row. One job looks at the widest group before the result is planned.
    """
    columns = sorted({c for c, _ in wanted.values()})
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    long = rows.select(key.alias("g"), each.alias("x")).select("g", F.col("x.k").alias("k"), F.col("x.v").alias("v")).filter("v is not null")
    counts = long.groupBy("g", "k", "v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("g", "k").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    slots = [(columns.index(c), rule(F.col("all"))) for c, rule in wanted.values()]
    # of each place a slot: which column's, and where
    place = F.array(*[F.struct(F.lit(2 * i + j).alias("slot"), F.lit(k).alias("of"), at.cast("long").alias("place")) for i, (k, p) in enumerate(slots) for j, at in enumerate(p[:2])])
    widest = sizes.agg(F.max("kinds")).first()[0] or 0
    if widest <= cell:
        own = W.partitionBy("g", "k")
        placed = counts.withColumn("upto", F.sum("n").over(own.orderBy("v"))).withColumn("all", F.sum("n").over(own))
        at = lambda slot, k, p: F.min(F.when((F.col("k") == k) & (F.col("upto") > p), F.col("v"))).alias(f"s{slot}")
        found = placed.groupBy("g").agg(*[at(2 * i + j, k, p) for i, (k, ps) in enumerate(slots) for j, p in enumerate(ps[:2])], *_totals(columns))
    else:
        cells = sizes.select("g", "k", F.lit(float("-inf")).alias("lo"), F.lit(float("nan")).alias("hi"), "kinds", F.filter(place, lambda x: x["of"] == F.col("k")).alias("places"))
        while widest > cell:
            cells = _cut(counts, cells, cell, marks)
            widest, before = cells.agg(F.max("kinds")).first()[0], widest
            if widest >= before:
                raise ArithmeticError("ranges of values didn't become smaller")
        found = _in_cells(counts, cells).groupBy("g").agg(*[F.max(F.when(F.col("slot") == s, F.col("v"))).alias(f"s{s}") for s in range(2 * len(slots))])
        found = found.join(sizes.groupBy("g").agg(*_totals(columns)), "g")
    out = []
    for i, (name, (c, rule)) in enumerate(wanted.items()):
        _, _, weight = rule(F.col(f"n{columns.index(c)}"))
        low, high = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        out.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    return found.select(*[F.col("g")[c].alias(c) for c in by], *out)


def _totals(columns: list[str]) -> list[Column]:
    return [F.max(F.when(F.col("k") == k, F.col("all"))).alias(f"n{k}") for k in range(len(columns))]


def _meet(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of values with the cells they lie in; ranges of a group don't overlap."""
    c = cells.select(F.col("g").alias("cg"), F.col("k").alias("ck"), *[x for x in cells.columns if x not in ("g", "k")])
    return counts.join(c, (F.col("g") == F.col("cg")) & (F.col("k") == F.col("ck")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("cg", "ck")


def _cut(counts: DataFrame, cells: DataFrame, cell: int, marks: int) -> DataFrame:
    """The cells, each that is too large cut at marks, without the parts that hold no place."""
    large = cells.filter(F.col("kinds") > cell)
    met = _meet(counts, large.select("g", "k", "lo", "hi", "places"))
    cuts = met.groupBy("g", "k", "lo").agg(F.percentile_approx("v", [(i + 1) / (marks + 1) for i in range(marks)], 10 * marks).alias("cuts"))
    cut = met.join(cuts.select(F.col("g").alias("cg"), F.col("k").alias("ck"), F.col("lo").alias("cl"), "cuts"), (F.col("g") == F.col("cg")) & (F.col("k") == F.col("ck")) & (F.col("lo") == F.col("cl"))).drop("cg", "ck", "cl")
    part = F.size(F.filter("cuts", lambda m: m < F.col("v")))
    parts = cut.withColumn("part", part).groupBy("g", "k", "lo", "part").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("places").alias("places"))
    before = F.sum("n").over(W.partitionBy("g", "k", "lo").orderBy("part")) - F.col("n")
    inside = lambda x: (x["place"] >= F.col("before")) & (x["place"] < F.col("before") + F.col("n"))
    moved = F.transform(F.filter("places", inside), lambda x: F.struct(x["slot"].alias("slot"), x["of"].alias("of"), (x["place"] - F.col("before")).alias("place")))
    kept = parts.withColumn("before", before).select("g", "k", F.col("least").alias("lo"), F.col("most").alias("hi"), "kinds", moved.alias("places")).filter(F.size("places") > 0)
    return cells.filter(F.col("kinds") <= cell).unionByName(kept)


def _in_cells(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """g, slot, v: the value at each place."""
    met = _meet(counts, cells.select("g", "k", "lo", "hi", "places"))
    upto = F.sum("n").over(W.partitionBy("g", "k", "lo").orderBy("v"))
    hit = F.filter("places", lambda x: (x["place"] < F.col("upto")) & (x["place"] >= F.col("upto") - F.col("n")))
    return met.withColumn("upto", upto).select("g", "v", F.explode(hit).alias("x")).select("g", F.col("x.slot").alias("slot"), "v")


def beside(stats: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """``stats`` with the columns of ``found`` for its keys, null keys included; without ``by`` both are one row."""
    if not by:
        return stats.join(F.broadcast(found), how="left")
    right = found.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in found.columns if c not in by])
    return stats.join(right, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left").drop(*[f"_{c}" for c in by])
