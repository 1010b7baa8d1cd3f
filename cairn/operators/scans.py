"""Running sums, numbers, windows of rows and carried values over one order of all rows, without one task for them.

The order is cut into ranges by marks, which are drawn from the rows by a hash of their keys, so that every
pass over the rows cuts alike. What a range adds up to (or the last value in it) is one row; these are
scanned over the ranges, and each row gets what comes before its range and its own place within it.
``by`` restarts the scan: the order is then by ``by`` first, and a group of any size is spread over ranges.

Orders should tell all rows apart. Rows that tie stay in one range, in any order.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: keys drawn for each range, and marks that a row is compared with at once
_DRAWN, _STEP = 32, 32


def cut_by_range(rows: DataFrame, order: list[str], by: list[str], parts: int | None = None) -> DataFrame:
    """Adds part_, the number of the range of (by, order) that a row lies in; ranges rise with the order, nulls come first.

    ``parts`` ranges, as many as shuffle partitions by default; what they hold is even up to the draw, results never hang on it.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c) for c in [*by, *order]])
    n = rows.count()
    if parts < 2 or n < 2:
        return rows.withColumn("part_", F.lit(0))
    every = max(1, n // (parts * _DRAWN))
    drawn = rows.filter(F.pmod(F.xxhash64(*by, *order), F.lit(every)) == 0).select(key.alias("k")).distinct()
    marks = drawn.agg(F.array_sort(F.collect_list("k")).alias("k"))
    step = F.greatest(F.lit(1), F.ceil(F.size("k") / parts).cast("int"))
    # every step-th key drawn is a mark, and every _STEP-th of those a coarse one
    marks = marks.select(F.filter("k", lambda x, i: (i + 1) % step == 0).alias("marks_")).select("marks_", F.filter("marks_", lambda x, i: (i + 1) % _STEP == 0).alias("coarse_"))
    below = lambda marks: F.size(F.filter(marks, lambda m: m < F.col("key_")))
    placed = rows.withColumn("key_", key).crossJoin(F.broadcast(marks))  # one row of at most parts * _DRAWN keys
    placed = placed.withColumn("c_", below(F.col("coarse_"))).withColumn("part_", F.col("c_") * _STEP + below(F.slice("marks_", F.col("c_") * _STEP + 1, F.lit(_STEP))))
    return placed.drop("key_", "marks_", "coarse_", "c_")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _carried(cut: DataFrame, by: list[str], summary: Column, scan) -> DataFrame:
    """part_ and by under other names, with carry_: the scan of the ranges' summaries before each range of a group."""
    each = cut.groupBy(*by, "part_").agg(summary.alias("own_"))
    before = W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # at most a row for each range
    return each.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("part_").alias("part_of"), scan(F.col("own_"), before).alias("carry_"))


def running_sum(rows: DataFrame, value: Column, name: str, order: list[str], by: tuple[str, ...] | list[str] = (), parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one in its group; 0 for the first."""
    by = list(by)
    cut = cut_by_range(rows.withColumn("value_", value), order, by, parts)
    totals = _carried(cut, by, F.sum("value_"), lambda own, before: F.coalesce(F.sum(own).over(before), F.lit(0)))
    inner = F.sum("value_").over(W.partitionBy("part_", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    out = cut.withColumn(name, F.coalesce(inner, F.lit(0))).join(totals, _same(["part_", *by], ["part_of", *[f"{c}_of" for c in by]]))
    return out.withColumn(name, F.col(name) + F.col("carry_")).select(*rows.columns, name)


def numbered(rows: DataFrame, name: str, order: list[str], by: tuple[str, ...] | list[str] = (), parts: int | None = None) -> DataFrame:
    """Adds ``name``: the place in the order, from 0, within each ``by``."""
    return running_sum(rows, F.lit(1).cast("long"), name, order, by, parts)


def last_value(rows: DataFrame, value: Column, name: str, order: list[str], by: tuple[str, ...] | list[str] = (), inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null at or before each row of its group (before it, unless ``inclusive``).

    An as-of join is this over both sides' rows put together. A group of any size runs in as many tasks as ranges.
    """
    by = list(by)
    cut = cut_by_range(rows.withColumn("value_", value), order, by, parts)
    at = F.struct(*[F.col(c) for c in order])
    carried = _carried(cut, by, F.max_by(F.col("value_"), F.when(F.col("value_").isNotNull(), at)), lambda own, before: F.last(own, ignorenulls=True).over(before))
    inner = F.last("value_", ignorenulls=True).over(W.partitionBy("part_", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    out = cut.withColumn(name, inner).join(carried, _same(["part_", *by], ["part_of", *[f"{c}_of" for c in by]]))
    return out.withColumn(name, F.coalesce(name, "carry_")).select(*rows.columns, name)


def moving(rows: DataFrame, size: int, columns: dict, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds columns over the last ``size`` rows of the order, this one included: name -> a function of that window.

    Rows are numbered and cut into blocks of at least ``size``; the last size - 1 rows of a block go along with the next one too.
    """
    block = max(size, 10_000)
    placed = numbered(rows, "at_", order, parts=parts)
    own, late = F.floor(F.col("at_") / block), F.col("at_") % block > block - size
    copies = placed.withColumn("block_", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    window = W.partitionBy("block_").orderBy("at_").rowsBetween(-(size - 1), 0)
    return copies.withColumns({name: f(window) for name, f in columns.items()}).filter(F.col("block_") == own).drop("at_", "block_")


def packed(rows: DataFrame, tokens: str, length: int, end: int, order: list[str], by: tuple[str, ...] | list[str] = (), parts: int | None = None) -> DataFrame:
    """by, run, input_ids, labels: the rows' tokens in order, an end token after each, cut into runs of ``length``; a last short run is dropped.

    Labels are the tokens, but -100 for end tokens. Null and empty arrays give their end token alone. A row
    sends each run its slice, so that a task holds whole runs and never a group.
    """
    by = list(by)
    own = rows.select(*by, *[c for c in order if c not in by], F.concat(F.coalesce(F.col(tokens), F.array().cast(rows.schema[tokens].dataType)), F.array(F.lit(end))).alias("tokens_"))
    own = running_sum(own, F.size("tokens_").cast("long"), "start_", order, by, parts)
    last = F.col("start_") + F.size("tokens_") - 1
    labelled = F.transform("tokens_", lambda t, i: F.struct(t.alias("id"), F.when(i == F.size("tokens_") - 1, F.lit(-100)).otherwise(t).alias("label")))
    pieces = own.withColumn("tokens_", labelled).withColumn("run", F.explode(F.sequence(F.floor(F.col("start_") / length), F.floor(last / length))))
    begin = F.greatest(F.lit(0), F.col("run") * length - F.col("start_")).cast("int")
    stop = F.least(F.size("tokens_"), (F.col("run") + 1) * length - F.col("start_")).cast("int")
    pieces = pieces.select(*by, "run", F.struct((F.col("start_") + begin).alias("at"), F.slice("tokens_", begin + 1, stop - begin).alias("x")).alias("piece"))
    runs = pieces.groupBy(*by, "run").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["x"])).alias("x")).filter(F.size("x") == length)
    return runs.select(*by, "run", F.transform("x", lambda t: t["id"]).alias("input_ids"), F.transform("x", lambda t: t["label"]).alias("labels"))
