"""Writers of tables and documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def trajectories(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One atomic commit; an empty frame still leaves its schema. ``mode="append"`` adds a checkpoint's rows."""
    rows.write.mode(mode).parquet(path)


def embeddings(rows: DataFrame, path: str) -> None:
    rows.select("state_pp", "embedding").write.mode("overwrite").parquet(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def split_json_lines(rows: DataFrame, path: str, split: str = "split") -> None:
    rows.write.mode("overwrite").partitionBy(split).json(path)


def split_with_pool(pairs: DataFrame, path: str, least: int = 3) -> None:
    """``pairs`` (split, text, theorem, source, depth) by split, and ``pool``: the keys whose deepest pair is at ``least`` or deeper."""
    split_json_lines(pairs, f"{path}/splits")
    pool = pairs.groupBy("source", "theorem").agg(F.max("depth").alias("max_depth")).filter(F.col("max_depth") >= least)
    json_lines(pool.select("theorem", "source", "max_depth"), f"{path}/pool")


def document(rows: DataFrame, order: list[str], name: str = "rows") -> DataFrame:
    """A small frame as one JSON document: one row, column ``document``."""
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order])
    return rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias(name))).alias("document"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A frame of ``limit`` rows at most as an aligned Markdown table, numbers to the right; more rows are an error."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows: not a table to print")
    cells = [rows.columns, *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in found]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells[1:])])


def source_file(theorems: DataFrame, skipped: DataFrame, module: str, opens: tuple[str, ...] = (), preamble: tuple[str, ...] = ()) -> DataFrame:
    """One row, ``text``: a source with the theorems (pos, name, statement) left open, in order, bare names in full, and what was left out.

    Names lose colons at their end; a quantifier before IsGreatest or IsLeast, which binds nothing,
    goes. Skipped are names in ``skipped`` (name), blank statements and those with
    NNReal.IsConjExponent. A module's theorems make one file, so they fit one task.
    """
    names = skipped.select(F.col("name").alias("_s")).distinct()
    marked = theorems.join(names, F.col("name") == F.col("_s"), "left")
    bare = F.regexp_replace("name", ":+$", "")
    statement = F.regexp_replace("statement", r"^∀ (?=Is(Greatest|Least) )", "")
    reason = F.when(F.col("_s").isNotNull(), "in skip list").when(F.trim(F.coalesce("statement", F.lit(""))) == "", "empty statement").when(F.col("statement").contains("NNReal.IsConjExponent"), "NNReal.IsConjExponent (Mathlib version mismatch)")
    line = F.when(reason.isNull(), F.concat(F.lit("theorem "), bare, F.lit(" : "), T.qualified(statement), F.lit(" := by sorry\n")))
    rows = marked.select("pos", line.alias("line"), F.when(reason.isNotNull(), F.concat(F.lit("--   "), bare, F.lit(": "), reason)).alias("note"))
    sorted_ = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda r: r[c])
    head = "\n".join([f"-- Generated benchmark file: {module}", "", "import Mathlib", "", "set_option maxHeartbeats 800000", "", "open " + " ".join(dict.fromkeys(["Real", *opens])), "", *[x for p in preamble for x in (p, "")]])
    both = rows.agg(sorted_("line").alias("a"), sorted_("note").alias("b"))
    trailer = F.when(F.size("b") > 0, F.concat(F.lit("\n-- Skipped "), F.size("b").cast("string"), F.lit(" theorems:\n"), F.array_join("b", "\n"), F.lit("\n"))).otherwise("")
    return both.select(F.concat(F.lit(head + "\n"), F.array_join("a", "\n"), trailer).alias("text"))
