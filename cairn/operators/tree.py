"""Search trees: rows keyed (theorem_name, state_id), edges to parent_state_id.

Ids must be unique within a theorem: walks up the tree raise where they aren't, and :func:`checked` asks before.
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .forest import in_trees, reached_from, runs, to_first_proof


def theorem():
    """All rows of a theorem."""
    return W.partitionBy("theorem_name")


def siblings():
    """All children of a state."""
    return W.partitionBy("theorem_name", "parent_state_id")


def checked(traj: DataFrame) -> DataFrame:
    """Raises where a theorem has two rows with one id."""
    twice = traj.groupBy("theorem_name", "state_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"state {twice[0].state_id} of {twice[0].theorem_name} occurs twice")
    return traj


def ancestors(starts: DataFrame, traj: DataFrame) -> DataFrame:
    """theorem_name, start_id, state_id, steps: from each start up to the root, the start included.

    A state met before ends the walk, as does a missing parent.
    """
    def walk(f):
        ids, _ = f.numbers("state_id")
        below = [[] for _ in range(f.n)]
        for row in np.flatnonzero(f.flags("starts_")).tolist():
            for k, r in enumerate(f.path(row)):
                below[r].append({"start_id": int(ids[row]), "steps": k})
        return [pa.array(below, pa.list_(pa.struct([("start_id", pa.int64()), ("steps", pa.int32())])))]

    nodes = traj.select("theorem_name", F.col("state_id").cast("long").alias("state_id"), F.col("parent_state_id").cast("long").alias("parent_state_id"))
    marked = nodes.join(starts.select("theorem_name", F.col("state_id").cast("long").alias("state_id")).distinct().withColumn("starts_", F.lit(True)), ["theorem_name", "state_id"], "left")
    rows = in_trees(marked, "below array<struct<start_id:bigint,steps:int>>", walk)
    return rows.select("theorem_name", "state_id", F.explode("below").alias("b")).select("theorem_name", "b.start_id", "state_id", "b.steps")


def label_paths(traj: DataFrame) -> DataFrame:
    """Adds label and remaining_depth: the path to a theorem's first complete state is positive, with
    the steps that remain; all other rows are negative, with -1. Raises where ids repeat."""
    def walk(f):
        steps = to_first_proof(f)
        return [pa.array(np.where(steps >= 0, "positive", "negative")), pa.array(steps.astype(np.int32))]

    return in_trees(traj.drop("label", "remaining_depth"), "label string, remaining_depth int", walk)


def proof_steps(traj: DataFrame) -> DataFrame:
    """theorem_name, tactics of the positive path from the root on, root and blank steps left out."""
    rows = traj.filter((F.col("label") == "positive") & (F.coalesce("tactic_applied", F.lit("")) != ""))
    return rows.groupBy("theorem_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth_from_root", "state_id", "tactic_applied"))), lambda r: r["tactic_applied"]).alias("tactics"))


def exported_paths(traj: DataFrame, min_steps: int = 1) -> DataFrame:
    """theorem, state (before the step), tactic, depth of the steps of proofs of ``min_steps`` or more."""
    parent = traj.select(F.col("theorem_name").alias("t"), F.col("state_id").alias("p"), F.col("state_pp").alias("state"))
    proved = traj.withColumn("proved", F.max("is_proof_complete").over(theorem()))
    steps = proved.filter("proved AND label = 'positive' AND coalesce(tactic_applied, '') <> ''").withColumn("n", F.count("*").over(theorem())).filter(F.col("n") >= min_steps)
    out = steps.join(parent, (F.col("theorem_name") == F.col("t")) & (F.col("parent_state_id") == F.col("p"))).filter("coalesce(state, '') <> ''")
    return out.select(F.col("theorem_name").alias("theorem"), "state", F.col("tactic_applied").alias("tactic"), F.greatest(F.col("depth_from_root") - 1, F.lit(0)).alias("depth"))


def negative_tiers(traj: DataFrame) -> DataFrame:
    """Adds tier to negatives: ``sibling`` beside a positive child of one parent, else ``other``; null for the rest."""
    beside = F.max(F.col("label") == "positive").over(siblings()) & F.col("parent_state_id").isNotNull()
    return traj.withColumn("tier", F.when(F.col("label") == "negative", F.when(beside, "sibling").otherwise("other")))


def leaves(traj: DataFrame) -> DataFrame:
    """States that are no one's parent and not complete, and have goals; a root may have none."""
    parents = traj.filter("parent_state_id is not null").select("theorem_name", F.col("parent_state_id").alias("state_id")).distinct()
    goals = F.coalesce(F.trim("state_pp", F.lit(" \n\t\r")), F.lit("")) != ""
    return traj.filter("not is_proof_complete").filter(goals | F.col("parent_state_id").isNull()).join(parents, ["theorem_name", "state_id"], "left_anti")


def backed_up(traj: DataFrame) -> DataFrame:
    """theorem_name, state_id, successes (complete states at or below), q = successes / visits (0 unvisited)."""
    rows = traj.select("theorem_name", "state_id", "parent_state_id", "visits", "is_proof_complete")
    out = in_trees(rows, "successes bigint", lambda f: [pa.array(reached_from(f, f.flags("is_proof_complete") & f.identified))])
    return out.select("theorem_name", "state_id", "successes", F.when(F.col("visits") > 0, F.col("successes") / F.col("visits")).otherwise(0.0).alias("q"))


def frontier_score(prior: Column, q: Column, visits: Column, parent_visits: Column, goals: Column, alpha: float = 0.5, c: float = 1.0, penalty: float = 0.0) -> Column:
    """The selection score: a prior that fades with visits, the value found, a bonus for what was seldom tried."""
    a = alpha / (1 + visits)
    return a * prior + (1 - a) * q + c * F.sqrt(F.log(parent_visits + F.lit(1.0)) / (1 + visits)) - penalty * F.greatest(goals - 1, F.lit(0))


def combined_score(llm: Column, ebm: Column, alpha: float = 0.5, beta: float = 0.5, t_llm: float = 1.0, t_ebm: float = 1.0) -> Column:
    safe = lambda t: 1.0 if abs(t) < 1e-12 else t
    return alpha * llm / safe(t_llm) + beta * ebm / safe(t_ebm)


def scored(prepared: DataFrame, **weights) -> DataFrame:
    """theorem_name, state_id, score of every state that has a parent."""
    parent = prepared.select(F.col("theorem_name").alias("t"), F.col("state_id").alias("p"), F.col("visits").alias("pv"))
    rows = prepared.join(parent, (F.col("theorem_name") == F.col("t")) & (F.col("parent_state_id") == F.col("p")))
    return rows.select("theorem_name", "state_id", frontier_score(F.coalesce("ebm_score", "llm_log_prob"), F.col("q_value"), F.col("visits"), F.col("pv"), F.col("goal_count"), **weights).alias("score"))


def have_chains(prepared: DataFrame) -> DataFrame:
    """theorem_name, state_id, chain: how many steps in a row, this one and up, begin with ``have ``."""
    rows = prepared.select("theorem_name", "state_id", "parent_state_id", F.col("tactic_applied").startswith("have ").alias("have"))
    return in_trees(rows, "chain bigint", lambda f: [pa.array(runs(f, f.flags("have")))]).select("theorem_name", "state_id", "chain")


def fewer_children(traj: DataFrame, most: int) -> DataFrame:
    """Of each parent's children the ``most`` with the best llm + ebm score; roots stay."""
    rank = F.row_number().over(siblings().orderBy(F.desc(F.col("llm_log_prob") + F.col("ebm_score")), "state_id"))
    return traj.withColumn("rank", rank).filter((F.col("rank") <= most) | F.col("parent_state_id").isNull()).drop("rank")


def rendered(traj: DataFrame) -> DataFrame:
    """theorem_name, tree (indented text), nested (JSON) of each theorem, children by score.

    One tree is handled at a time, by one task each: trees are bounded by the search's node budget.
    """
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r.state_id: r for r in pdf.itertuples()}
        below: dict = {}
        for r in pdf.sort_values(["score", "state_id"], ascending=[False, True]).itertuples():
            below.setdefault(None if pd.isna(r.parent_state_id) or r.parent_state_id not in rows else r.parent_state_id, []).append(r.state_id)
        mark = lambda r: "✓" if r.is_proof_complete else {"positive": "★", "negative": "✗"}.get(r.label, "?")
        lines, done = [], {}
        stack = [(s, 0, False) for s in reversed(below.get(None, []))]
        while stack:
            s, depth, after = stack.pop()
            r = rows[s]
            if after:
                done[s] = {"state_id": int(s), "tactic": r.tactic_applied, "score": float(r.score), "label": r.label, "children": [done[c] for c in below.get(s, [])]}
                continue
            lines.append(f"{'  ' * depth}{mark(r)} {r.tactic_applied or '(root)'} [{r.score:.3f}]")
            stack.append((s, depth, True))
            stack += [(c, depth + 1, False) for c in reversed(below.get(s, []))]
        return pd.DataFrame({"theorem_name": [pdf.theorem_name.iloc[0]], "tree": ["\n".join(lines)], "nested": [json.dumps([done[s] for s in below.get(None, [])], ensure_ascii=False)]})

    cols = traj.select("theorem_name", "state_id", "parent_state_id", "tactic_applied", "label", "is_proof_complete", (F.col("llm_log_prob") + F.col("ebm_score")).alias("score"))
    return cols.groupBy("theorem_name").applyInPandas(draw, "theorem_name string, tree string, nested string")
