"""State that lasts over micro-batches: open frontiers by theorem, the pace of a run."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontiers(stream: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """theorem_name, rows, open, proved, next_id, next_score after each batch that holds rows of a theorem (mode update).

    Open are states that aren't complete and no parent of a row so far; next is the one with the best
    combined score, the smaller id on ties. The state of a theorem is its open states and the parents
    seen, which a search's budget bounds; rows that arrive again change nothing but ``rows``.
    """
    def step(key, batches, state):
        rows, proved, ids, scores, parents = state.get if state.exists else (0, False, [], [], [])
        open_, closed = dict(zip(ids, scores)), set(parents)
        for pdf in batches:
            rows += len(pdf)
            proved = proved or bool(pdf.is_proof_complete.any())
            closed |= {int(p) for p in pdf.parent_state_id.dropna()}
            live = pdf[~pdf.is_proof_complete]
            open_ |= {int(i): float(s) for i, s in zip(live.state_id, live.score)}
        open_ = {i: s for i, s in open_.items() if i not in closed}
        state.update((rows, proved, list(open_), list(open_.values()), sorted(closed)))
        best = min(open_, key=lambda i: (-open_[i], i), default=None)
        yield pd.DataFrame({"theorem_name": [key[0]], "rows": [rows], "open": [len(open_)], "proved": [proved], "next_id": pd.array([best], "Int64"), "next_score": [open_.get(best)]}).astype({"next_score": "float64"})

    score = F.coalesce(F.col("llm_log_prob"), F.lit(0.0)) * alpha + F.coalesce(F.col("ebm_score"), F.lit(0.0)) * beta
    rows = stream.select("theorem_name", "state_id", "parent_state_id", F.coalesce("is_proof_complete", F.lit(False)).alias("is_proof_complete"), score.alias("score"))
    return rows.groupBy("theorem_name").applyInPandasWithState(
        step, "theorem_name string, rows long, open long, proved boolean, next_id long, next_score double", "rows long, proved boolean, ids array<long>, scores array<double>, parents array<long>", "update", "NoTimeout")


def pace(stream: DataFrame, left: int, window: int = 200) -> DataFrame:
    """run, done, eta_secs after each batch of completions (run, ts_ms): what ``left`` more take at the pace of the last ``window``."""
    def step(key, batches, state):
        done, last = state.get if state.exists else (0, [])
        for pdf in batches:
            done += len(pdf)
            last = sorted([*last, *(int(t) for t in pdf.ts_ms)])[-window:]
        state.update((done, last))
        eta = (last[-1] - last[0]) / 1000 / (len(last) - 1) * left if len(last) > 1 else None
        yield pd.DataFrame({"run": [key[0]], "done": [done], "eta_secs": [eta]}).astype({"eta_secs": "float64"})

    return stream.select("run", "ts_ms").filter("ts_ms is not null").groupBy("run").applyInPandasWithState(step, "run string, done long, eta_secs double", "done long, last array<long>", "update", "NoTimeout")
