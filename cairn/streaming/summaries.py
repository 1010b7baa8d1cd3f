"""Summaries of streams of trajectory rows, from state kept by theorem.

A theorem's state is small: which labels it has shown, whether it is proved, how many rows it had. Each batch of its rows
becomes one row of changes, and totals are the sums of changes, so nothing holds the names of all theorems and
a theorem that comes back after a restart isn't counted again. With a time to live a theorem's state goes when it
had no rows for so long; should it come back later, it counts as new.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "theorem_name string, rows long, positive long, negative long, unknown long, new_theorem int, new_positive int, new_negative int, new_unknown int, completed int, total_rows long"
LABELS = ("positive", "negative", "unknown")
#: what the session must be set to before such a stream starts
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Changes(StatefulProcessor):
    """A row of changes for each theorem and batch: its rows by label, which labels are new, whether it became proved."""

    def __init__(self, live_ms: int | None = None):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "label string", "rows long", self.live_ms)
        self.proved = handle.getValueState("proved", "at long", self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts, done = dict.fromkeys(LABELS, 0), False
        for part in rows:
            for label, n in part["label"].value_counts(dropna=False).items():
                counts[label if label in LABELS else "unknown"] += int(n)
            done |= bool(part["is_proof_complete"].fillna(False).any())
        before = {label: self.seen.getValue((label,))[0] if self.seen.containsKey((label,)) else 0 for label in LABELS}
        for label, n in counts.items():
            if n or before[label]:  # written anew even if nothing came, so that a theorem's state ages as one
                self.seen.updateValue((label,), (before[label] + n,))
        known = self.proved.exists()
        if done or known:
            self.proved.update((1,))
        new = {f"new_{label}": int(counts[label] > 0 and not before[label]) for label in LABELS}
        total = sum(before.values()) + sum(counts.values())
        yield pd.DataFrame([{"theorem_name": key[0], "rows": sum(counts.values()), **counts, "new_theorem": int(not any(before.values())), **new, "completed": int(done and not known), "total_rows": total}])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, live_ms: int | None = None) -> DataFrame:
    """The changes of a stream with theorem_name, label, is_proof_complete (output mode update); null names are one theorem.

    With ``live_ms``, a theorem's time to live, the stream has to be triggered by time: it never runs out of batches.
    """
    rows = stream.select("theorem_name", "label", "is_proof_complete")
    return rows.groupBy("theorem_name").transformWithStateInPandas(Changes(live_ms), CHANGES, "Update", "ProcessingTime" if live_ms else "None")


def totals(made: DataFrame) -> DataFrame:
    """One row from a table of changes: rows, positive, negative, theorems, proved; zeros of none."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return made.agg(s("rows").alias("n_rows"), s("positive").alias("positive"), s("negative").alias("negative"), s("new_theorem").alias("theorems"), s("completed").alias("proved"))


def label_totals(made: DataFrame) -> DataFrame:
    """label, n, theorems: rows and different theorems by label, from a table of changes."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("n"), F.col(f"new_{x}").alias("new")) for x in LABELS])).alias("x")
    return made.select(each).groupBy("x.label").agg(F.sum("x.n").alias("n"), F.sum("x.new").alias("theorems")).filter("n > 0").select("label", "n", "theorems")
