"""Walks in search trees as table functions of SQL, for whatever table is passed.

    SELECT * FROM label_paths(TABLE(t) PARTITION BY theorem_name ORDER BY state_id)

Each function asks for the columns it needs, passes all others through, and adds its own: ``label_paths`` replaces label and
remaining_depth, ``backed_up`` adds successes and q, ``have_runs`` adds chain. One theorem is a partition of the table; it
has to fit a task, as everywhere in walks. A table passed without PARTITION BY, or with repeated ids, is an error.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import forest


def _asking(needs: tuple[str, ...], adds: tuple):
    """What a function that needs and adds these columns says of its result, from the table that it is given."""
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("give a table: TABLE(t) PARTITION BY theorem_name ORDER BY state_id")
        for c in ("theorem_name", "state_id", "parent_state_id", *needs):
            if c not in table.dataType.fieldNames():
                raise ValueError(f"the table has no column {c}")
        schema = StructType([f for f in table.dataType.fields if f.name not in {name for name, _ in adds}])
        for name, kind in adds:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    return staticmethod(analyze)


class _Walk:
    """Gathers a theorem's rows, then gives each with what the walk adds."""

    needs: tuple[str, ...] = ()
    adds: tuple = ()

    def __init__(self):
        self.rows: list[Row] = []

    def eval(self, row: Row) -> None:
        if self.rows and row["theorem_name"] != self.rows[0]["theorem_name"]:
            raise ValueError("pass the table PARTITION BY theorem_name")
        self.rows.append(row)

    def terminate(self):
        if not self.rows:
            return
        names = self.rows[0].__fields__
        self.rows.sort(key=lambda r: (r["state_id"] is not None, r["state_id"] or 0))
        keep = ("theorem_name", "state_id", "parent_state_id", *self.needs)
        f = forest.Forest(pa.table({c: [r[c] for r in self.rows] for c in keep}))
        added = {name for name, _ in self.adds}
        for row, new in zip(self.rows, zip(*self.walk(f))):
            yield (*[row[c] for c in names if c not in added], *new)


class LabelPaths(_Walk):
    needs = ("is_proof_complete",)
    adds = (("label", StringType()), ("remaining_depth", IntegerType()))
    analyze = _asking(needs, adds)

    def walk(self, f):
        left = forest.to_first_proof(f).tolist()
        return ["positive" if x >= 0 else "negative" for x in left], left


class BackedUp(_Walk):
    needs = ("is_proof_complete", "visits")
    adds = (("successes", LongType()), ("q", DoubleType()))
    analyze = _asking(needs, adds)

    def walk(self, f):
        n = forest.reached_from(f, f.flags("is_proof_complete") & f.identified).tolist()
        return n, [k / v if v else 0.0 for k, v in zip(n, f.numbers("visits")[0].tolist())]


class HaveRuns(_Walk):
    needs = ("tactic_applied",)
    adds = (("chain", LongType()),)
    analyze = _asking(needs, adds)

    def walk(self, f):
        return (forest.runs(f, np.array([(t or "").startswith("have ") for t in f.rows.column("tactic_applied").to_pylist()], bool)).tolist(),)


FUNCTIONS = {"label_paths": LabelPaths, "backed_up": BackedUp, "have_runs": HaveRuns}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under their names."""
    for name, walk in FUNCTIONS.items():
        spark.udtf.register(name, udtf(walk))
