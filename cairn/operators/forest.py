"""Walks in search trees: one exchange by theorem, then all trees of a batch a level at a time.

Rows are dealt and sorted by theorem. A task reads them batch by batch, holds the last theorem back
until it is whole, and passes each batch of whole theorems to a function that adds columns; parents
are found by binary search, not by a join. A theorem's tree has to fit a task: the search's node
budget bounds it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Forest:
    """The rows of whole theorems, sorted by (theorem_name, state_id)."""

    def __init__(self, rows: pa.Table):
        self.rows, self.n = rows, rows.num_rows
        names = rows.column("theorem_name").combine_chunks().dictionary_encode()
        self.theorem = np.cumsum(np.diff(_codes(names), prepend=-2) != 0) - 1
        state, some = self.numbers("state_id")
        parent, has = self.numbers("parent_state_id")
        ids, rank = np.unique(np.concatenate([state, parent]), return_inverse=True)
        key = lambda r, ok: self.theorem * (len(ids) + 1) + np.where(ok, r + 1, 0)
        own, up = key(rank[: self.n], some), key(rank[self.n :], has)
        twice = np.flatnonzero((own[1:] == own[:-1]) & some[1:])
        if len(twice):
            raise ValueError(f"state {state[twice[0]]} of {rows.column('theorem_name')[int(twice[0])].as_py()} occurs twice")
        at = np.minimum(np.searchsorted(own, up), max(0, self.n - 1))
        #: each row's parent row, -1 for none
        self.up = np.where(has & (own[at] == up), at, -1) if self.n else np.zeros(0, np.int64)
        self.identified = some

    def numbers(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """The column's integers, and which aren't null."""
        x = self.rows.column(c).combine_chunks().cast(pa.int64())
        return x.fill_null(0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)

    def flags(self, c: str) -> np.ndarray:
        return self.rows.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)

    def codes(self, c: str) -> np.ndarray:
        """Numbers that are equal where the column's values are; -1 for null."""
        return _codes(self.rows.column(c).combine_chunks().dictionary_encode())

    def rounds(self) -> np.ndarray:
        """Rows whose walk up never ends."""
        at, far = self.up.copy(), 1
        while far <= self.n and (at >= 0).any():
            at, far = np.where(at >= 0, at[at], -1), 2 * far
        return at >= 0

    def path(self, row: int) -> Iterator[int]:
        """The row and those above it, to the root or the first that comes again."""
        seen = set()
        while row >= 0 and row not in seen:
            seen.add(row)
            yield row
            row = int(self.up[row])


def _codes(x: pa.DictionaryArray) -> np.ndarray:
    return x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(batches) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("theorem_name")
        if held and held[-1].column("theorem_name")[-1].as_py() != names[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        codes = _codes(names.dictionary_encode())
        cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def in_trees(rows: DataFrame, added: str, walk: Callable[[Forest], list[pa.Array]]) -> DataFrame:
    """``rows`` with the columns ``added`` (DDL) that ``walk`` gives for the rows of whole theorems.

    Raises where a theorem has two rows with one id. Rows without id have no children; a parent that
    is missing is as none.
    """
    names = [f.name for f in T.StructType.fromDDL(added)]

    def run(batches):
        for t in _whole(batches):
            forest = Forest(t)
            for name, column in zip(names, walk(forest)):
                t = t.append_column(name, column)
            yield from t.combine_chunks().to_batches()

    dealt = rows.repartition("theorem_name").sortWithinPartitions("theorem_name", F.col("state_id").cast("long"))
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields]))


def to_first_proof(f: Forest, complete: str = "is_proof_complete") -> np.ndarray:
    """Of rows on the way from a theorem's root to its first complete state, the steps that remain; -1 elsewhere."""
    steps, done = np.full(f.n, -1), np.flatnonzero(f.flags(complete) & f.identified)
    at, k = done[np.unique(f.theorem[done], return_index=True)[1]], 0
    while len(at):
        at = at[steps[at] < 0]
        steps[at] = k
        at, k = f.up[at], k + 1
        at = at[at >= 0]
    return steps


def reached_from(f: Forest, starts: np.ndarray) -> np.ndarray:
    """How many of the start rows lie at or below each row."""
    out, endless = np.zeros(f.n, np.int64), f.rounds()
    at = np.flatnonzero(starts & ~endless)
    while len(at):
        np.add.at(out, at, 1)
        at = f.up[at]
        at = at[at >= 0]
    for row in np.flatnonzero(starts & endless).tolist():
        out[list(f.path(row))] += 1
    return out


def runs(f: Forest, flags: np.ndarray) -> np.ndarray:
    """How many rows in a row, this one and up, are flagged."""
    out, endless = np.zeros(f.n, np.int64), f.rounds()
    rows = np.flatnonzero(flags & ~endless)
    at = rows
    while len(rows):
        out[rows] += 1
        at = f.up[at]
        go = (at >= 0) & flags[np.maximum(at, 0)]
        rows, at = rows[go], at[go]
    for row in np.flatnonzero(flags & endless).tolist():
        for r in f.path(row):
            if not flags[r]:
                break
            out[row] += 1
    return out
