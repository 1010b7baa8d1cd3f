"""Asking servers from within tasks: generation and encoding with retries that stop when a server is down."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Breaker:
    """Lets calls through until ``limit`` in a row have failed; again after ``cooldown`` seconds."""

    def __init__(self, limit: int = 3, cooldown: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.cooldown, self.clock, self.failures, self.last = limit, cooldown, clock, 0, 0.0

    def open(self) -> bool:
        if self.failures >= self.limit and self.clock() - self.last > self.cooldown:
            self.failures = 0
        return self.failures >= self.limit

    def call(self, function: Callable, *args):
        """The function's result; a failure counts and is raised, a call while open is refused."""
        if self.open():
            raise ConnectionError(f"{self.failures} calls in a row failed; refused for {self.cooldown:.0f} s")
        try:
            out = function(*args)
        except Exception:
            self.failures, self.last = self.failures + 1, self.clock()
            raise
        self.failures = 0
        return out


def generated(states: DataFrame, connect: Callable[[], Callable[[str], list[tuple[str, float]]]], key: str = "theorem_name", state: str = "state") -> DataFrame:
    """key, pattern, match, ord, text, log_prob, error: what a server answers to each state, in the shape of a policy table.

    ``connect`` is called once a task and returns the function that asks for one state. A state whose
    call fails keeps a row with the error, without a text. Calls repeat if a task is run again.
    """
    schema = T.StructType([states.schema[key], *[T.StructField(n, t) for n, t in (("pattern", T.StringType()), ("match", T.StringType()), ("ord", T.LongType()), ("text", T.StringType()), ("log_prob", T.DoubleType()), ("error", T.StringType()))]])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, breaker = connect(), Breaker()
        for pdf in batches:
            rows = []
            for k, s in zip(pdf[key], pdf[state]):
                try:
                    rows += [(k, s, "exact", i, text, float(lp), None) for i, (text, lp) in enumerate(breaker.call(client, s))]
                except Exception as e:
                    rows.append((k, s, "exact", 0, None, None, str(e)))
            yield pd.DataFrame(rows, columns=schema.fieldNames(), dtype=object)

    return states.select(key, state).filter(F.col(state).isNotNull()).mapInPandas(ask, schema)


def encoded(states: DataFrame, connect: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 8, state: str = "state_pp") -> DataFrame:
    """state_pp, embedding of the different states, asked for in batches; a failing batch fails the task, which is run again."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for pdf in batches:
            texts = pdf[state].tolist()
            for a in range(0, len(texts), batch):
                part = texts[a : a + batch]
                yield pd.DataFrame({"state_pp": part, "embedding": [list(map(float, v)) for v in client(part)]}, dtype=object)

    return states.select(state).filter(F.col(state).isNotNull()).distinct().mapInPandas(ask, "state_pp string, embedding array<float>")


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """States without an embedding yet."""
    return wanted.select("state_pp").filter("state_pp is not null").distinct().join(cached.select("state_pp"), "state_pp", "left_anti")
