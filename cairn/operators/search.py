"""Searches over tables that hold an environment's answers: best first, and along known proofs.

A theorem's own rows of all tables meet in one task: ``transitions`` (theorem_name, state_id, tactic,
kind ``success``/``complete``/``failed``, next_state_id, goals), what is missing has failed; ``policy``
(theorem_name, pattern, match ``exact``/``contains``/``default``, ord, text, log_prob), texts that a
state is answered with: those of its exact pattern, else those of the first pattern it contains, else
the defaults. Both are bounded by a search's budget. Scorers are functions from lists of states to
lists of numbers, higher for more provable.
"""
from __future__ import annotations

import heapq
import json
import math
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import proofs as P

#: fixed values: steps tried at every state
PROBES = ["simp", "ring", "omega", "norm_num", "decide", "trivial", "rfl", "tauto", "linarith", "push_neg", "contradiction", "exfalso", "constructor", "left", "right", "ext", "simp_all"]
UNSCORED = -1e6
PROBE_LOG_PROB = -10.0


@dataclass(frozen=True)
class Settings:
    max_depth: int = 25
    alpha: float = 0.5
    beta: float = 0.5
    timeout_secs: float = 600
    probes: tuple[str, ...] = tuple(PROBES)
    score_ramp_depth: int = 0
    score_min_depth: int = 0
    proofs: int = 32
    min_proofs: int = 4
    max_rounds: int = 30
    tokens: int = 1024
    min_tokens: int = 256
    decay_depth: int = 8
    budget: int = 256
    exploration: float = 1.41
    unchanged_limit: int = 3
    have_limit: int = 4
    goal_penalty: float = 0.3
    temperature: float = 0.8
    max_temperature: float = 0.0

    def share(self, depth: int) -> float:
        """How far the ramps by depth have come, 0 to 1."""
        return min(depth / self.decay_depth, 1.0) if self.decay_depth else 0.0

    def tokens_at(self, depth: int) -> int:
        return max(self.tokens - int(max(0, self.tokens - self.min_tokens) * self.share(depth)), self.min_tokens if self.decay_depth else 0)

    def proofs_at(self, depth: int) -> int:
        return max(self.proofs - int(max(0, self.proofs - self.min_proofs) * self.share(depth)), self.min_proofs if self.decay_depth else 0)

    def temperature_at(self, depth: int) -> float:
        if self.max_temperature <= 0 or not self.decay_depth:
            return self.temperature
        return min(self.temperature + (self.max_temperature - self.temperature) * self.share(depth), self.max_temperature)

    def beta_at(self, depth: int) -> float:
        if not self.scores_at(depth):
            return 0.0
        return self.beta * min(depth / self.score_ramp_depth, 1.0) if self.score_ramp_depth else self.beta

    def scores_at(self, depth: int) -> bool:
        return depth >= self.score_min_depth


class Answer(NamedTuple):
    kind: str
    state_id: int = 0
    goals: tuple[str, ...] = ()


class Proposal(NamedTuple):
    text: str
    log_prob: float


FAILED = Answer("failed")


class Tables:
    """One theorem's environment and policy."""

    def __init__(self, transitions: pd.DataFrame, policy: pd.DataFrame):
        self.moves = {(int(r.state_id), r.tactic): Answer(r.kind, int(0 if pd.isna(r.next_state_id) else r.next_state_id), tuple(r.goals) if r.goals is not None else ()) for r in transitions.itertuples()}
        self.start = int(transitions.state_id.min()) if len(transitions) else 0
        self.said: dict[str, dict[str, list[Proposal]]] = {"exact": {}, "contains": {}, "default": {}}
        for r in policy.sort_values("ord").itertuples():
            self.said[r.match].setdefault(r.pattern or "", []).append(Proposal(r.text, float(r.log_prob)))

    def apply(self, state_id: int, tactic: str) -> Answer:
        return self.moves.get((state_id, tactic), FAILED)

    def propose(self, state: str, n: int, tokens: int, temperature: float) -> list[Proposal]:
        if state in self.said["exact"]:
            return self.said["exact"][state]
        held = next((v for p, v in self.said["contains"].items() if p in state), None)
        return held if held is not None else self.said["default"].get("", [])


def squeezed(tactic: str) -> str:
    return " ".join(tactic.split())


def target(goal: str) -> str:
    _, turnstile, rest = goal.partition("⊢")
    return rest.strip() if turnstile else goal


@dataclass
class Node:
    state_id: int
    goals: tuple[str, ...]
    parent: int | None
    tactic: str
    depth: int
    log_prob: float
    done: bool = False
    score: float = 0.0
    visits: int = 0
    wins: int = 0
    below: dict[str, int | None] = field(default_factory=dict)  # squeezed tactic → child, None: failed

    @property
    def state(self) -> str:
        return "\n\n".join(self.goals)

    @property
    def value(self) -> float:
        return self.wins / self.visits if self.visits else 0.0


class Search:
    """Best-first search for one theorem; states are numbered as they are found."""

    def __init__(self, statement: str, world, settings: Settings, scorer: Callable[[list[str]], list[float]] | None = None):
        root = statement if "⊢" in statement else f"⊢ {statement}"
        self.world, self.settings, self.scorer = world, settings, scorer
        self.nodes = [Node(world.start, (root,), None, "", 0, 0.0)]
        self.seen, self.touched, self.stats, self.deepest = {root}, set(), Counter(), 0

    def up(self, at: int):
        while at is not None:
            yield at, self.nodes[at]
            at = self.nodes[at].parent

    def visit(self, at: int) -> None:
        self.nodes[at].visits += 1
        self.touched.add(at)

    def add(self, parent: int, tactic: str, answer: Answer, log_prob: float) -> int:
        depth = self.nodes[parent].depth + 1
        done = answer.kind == "complete"
        self.deepest = max(self.deepest, depth)
        self.stats["terminal"] += done
        self.nodes.append(Node(answer.state_id, () if done else answer.goals, parent, tactic, depth, log_prob, done))
        self.nodes[parent].below[squeezed(tactic)] = len(self.nodes) - 1
        return len(self.nodes) - 1

    def won(self, at: int) -> int:
        for i, node in self.up(at):
            node.wins += 1
            self.touched.add(i)
        return at

    def known(self, at: int, tactic: str) -> tuple[bool, int | None]:
        below = self.nodes[at].below
        return squeezed(tactic) in below, below.get(squeezed(tactic))

    def move(self, at: int, tactic: str) -> Answer:
        """Asks the world; failures and states seen before are remembered as failed."""
        self.stats["attempts"] += 1
        answer = self.world.apply(self.nodes[at].state_id, tactic)
        loop = answer.kind == "success" and "\n\n".join(answer.goals) in self.seen
        if answer.kind not in ("success", "complete") or loop:
            self.stats["loops" if loop else "failures"] += 1
            self.nodes[at].below[squeezed(tactic)] = None
            return FAILED
        return answer

    def probe(self, at: int) -> int | None:
        """Tries the probes at a state; the complete state that one leads to, if any."""
        if self.settings.probes:
            self.visit(at)
        for tactic in self.settings.probes:
            known, child = self.known(at, tactic)
            if known:
                self.stats["cache_hits"] += 1
            else:
                self.stats["probe_attempts"] += 1
                answer = self.move(at, tactic)
                if answer.kind == "failed":
                    continue
                child = self.add(at, tactic, answer, PROBE_LOG_PROB)
                self.stats["probe_successes"] += 1
                self.seen.add(self.nodes[child].state) if not self.nodes[child].done else None
            if child is not None and self.nodes[child].done:
                return child
        return None

    def spiralling(self, at: int) -> bool:
        """Whether a new state's branch goes nowhere: goals stay, a ``have`` adds goals, or ``have`` follows ``have``."""
        s, node = self.settings, self.nodes[at]
        unchanged = haves = 0
        targets = [[target(g) for g in n.goals] for _, n in self.up(at)]
        for mine, theirs in zip(targets, targets[1:]):
            if mine != theirs:
                break
            unchanged += 1
        if s.unchanged_limit and unchanged >= s.unchanged_limit:
            self.stats["unchanged_pruned"] += 1
            return True
        if not node.tactic.startswith("have "):
            return False
        if len(node.goals) > len(self.nodes[node.parent].goals):
            self.stats["have_goals_pruned"] += 1
            return True
        for _, n in self.up(at):
            if not n.tactic.startswith("have "):
                break
            haves += 1
        if s.have_limit and haves >= s.have_limit:
            self.stats["have_chain_pruned"] += 1
            return True
        return False

    def replay(self, at: int, proposal: Proposal) -> int | None:
        """Follows a proposed proof from a state; the complete state it leads to, if any."""
        steps = P.steps(proposal.text)
        if any(_gives_up(t) for t in steps):
            return None
        for tactic in steps:
            self.visit(at)
            known, child = self.known(at, tactic)
            if known:
                if child is None or self.nodes[child].done:
                    return None
                self.stats["cache_hits"] += 1
                at = child
                continue
            answer = self.move(at, tactic)
            if answer.kind == "failed":
                return None
            if answer.kind == "complete":
                return self.won(self.add(at, tactic, answer, proposal.log_prob))
            depth = self.nodes[at].depth + 1
            self.deepest = max(self.deepest, depth)
            if depth >= self.settings.max_depth:
                self.stats["depth_capped"] += 1
                return None
            at = self.add(at, tactic, answer, proposal.log_prob)
            self.seen.add(self.nodes[at].state)
            if self.spiralling(at):
                return None
            if (found := self.probe(at)) is not None:
                return self.won(found)
        return None

    def rate(self, nodes: list[int]) -> None:
        """Scores new states; those above the least depth for scores get the lowest."""
        if self.scorer is None:
            return
        due = [i for i in nodes if self.settings.scores_at(self.nodes[i].depth)]
        for i, score in zip(due, self.scorer([self.nodes[i].state for i in due]) if due else []):
            self.nodes[i].score = float(score)
        for i in set(nodes) - set(due):
            self.nodes[i].score = UNSCORED
        self.stats["scored"] += len(due)

    def priority(self, at: int) -> float:
        s, node = self.settings, self.nodes[at]
        prior = node.score if self.scorer is not None and s.scores_at(node.depth) else node.log_prob
        tried = self.nodes[node.parent].visits if node.parent is not None else 0
        a = s.alpha / (1 + node.visits)
        return a * prior + (1 - a) * node.value + s.exploration * math.sqrt(math.log(tried + 1) / (1 + node.visits)) - s.goal_penalty * max(0, len(node.goals) - 1)

    def run(self) -> dict:
        """Runs to a proof or an end: ``timeout``, ``budget_exhausted``, ``max_rounds``, ``frontier_exhausted``."""
        s, began, asked, rounds, expanded, found = self.settings, time.monotonic(), 0, 0, set(), None
        self.rate([0])
        frontier = [(-self.priority(0), 0)]
        open_ = lambda i: i not in expanded and not self.nodes[i].done and self.nodes[i].depth < s.max_depth
        while True:
            if s.timeout_secs > 0 and time.monotonic() - began >= s.timeout_secs:
                reason = "timeout"
            elif asked >= s.budget:
                reason = "budget_exhausted"
            elif rounds >= s.max_rounds:
                reason = "max_rounds"
            else:
                while frontier and not open_(frontier[0][1]):
                    heapq.heappop(frontier)
                reason = None if frontier else "frontier_exhausted"
            if reason:
                break
            at = heapq.heappop(frontier)[1]
            expanded.add(at)
            rounds += 1
            before = len(self.nodes)
            if (found := self.probe(at)) is not None:
                self.won(found)
            else:
                depth = self.nodes[at].depth
                proposals = self.world.propose(self.nodes[at].state, s.proofs_at(depth), s.tokens_at(depth), s.temperature_at(depth))
                asked += len(proposals)
                found = next((f for p in proposals if (f := self.replay(at, p)) is not None), None)
            if found is not None:
                reason = "proved"
                break
            new = [i for i in range(before, len(self.nodes)) if not self.nodes[i].done]
            self.rate(new)
            old = {i for i in self.touched if i < before}
            self.touched -= old
            for i in [*old, *new]:
                if open_(i):
                    heapq.heappush(frontier, (-self.priority(i), i))
        tactics = [n.tactic for _, n in self.up(found) if n.tactic][::-1] if found is not None else []
        return {"proved": found is not None, "reason": reason, "tactics": tactics, "expanded": len(expanded), "states": len(self.nodes), "max_depth": self.deepest, "rounds": rounds, "proposals": asked, "stats": dict(self.stats)}

    def rows(self, name: str, now_ms: int) -> list[tuple]:
        return [(name, i, "" if n.done else n.state, n.tactic, n.parent, "unknown", n.depth, -1, n.log_prob, n.score, n.done, now_ms, n.value, n.visits) for i, n in enumerate(self.nodes)]


def _gives_up(tactic: str) -> bool:
    import re

    return re.search(r"(?<![A-Za-z0-9_])(?:sorry|admit|cheat)(?![A-Za-z0-9_])", tactic) is not None


class Walk:
    """Along a known proof: what else could have been done at each of its states."""

    def __init__(self, name: str, steps: list[tuple[str, str, int]], world, per_step: int, enough: int):
        self.name, self.steps, self.world, self.per_step, self.enough = name, steps, world, per_step, enough
        self.rows: list[list] = []
        self.counts = Counter()
        spaces = name.split(".")[:-1]
        self.prefix = f"open {' '.join('.'.join(spaces[: i + 1]) for i in range(len(spaces)))} in " if spaces else ""

    def add(self, label: str, state_id: int, state: str, tactic: str, parent: int | None, depth: int, left: int = -1, log_prob: float = 0.0, done: bool = False) -> list:
        self.rows.append([self.name, state_id, state, tactic, parent, label, depth, left, log_prob, 0.0, done, 0, 0.0, 0])
        return self.rows[-1]

    def apply(self, state_id: int, tactic: str) -> Answer:
        """With the theorem's namespaces open, else as it stands; no goals left is complete."""
        answer = self.world.apply(state_id, self.prefix + tactic) if self.prefix else FAILED
        if answer.kind == "failed":
            answer = self.world.apply(state_id, tactic)
        return Answer("complete", answer.state_id) if answer.kind == "success" and not answer.goals else answer

    def negatives(self) -> int:
        return sum(r[5] == "negative" for r in self.rows)

    def chain(self, first: list, answer: Answer, more: list[str], depth: int) -> None:
        """The steps after a candidate's first; if they end the proof, all of them were right."""
        added, at = [first], answer.state_id
        for k, tactic in enumerate(more):
            got = self.apply(at, tactic)
            if got.kind == "complete":
                self.counts["alternative_proofs"] += 1
                for row in added:
                    row[5] = "positive"
            if got.kind != "success":
                return
            added.append(self.add("negative", at, got.goals[0], tactic, at, depth + k))
            at = got.state_id

    def run(self) -> dict:
        total, state_id, state, lost, completed, walked = len(self.steps), self.world.start, None, False, False, 0
        for k, (text, tactic, depth) in enumerate(self.steps):
            self.add("positive", 0, text, tactic, 0 if k else None, depth, total - k)
        for k, (text, known, depth) in enumerate(self.steps):
            walked, here, ahead = k + 1, text if state is None else state, None
            parent = max(0, state_id - 1) if k else None
            proposals = [] if lost else self.world.propose(here, self.per_step, 0, 0.0)[: self.per_step]
            asked = {squeezed(known)} | {squeezed(P.first_step(p.text)) for p in proposals}
            tries = [(P.first_step(p.text), p, False) for p in proposals] + [(t, Proposal(t, 0.0), True) for t in [*PROBES, "intro _"] if t not in asked]
            for tactic, p, probe in tries:
                if self.negatives() >= self.enough:
                    break
                if squeezed(tactic) == squeezed(known):
                    continue
                got = self.apply(state_id, tactic)
                if got.kind == "complete":
                    self.counts["alternative_proofs"] += 1
                    self.add("positive", state_id, here, tactic, parent, depth, total - k, p.log_prob, True)
                elif got.kind == "success":
                    row = self.add("positive" if lost and probe else "negative", state_id, got.goals[0], tactic, parent, depth + 1, -1, p.log_prob)
                    if probe:
                        ahead = got
                    else:
                        self.chain(row, got, P.flat_steps(p.text)[1:], depth + 2)
            if self.negatives() >= self.enough:
                break
            got = FAILED if lost else self.apply(state_id, known)
            if got.kind == "complete":
                completed = True
                break
            if got.kind == "failed":  # the known proof is lost: a probe that leads on shows the way
                lost, got = True, ahead
            if got is None:
                break
            state_id, state = got.state_id, got.goals[0]
        positives = sum(r[5] == "positive" for r in self.rows)
        return {"steps_walked": walked, "total_steps": total, "completed": completed or walked == total, "positives": positives, "negatives": self.negatives(), "alternative_proofs": self.counts["alternative_proofs"]}


# -- on tables -----------------------------------------------------------------------------------

OUT = T.StructType([*schemas.TRAJECTORY.fields, T.StructField("result", T.StringType())])
RESULT = "proved boolean, reason string, tactics array<string>, expanded long, states long, max_depth int, rounds long, proposals long, stats map<string,long>"
WALKED = "steps_walked int, total_steps int, completed boolean, positives long, negatives long, alternative_proofs long"
_SIDE = {"statement": "string", "state": "string", "depth": "int", "state_id": "long", "tactic": "string", "kind": "string", "next_state_id": "long", "goals": "array<string>", "pattern": "string", "match": "string", "ord": "long", "text": "string", "log_prob": "double"}


_NEEDED = {"theorem": "statement", "step": "state tactic depth", "transition": "state_id tactic kind next_state_id goals", "policy": "pattern match ord text log_prob"}


def _together(**tables: DataFrame) -> DataFrame:
    """All rows with their table's name as role, for grouping by theorem in one exchange."""
    out = None
    for role, df in tables.items():
        if lacking := set(_NEEDED[role].split()) - set(df.columns):
            raise ValueError(f"{role} rows lack {', '.join(sorted(lacking))}")
        part = df.select(F.lit(role).alias("role"), "theorem_name", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _SIDE.items()])
        out = part if out is None else out.unionByName(part)
    return out


def _rows(rows: list, result: dict) -> pd.DataFrame:
    told = [json.dumps(result), *[None] * (len(rows) - 1)] if rows else []
    return pd.DataFrame([(*r, x) for r, x in zip(rows, told)], columns=OUT.fieldNames(), dtype=object)


def best_first(theorems: DataFrame, transitions: DataFrame, policy: DataFrame, settings: Settings = Settings(), scorer=None, now_ms: int = 0) -> DataFrame:
    """Trajectory rows of a search for each of ``theorems`` (theorem_name, statement); its result as JSON on the root's row."""
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.role == "theorem"]
        if own.empty:
            return _rows([], {})
        s = Search(own.statement.min(), Tables(pdf[pdf.role == "transition"], pdf[pdf.role == "policy"]), settings, scorer)
        result = s.run()
        return _rows(s.rows(own.theorem_name.iloc[0], now_ms), result)

    return _together(theorem=theorems, transition=transitions, policy=policy).groupBy("theorem_name").applyInPandas(search, OUT)


def along_proofs(pairs: DataFrame, transitions: DataFrame, policy: DataFrame, per_step: int = 8, enough: int = 15) -> DataFrame:
    """Positive and negative rows found along known proofs (theorem_name, state, tactic, depth); counts as JSON on each first row.

    Steps without a depth are left out.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf.role == "step") & pdf.depth.notna()].sort_values("depth")
        if own.empty:
            return _rows([], {})
        w = Walk(own.theorem_name.iloc[0], list(zip(own.state, own.tactic, own.depth.astype(int))), Tables(pdf[pdf.role == "transition"], pdf[pdf.role == "policy"]), per_step, enough)
        result = w.run()
        return _rows(w.rows, result)

    return _together(step=pairs, transition=transitions, policy=policy).groupBy("theorem_name").applyInPandas(walk, OUT)


def trajectories(found: DataFrame) -> DataFrame:
    return found.drop("result")


def results(found: DataFrame, schema: str = RESULT) -> DataFrame:
    """One row for each theorem that :func:`best_first` (or, with WALKED, :func:`along_proofs`) returned rows for."""
    return found.filter("result is not null").select("theorem_name", F.from_json("result", schema).alias("r")).select("theorem_name", "r.*")


def settings(values: dict) -> Settings:
    """Settings from a mapping; names it doesn't know are an error."""
    known = {f.name for f in fields(Settings)}
    if unknown := set(values) - known:
        raise ValueError(f"no setting {', '.join(sorted(unknown))}")
    return Settings(**{k: tuple(v) if k == "probes" else v for k, v in values.items()})
