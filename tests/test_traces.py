"""Golden trees and texts, readers and writers, streams, and every query against its SQL."""
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import analytics, curate, metrics, ranks, tree
from cairn.plans import QUERIES, SQL
from cairn.sources import readers, writers

SF = "/root/testdata/sf0.001"
SCHEMA = "theorem_name string, state_id long, state_pp string, tactic_applied string, parent_state_id long, label string, depth_from_root int, remaining_depth int, llm_log_prob double, ebm_score double, is_proof_complete boolean, timestamp_ms long, q_value double, visits long"


def rows(name, edges, done=(), depth=None):
    """edges: state → parent."""
    at = lambda s: 0 if edges[s] is None else 1 + at(edges[s])
    return [(name, s, f"⊢ goal_{s}", "" if p is None else f"tactic_{s}", p, "unknown", at(s), -1, -0.3 * s, 0.0, s in done, 1_700_000_000_000 + s, 0.0, 0) for s, p in edges.items()]


@pytest.mark.parametrize("edges,done,want", [
    ({0: None, 1: 0, 2: 1, 3: 2, 4: 1}, [3], {0: 3, 1: 2, 2: 1, 3: 0, 4: -1}),
    ({0: None}, [0], {0: 0}),
    ({0: None, 1: 0}, [], {0: -1, 1: -1}),
    ({0: None, 1: 0, 2: 1, 3: 0, 4: 3}, [2, 4], {0: 2, 1: 1, 2: 0, 3: -1, 4: -1}),
    ({0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 3}, [2], {0: 2, 1: 1, 2: 0, 3: -1, 4: -1, 5: -1}),
])
def test_labels(spark, edges, done, want):
    df = spark.createDataFrame(rows("a", edges, done) + rows("b", {0: None, 1: 0}), SCHEMA)
    got = {(r.theorem_name, r.state_id): (r.label, r.remaining_depth) for r in tree.label_paths(df).collect()}
    assert got == {("a", s): ("positive" if d >= 0 else "negative", d) for s, d in want.items()} | {("b", 0): ("negative", -1), ("b", 1): ("negative", -1)}


def test_cycles_end(spark):
    df = spark.createDataFrame([r if r[1] else (*r[:4], 1, *r[5:]) for r in rows("a", {0: None, 1: 0, 2: 1}, [2])], SCHEMA)
    assert {r.state_id: r.remaining_depth for r in tree.label_paths(df).collect()} == {0: 2, 1: 1, 2: 0}
    with pytest.raises(ValueError):
        tree.checked(df.union(df))


def test_summary_golden(spark):
    data = []
    for i in range(5):
        data += rows(f"proved{i}", {0: None, 1: 0, 2: 1, 3: 0}, [2])
    for i in range(3):
        data += rows(f"open{i}", {0: None, 1: 0})
    s = analytics.summary(tree.label_paths(spark.createDataFrame(data, SCHEMA))).first()
    assert (s.n_rows, s.positive, s.negative, s.theorems, s.proved) == (26, 15, 11, 8, 5)


def test_text(spark):
    one = lambda c, **v: spark.range(1).select(c(*[F.lit(x) for x in v.values()]).alias("x")).first().x
    heads = {"": "(root)", None: "(root)", "· simp": "simp", "<;> ring": "ring", "-- note": "(comment)", "  rw [a] at h": "rw", "·": "(root)"}
    for t, want in heads.items():
        assert one(lambda c: text.tactic_head(c.cast("string")), t=t) == want
    assert [one(text.count_goals, t=t) for t in ("", "⊢ a", "⊢ a\n\n⊢ b", "\n\n ")] == [0, 1, 2, 0]
    assert one(text.count_hypotheses, t="x y : ℕ\nh : x > 0\n⊢ x : y\nz : ℕ") == 2
    assert one(text.modernised, t="rw [le_div_iff h, le_div_iff₀, le_div_iff_of, add_left_neg]; ∑ i in s, f i") == "rw [le_div_iff₀ h, le_div_iff₀, le_div_iff_of, neg_add_cancel]; ∑ i ∈ s, f i"
    assert [one(text.gives_up, t=t) for t in ("sorry", "exact sorry", "sorry_free", "(admit)", "cheater")] == [True, True, False, True, False]
    assert one(text.topics, t="x : ℝ\n⊢ Continuous f") == ["analysis"] and one(text.topics, t="⊢ p") == ["other"]
    assert one(text.open_prefixes, t="A.B.c") == ["A", "A.B"]
    assert [one(text.duration, t=t) for t in (30, 2712, 9000)] == ["30s", "45m12s", "2h30m"]
    p = one(text.contest_parts, t="putnam_1988_b1")
    assert (p.year, p.section, p.number) == (1988, "B", 1)
    g = one(text.goal_parts, t="x : ℕ\n h : p \n⊢ x = x")
    assert g.hypotheses == ["x : ℕ", "h : p"] and g.target == "x = x"


def test_percentiles(spark):
    wanted = {f"p{int(100 * p)}": ("id", ranks.indexed(p)) for p in (0.5, 0.95, 0.99)} | {"m": ("id", ranks.linear(0.5)), "u": ("id", ranks.upper_median())}
    assert tuple(ranks.percentiles(spark.range(1, 101), wanted).first()) == (51, 96, 100, 50.5, 51)
    assert ranks.percentiles(spark.range(0), wanted).count() == 0
    assert analytics.eval_totals(spark.createDataFrame([], SCHEMA)).first().median_time == 0.0


def test_read_write(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    df = tree.label_paths(spark.createDataFrame(rows("a", {0: None, 1: 0, 2: 1}, [2]), SCHEMA))
    old = pa.table({"theorem_name": ["t"], "state_id": pa.array([0], pa.uint64()), "state_pp": ["s"], "tactic_applied": [""], "parent_state_id": pa.array([None], pa.uint64()), "label": ["odd"], "depth_from_root": pa.array([0], pa.uint32()), "remaining_depth": pa.array([-1], pa.int32()), "llm_log_prob": [0.0], "ebm_score": [0.0], "is_proof_complete": [False], "timestamp_ms": pa.array([1], pa.uint64())})
    pq.write_table(old, tmp_path / "old.parquet")
    got = readers.trajectories(spark, str(tmp_path / "old.parquet"))
    assert dict(got.dtypes)["state_id"] == "bigint" and (got.first().label, got.first().q_value, got.first().visits) == ("unknown", 0.0, 0)
    path = str(tmp_path / "new")
    writers.trajectories(df.limit(0), path)
    writers.trajectories(df, path, "append")
    assert readers.trajectories(spark, path).count() == 3
    (tmp_path / "i.json").write_text(json.dumps({"theorems": [{"name": "a", "statement": "p"}, {"name": "b", "statement": "q", "line_number": 3}]}))
    assert [r.name for r in readers.theorem_index(spark, str(tmp_path / "i.json"), 1).collect()] == ["a"]
    (tmp_path / "skip.txt").write_text("# no\n\nx\ny\nx\n")
    assert {r.name for r in readers.skip_list(spark, str(tmp_path / "skip.txt")).collect()} == {"x", "y"}
    (tmp_path / "c.toml").write_text("a = 2\n")
    assert readers.config({"a": 1, "b": 1}, str(tmp_path / "c.toml"), {"b": 5, "a": None}) == {"a": 2, "b": 5}
    assert writers.markdown(spark.createDataFrame([(1, "x")], "a int, b string")).splitlines()[0] == "| a | b |"
    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), limit=4)
    both = readers.with_file_order(spark, [path, str(tmp_path / "old.parquet"), path])
    assert sorted((r.theorem_name, r.file_ord) for r in both.collect()) == [("a", 0)] * 3 + [("t", 1)]
    pairs = spark.createDataFrame([("train", "x", "a", "s", 0), ("train", "y", "a", "s", 3), ("val", "z", "b", "s", 2)], "split string, text string, theorem string, source string, depth int")
    writers.split_with_pool(pairs, str(tmp_path / "sft"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "sft" / "pool")).select("theorem", "source", "max_depth").collect()] == [("a", "s", 3)]
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "sft" / "splits")).select("split", "theorem", "text").collect()) == [("train", "a", "x"), ("train", "a", "y"), ("val", "b", "z")]


def test_contrastive_samples(spark):
    df = tree.label_paths(spark.createDataFrame(sum([rows(f"t{i}", {0: None, 1: 0, 2: 1, 3: 0, 4: 3}, [2]) for i in range(6)], []), SCHEMA))
    got = curate.contrastive_samples(df, 20, 5, 0.4, 0.2).collect()
    again = curate.contrastive_samples(df.repartition(3), 20, 5, 0.4, 0.2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 120
    by = {}
    for r in got:
        by.setdefault(r.sample, []).append(r)
    for s in by.values():
        own = next(r for r in s if r.slot == 0)
        assert own.tier == "positive" and sorted(r.tier for r in s) == ["easy"] * 2 + ["other"] + ["positive"] + ["sibling"] * 2
        assert all((r.theorem_name == own.theorem_name) == (r.tier != "easy") for r in s)


def test_health(spark):
    r = metrics.health(spark.createDataFrame([(0.01, -1.0, 0.99, 0.9, 1.0, -1.0, float("nan"), 0.001)], "energy_std double, energy_gap double, rank_accuracy double, contrastive_loss double, pos_energy_mean double, neg_energy_mean double, loss double, active_fraction double")).first()
    assert len(r.warnings) == 6


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (bool, int)) or v is None:
        return v
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols
        assert sorted(repr([plain(r[c]) for c in cols]) for r in got) == sorted(repr([plain(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
    else:
        assert got
