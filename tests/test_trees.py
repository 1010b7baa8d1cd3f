"""Walks over whole trees against plain walks, signatures and declarations, readers, and functions of a column."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import proofs as P
from cairn.functions import stats
from cairn.functions import text as T
from cairn.functions import vectors as V
from cairn.operators import forest, ranks, reports, training, tree
from cairn.sources import readers

NODES = "theorem_name string, state_id long, parent_state_id long, is_proof_complete boolean, visits int, tactic_applied string, state_pp string"


def random_trees(seed):
    rng, rows = random.Random(seed), []
    for t in range(40):
        n = rng.randint(1, 60)
        ids = rng.sample(range(-5, 500), n)
        for k, i in enumerate(ids):
            parent = None if rng.random() < 0.05 else rng.choice(ids) if rng.random() < 0.1 else ids[rng.randrange(k)] if k else None
            rows.append((f"t{t}" if t else None, i, 10_000 if rng.random() < 0.02 else parent, rng.random() < 0.1, rng.randint(0, 3), rng.choice(["have h", "simp", "have x", None]), f"⊢ {rng.randrange(2)}"))
    rng.shuffle(rows)
    return rows


def up(rows, key):
    """The row and those above it, until one comes again."""
    at, seen = key, []
    while at in rows and at not in seen:
        seen.append(at)
        at = (key[0], rows[at][2])
    return seen


@pytest.mark.parametrize("batch", [7, 10_000])
def test_walks(spark, batch):
    data = random_trees(batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df, rows = spark.createDataFrame(data, NODES), {(r[0], r[1]): r for r in data}
        labels = {(r.theorem_name, r.state_id): r.remaining_depth for r in tree.label_paths(df).collect()}
        want = dict.fromkeys(rows, -1)
        for t in {k[0] for k in rows}:
            if done := [i for (u, i), r in rows.items() if u == t and r[3]]:
                want |= {k: n for n, k in enumerate(up(rows, (t, min(done))))}
        assert labels == want
        counts = dict.fromkeys(rows, 0)
        for k, r in rows.items():
            for a in up(rows, k) if r[3] else []:
                counts[a] += 1
        assert {(r.theorem_name, r.state_id): r.successes for r in tree.backed_up(df).collect()} == counts

        def run(key, ok):
            n = 0
            for a in up(rows, key):
                if not ok(a):
                    break
                n += 1
            return n

        have = lambda k: (rows[k][5] or "").startswith("have ")
        assert {(r.theorem_name, r.state_id): r.chain for r in tree.have_chains(df).collect()} == {k: run(k, have) for k in rows}
        same = lambda k: (k[0], rows[k][2]) in rows and rows[k[0], rows[k][2]][6] == rows[k][6]
        assert {(r.theorem_name, r.state_id): r.chain for r in reports.unchanged_chains(df).collect()} == {k: run(k, same) for k in rows}
        starts = df.filter("state_id % 3 = 0 and theorem_name is not null")
        got = sorted((r.theorem_name, r.start_id, r.state_id, r.steps) for r in tree.ancestors(starts, df).collect())
        assert got == sorted((k[0], k[1], a[1], n) for k in rows if k[0] and k[1] % 3 == 0 for n, a in enumerate(up(rows, k)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_ids_raise(spark):
    df = spark.createDataFrame([("a", 0, None, True, 0, "", ""), ("a", 1, 0, True, 0, "", ""), ("a", 1, 0, False, 0, "", "")], NODES)
    for walk in (tree.label_paths, tree.backed_up, tree.have_chains, reports.unchanged_chains):
        with pytest.raises(Exception, match="state 1 of a occurs twice"):
            walk(df).collect()
    assert tree.label_paths(df.limit(0)).count() == 0
    loop = forest.Forest(pa.table({"theorem_name": ["a", "a", "b"], "state_id": [1, 2, 1], "parent_state_id": [2, 1, None]}))
    assert loop.up.tolist() == [1, 0, -1] and loop.rounds().tolist() == [True, True, False]


def test_labels_take_one_exchange(spark):
    plan = tree.label_paths(spark.createDataFrame(random_trees(1), NODES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sources():
    source = "/-- note -/\nnoncomputable abbrev a_solution : ℝ\n  := sorry -- (1)\ndef f (n : ℕ) : ℕ := n\n  + 1\nnoncomputable def g : ℕ → ℕ\n| 0 => 1\ntheorem a (x : ℝ) -- a note\n\n  (h : x = 1) : x = a_solution := by sorry\nlemma b {y : ℕ}, y = y := rfl\ntheorem c"
    assert P.definitions(source) == ["noncomputable abbrev a_solution : ℝ := sorry", "def f (n : ℕ) : ℕ := n\n  + 1", "noncomputable def g : ℕ → ℕ\n| 0 => 1"]
    assert P.typed_declarations(source) == [{"name": "a", "statement": "∀ (x : ℝ) \n  (h : x = 1), x = a_solution"}, {"name": "b", "statement": "∀ {y : ℕ}, y = y"}]
    assert [P.signature_as_expression(x) for x in ("(a : T) (b : U)", "", " : P ", "(a) ⟨b⟩ : P : Q", "∀ x : T, P")] == ["(a : T) (b : U)", "", "P", "∀ (a) ⟨b⟩, P : Q", "∀ x : T, P"]
    assert [P.typed_as_expression(x) for x in ("(a : T) (b : U)", "[i] : P", ", P", "(a [b) : P")] == ["(a : T) (b : U)", "[i] : P", "P", "∀ (a [b), P"]


def test_records(spark):
    df = spark.createDataFrame([("a", "s1", "positive"), ("a", "s2", "negative"), ("b", "s1", "negative"), ("c", None, "negative")], "theorem_name string, state_pp string, label string")
    cache = spark.createDataFrame([("s1", [1.0]), ("s9", [2.0])], "state_pp string, embedding array<float>")
    assert training.with_vectors(df, cache).count() == 2 and training.with_vectors(df, cache).columns == df.columns
    assert {(r.state_pp, r.embedding is None) for r in training.vectors_of(df, cache).collect()} == {("s1", False), ("s2", True), (None, True)}
    assert sorted((r.label, r.before, r.kept, r.dropped) for r in training.vector_counts(df, cache, "label").collect()) == [("negative", 3, 1, 2), ("positive", 1, 1, 0)]
    pairs = spark.createDataFrame([("a", "x"), ("z", "y"), (None, "n")], "theorem string, state string")
    assert training.merged_pairs(df, pairs).count() == 5
    assert {r.theorem_name for r in training.first_theorems(df, 2).collect()} == {"a", "b"}


def test_usable_embeddings_keep_the_last(spark, tmp_path):
    rows = [("s", [9.0, 9.0]), ("s", [1.0, 2.0]), ("t", [0.0, 0.0]), ("u", [3.0, 4.0])]
    spark.createDataFrame(rows, "state_pp string, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = {r.state_pp: r.embedding for r in readers.usable_embeddings(readers.embeddings(spark, str(tmp_path / "e"))).collect()}
    assert got == {"s": [1.0, 2.0], "u": [3.0, 4.0]}


def test_columns(spark):
    df = spark.createDataFrame([(0.1, True), (0.4, True), (0.4, False), (0.2, False), (None, True)], "s double, p boolean")
    rng = np.random.Generator(np.random.PCG64(1))
    many = spark.createDataFrame([(float(round(x, 2)), bool(x + y > 0)) for x, y in rng.standard_normal((400, 2))], "s double, p boolean")
    for d in (df, many):
        pos, neg = [[r.s for r in d.collect() if r.p == ok and r.s is not None] for ok in (True, False)]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        for cuts in (1, 7, 200):
            assert abs(stats.auc("s", "p", d, cuts).first().auc - want) < 1e-12
    assert stats.auc("s", "p", df.filter("p")).first().auc is None
    assert ranks.percentiles(spark.range(5), {"x": ("id", ranks.linear(0.375))}).first().x == 1.5
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.renamed_source(F.lit("rw [le_div_iff, le_div_iff₀, nle_div_iff] ; ∑ i in S"))) == "rw [le_div_iff₀, le_div_iff₀, nle_div_iff] ; ∑ i ∈ S"
    assert one(V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0


def test_cut_bytes(spark):
    texts = ["", "abc", "aé", "é∀x", "a𝓝b", "𝓝𝓝", "∀" * 5]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for most in range(0, 9):
        got = [r.x for r in df.select(T.cut_bytes(F.col("t"), most).alias("x")).collect()]
        assert got == [t.encode()[:most].decode("utf-8", "ignore") for t in texts] + [None]


def test_leaves_have_goals(spark):
    rows = [("t", 0, None, " ", False), ("t", 1, 0, "⊢ a", False), ("t", 2, 0, " \n", False), ("t", 3, 0, "⊢ c", True), ("u", 0, None, " ", False), ("u", 1, None, None, False)]
    df = spark.createDataFrame(rows, "theorem_name string, state_id long, parent_state_id long, state_pp string, is_proof_complete boolean")
    assert sorted((r.theorem_name, r.state_id) for r in tree.leaves(df).collect()) == [("t", 1), ("u", 0), ("u", 1)]


def test_small_functions(spark, tmp_path):
    import hashlib

    from cairn.operators import curate

    texts = ["rw [Nat.succ_le, h₀.symm] Foo", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(T.lemma_names(F.col("t")).alias("x")).collect()] == ["Nat.succ_le,h₀.symm,Foo", "", None]
    assert [r.x for r in spark.createDataFrame([("Failed to Synthesize x",), ("⊢ a",), ("unknown identifier",)], "t string").select(T.broken_state(F.col("t")).alias("x")).collect()] == [True, False, True]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "r array<array<double>>, m array<int>")
    assert [r.x for r in v.select(V.mean_pool(F.col("r"), F.col("m")).alias("x")).collect()] == [[2.0, 3.0], [0.0, 0.0]]
    tok = spark.createDataFrame([([5, 1, 2, 7, 8],), ([5, 6],), ([1, 2],)], "x array<int>")
    assert [r.y for r in tok.select(curate.completion_labels(F.col("x"), [1, 2]).alias("y")).collect()] == [[-100, -100, -100, 7, 8], [-100, -100], [-100, -100]]
    steps = spark.createDataFrame([(i, "simp" if i % 2 else "have h") for i in range(400)], "k int, tactic string")
    kept = {r.k for r in curate.thinned(steps, "tactic", F.col("k")).collect()}
    assert kept == {i for i in range(400) if not i % 2 or int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 4294967295 < 0.1}
    pairs = spark.createDataFrame([(f"t{i}", d) for i in range(30) for d in range(3)] + [("gap", 0), ("gap", 2)], "theorem string, depth int")
    assert curate.complete_groups(pairs, "theorem", "depth", 2, sample=7).count() == 7 and curate.complete_groups(pairs, "theorem", "depth", 2).count() == 30
    for name, text in (("b.lean", "theorem b"), ("a.lean", "line\n\x1b[32mgreen\x1b[0m")):
        (tmp_path / name).write_text(text)
    assert [r.text for r in readers.whole_texts(spark, str(tmp_path), 1).collect()] == ["line\n\x1b[32mgreen\x1b[0m"] and readers.whole_texts(spark, str(tmp_path)).count() == 2
    assert [r.line for r in readers.log_lines(spark, str(tmp_path / "a.lean")).collect()] == ["line", "green"]
    (tmp_path / "r.json").write_text('{"completed": {"3": {"status": "ok", "module": "M"}}}')
    assert list(map(tuple, readers.compile_results(spark, str(tmp_path / "r.json")).collect())) == [("3", "ok", "M")]
    (tmp_path / "p.json").write_text('{"t": {"0.5": ["a", "b"]}}')
    assert list(map(tuple, readers.proof_attempts(spark, str(tmp_path / "p.json")).collect())) == [("t", "0.5", 0, "a"), ("t", "0.5", 1, "b")]
    two = spark.createDataFrame([("a", 1), ("b", 2)], "theorem_name string, x int")
    assert readers.for_theorem(two, "b").first().x == 2
