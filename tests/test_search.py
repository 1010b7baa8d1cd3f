"""Searches over small tables."""
from cairn.operators import search as S
from cairn.operators import tree

MOVES = "theorem_name string, state_id long, tactic string, kind string, next_state_id long, goals array<string>"
SAYS = "theorem_name string, pattern string, match string, ord long, text string, log_prob double"


def run(spark, moves, says, names=("t",), **settings):
    theorems = spark.createDataFrame([(n, "a = a") for n in names], "theorem_name string, statement string")
    found = S.best_first(theorems, spark.createDataFrame(moves, MOVES), spark.createDataFrame(says, SAYS), S.Settings(**({"probes": ()} | settings)), now_ms=7)
    return {r.theorem_name: r for r in S.results(found).collect()}, sorted(S.trajectories(found).collect(), key=lambda r: (r.theorem_name, r.state_id)), found


def test_proof_in_two_steps(spark):
    moves = [("t", 0, "intro  h", "success", 1, ["h : P\n⊢ b"]), ("t", 1, "exact h", "complete", 2, None)]
    says = [("t", "⊢ a = a", "exact", 0, "nonsense", -1.0), ("t", "⊢ a = a", "exact", 1, "intro  h\nexact h", -0.5)]
    result, rows, found = run(spark, moves, says, names=("t", "u"))
    assert (result["t"].proved, result["t"].tactics, result["t"].rounds, result["t"].states) == (True, ["intro  h", "exact h"], 1, 3)
    assert (result["u"].proved, result["u"].reason, result["u"].states) == (False, "frontier_exhausted", 1)
    assert [(r.state_id, r.parent_state_id, r.depth_from_root, r.is_proof_complete, r.visits, r.q_value) for r in rows if r.theorem_name == "t"] == [(0, None, 0, False, 2, 0.5), (1, 0, 1, False, 1, 1.0), (2, 1, 2, True, 0, 0.0)]
    labels = {(r.theorem_name, r.state_id): r.remaining_depth for r in tree.label_paths(S.trajectories(found)).collect()}
    assert labels == {("t", 0): 2, ("t", 1): 1, ("t", 2): 0, ("u", 0): -1}


def test_probes_and_frontier(spark):
    moves = [("t", 0, "constructor", "success", 1, ["⊢ x", "⊢ y"]), ("t", 0, "left", "success", 2, ["⊢ z"]), ("t", 2, "omega", "complete", 3, None)]
    result, rows, _ = run(spark, moves, [("t", "", "default", 0, "skip", -1.0)], probes=("omega", "constructor", "left"))
    assert result["t"].tactics == ["left", "omega"] and result["t"].rounds == 2  # one goal comes before two
    assert [r.tactic_applied for r in rows] == ["", "constructor", "left", "omega"] and rows[1].llm_log_prob == -10


def test_pruning_loops_and_ends(spark):
    back = [("t", 0, "a", "success", 0, ["⊢ a = a"])]
    result, _, _ = run(spark, back, [("t", "", "default", 0, "a", -1.0)])
    assert result["t"].stats["loops"] == 1 and result["t"].reason == "frontier_exhausted"
    line = [("t", k, "s", "success", k + 1, [f"h{k} : P\n⊢ a = a"]) for k in range(9)]
    result, rows, _ = run(spark, line, [("t", "", "default", 0, "s\ns\ns\ns\ns", -1.0)], max_rounds=1)
    assert (result["t"].reason, len(rows), result["t"].stats["unchanged_pruned"]) == ("max_rounds", 4, 1)
    grow = [("t", 0, "have x := 1", "success", 1, ["⊢ p", "⊢ q"])]
    result, _, _ = run(spark, grow, [("t", "", "default", 0, "have x := 1\nsimp", -1.0)], max_rounds=1)
    assert result["t"].stats["have_goals_pruned"] == 1
    result, rows, _ = run(spark, line, [("t", "", "default", 0, "s\nsorry", -1.0)], budget=1)
    assert (result["t"].reason, len(rows)) == ("budget_exhausted", 1)
    result, rows, _ = run(spark, line, [("t", "", "default", 0, "s\ns", -1.0)], max_depth=1)
    assert result["t"].stats["depth_capped"] == 1 and len(rows) == 1


def test_ramps():
    s = S.Settings(max_temperature=1.2)
    assert [s.tokens_at(d) for d in (0, 4, 8, 99)] == [1024, 640, 256, 256] and [s.proofs_at(d) for d in (0, 4, 8)] == [32, 18, 4]
    assert abs(s.temperature_at(4) - 1.0) < 1e-12 and s.temperature_at(20) == 1.2
    assert S.Settings(score_ramp_depth=4).beta_at(2) == 0.25 and S.Settings(score_min_depth=3).beta_at(2) == 0
    assert S.settings({"probes": ["x"], "budget": 3}).budget == 3


def test_scorer_orders(spark):
    moves = [("t", 0, "a", "success", 1, ["⊢ bad"]), ("t", 0, "b", "success", 2, ["⊢ good"]), ("t", 2, "c", "complete", 3, None)]
    world = S.Tables(spark.createDataFrame(moves, MOVES).toPandas(), spark.createDataFrame([("t", "⊢ r", "exact", 0, "a", 0.0), ("t", "⊢ r", "exact", 1, "b", 0.0), ("t", "good", "contains", 2, "c", 0.0)], SAYS).toPandas())
    s = S.Search("r", world, S.Settings(probes=()), lambda states: [5.0 if "good" in x else 0.0 for x in states])
    assert s.run()["tactics"] == ["b", "c"] and s.nodes[2].score == 5.0


def test_along_proofs(spark):
    moves = [("t", 0, "good", "success", 1, ["⊢ two"]), ("t", 1, "end", "complete", 2, None), ("t", 0, "bad", "success", 5, ["⊢ off"]), ("t", 5, "worse", "success", 6, ["⊢ far"]),
             ("t", 0, "ring", "success", 7, ["⊢ r"]), ("t", 1, "simp", "complete", 8, None), ("t", 1, "alt", "success", 9, ["⊢ alt"]), ("t", 9, "done", "complete", 10, None)]
    says = [("t", "⊢ one", "exact", 0, "good", -0.1), ("t", "⊢ one", "exact", 1, "bad\nworse\nnever", -0.2), ("t", "⊢ two", "exact", 2, "alt\ndone", -0.3)]
    pairs = spark.createDataFrame([("t", "⊢ one", "good", 0), ("t", "⊢ two", "end", 1)], "theorem_name string, state string, tactic string, depth int")
    found = S.along_proofs(pairs, spark.createDataFrame(moves, MOVES), spark.createDataFrame(says, SAYS))
    got = [(r.tactic_applied, r.label, r.depth_from_root, r.remaining_depth, r.is_proof_complete) for r in found.collect()]
    assert got == [("good", "positive", 0, 2, False), ("end", "positive", 1, 1, False), ("bad", "negative", 1, -1, False), ("worse", "negative", 2, -1, False),
                   ("ring", "negative", 1, -1, False), ("alt", "positive", 2, -1, False), ("simp", "positive", 1, 1, True)]
    r = S.results(found, S.WALKED).first()
    assert (r.completed, r.steps_walked, r.positives, r.negatives, r.alternative_proofs) == (True, 2, 4, 3, 2)
    lost = S.along_proofs(pairs, spark.createDataFrame([("t", 0, "simp", "success", 3, ["⊢ s"]), ("t", 3, "ring", "success", 4, ["⊢ q"])], MOVES), spark.createDataFrame([], SAYS))
    assert [(r.tactic_applied, r.label) for r in lost.collect()] == [("good", "positive"), ("end", "positive"), ("simp", "negative"), ("ring", "positive")]
