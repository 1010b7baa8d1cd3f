"""Answers, logs, reports, stateful streams and commands."""
import json

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.__main__ import main
from cairn.functions import answers as N
from cairn.operators import reports as R
from cairn.streaming import stateful


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("body,want", [
    ({"parseError": "bad", "nextStateId": 1, "goals": []}, ("failed", None, "bad")), ({"hasSorry": True, "nextStateId": 1, "goals": []}, ("failed", None, "Proof contains sorry")),
    ({"nextStateId": 3, "goals": []}, ("complete", 3, None)), ({"goals": []}, ("complete", -1, None)), ({"nextStateId": 4, "goals": [{"a": 1}]}, ("success", 4, None)),
    ({}, ("failed", None, "Tactic produced no result (no goals, no stateId)")), ({"goals": [{"a": 1}]}, ("failed", None, "Tactic failed (no next state)")),
    ({"nextStateId": 4}, ("failed", None, "Tactic returned stateId but no goals")), ({"error": "e", "desc": "d"}, ("failed", None, "d")),
])
def test_step_result(spark, body, want):
    assert tuple(one(spark, N.step_result, json.dumps(body))) == want


def test_answers(spark):
    body = {"text": "simp", "meta_info": {"output_token_logprobs": [[-0.5, 3, None], [-0.25, 9, None], [None, 1, None]]}}
    assert tuple(one(spark, lambda c: N.generated(c, 3), json.dumps(body))) == ("simp", -0.75, 3, True)
    assert tuple(one(spark, lambda c: N.generated(c, 3), "{}")) == ("", 0.0, 0, False)
    goals = [{"vars": [{"userName": "h", "type": {"pp": "P"}}, {"name": "k"}], "target": {"pp": "Q"}}, {"vars": [], "target": {}}]
    assert one(spark, N.goals_text, json.dumps(goals)) == "h : P\nk : ?\n⊢ Q\n\n⊢ ?"
    assert one(spark, N.with_full_names, "sin x + Real.cos y + exp.z + pi₀ + Coprime a") == "Real.sin x + Real.cos y + exp.z + pi₀ + Nat.Coprime a"
    assert tuple(one(spark, N.skipped_theorem, 'x Search error, skipping theorem="a.b" error=Unknown identifier ')) == ("a.b", "Unknown identifier")
    assert tuple(one(spark, N.compiler_error, "f.lean:12:3: error: no good")) == (12, "no good") and tuple(one(spark, N.compiler_error, "ok")) == (None, None)


def test_reports(spark):
    src = spark.createDataFrame([(1, "ok", "theorem a : P := by\n  simp\n  ring"), (2, "warn", "theorem b : P := by sorry"), (3, "error", "x"), (4, "ok", "theorem c : P := by rfl"), (5, "ok", None)], "seq int, status string, text string")
    r = R.integrity(src).first()
    assert (r.passing, r.clean, r.contaminated, r.trivial, r.gate) == (4, 2, 1, 1, False) and R.contamination_words(src).collect()[0].word == "sorry"
    th = spark.createDataFrame([("f", 1, "a"), ("f", 10, "b"), ("g", 5, "c")], "file string, line int, name string")
    er = spark.createDataFrame([("f", 9, "m"), ("f", 10, "m"), ("f", 12, "n"), ("g", 2, "before all")], "file string, line int, message string")
    assert sorted(map(tuple, R.failing_theorems(er, th).collect())) == [("f", "a", 1), ("f", "b", 2)]
    rates = [x.rate for x in R.learning_rates(spark, 1.0, 2, 4).orderBy("step").collect()]
    assert rates[:3] == [0.5, 1.0, 1.0] and abs(rates[3] - 0.5) < 1e-12
    t = spark.createDataFrame([("a", "s", 1)], "name string, state string, n int")
    assert sorted(map(tuple, R.readiness({"x": t, "y": t.limit(0), "z": t}, {"x": 1, "z": 5}, spark).collect())) == [("x", 1, "PASS"), ("y", 0, "FAIL"), ("z", 1, "WARN")]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "theorem string")
    i = R.impact(names("a", "b", "c", "d"), names("a"), names("b", "z")).first()
    assert (i.pool, i.rate, round(i.adjusted_rate, 3), i.extra, i.upper_rate) == (3, 25.0, 33.333, 0, 25.0)
    i = R.impact(names(*"abcdefgh"), names("a", "b", "c"), names("g", "h")).first()  # 3 of 6, so one of the two
    assert (i.adjusted_rate, i.extra, i.upper_rate) == (50.0, 1, 50.0)
    assert R.error_counts(spark.createDataFrame([("Unknown identifier 'x'",), ("expected token",)], "m string"), "m").count() == 2
    y = spark.createDataFrame([("putnam_1990_a1", True), ("putnam_1990_b2", False), ("x", True)], "theorem_name string, proved boolean")
    assert list(map(tuple, R.year_stats(y).collect())) == [(1990, 2, 1)]


def test_documents_of_runs(spark):
    import json

    one = lambda df: json.loads(df.first().document)
    src = spark.createDataFrame([(1, "ok", "theorem a : P := by\n  simp\n  ring"), (2, "warn", "theorem b : P := by sorry"), (3, "error", "sorry"), (4, "ok", "theorem c : P := by rfl"), (5, "ok", None)], "seq int, status string, text string")
    assert one(R.integrity_document(src)) == {"total_compiled": 5, "total_passing": 4, "total_clean": 2, "total_contaminated": 1, "clean_percentage": 50.0, "contaminated_percentage": 25.0, "contamination_breakdown": {"sorry": 1}, "suspicious_axiom_count": 0, "trivial_proof_count": 1, "files_not_found": 1}
    files = spark.createDataFrame([("b", "error"), ("a", "error"), ("c", "ok"), ("d", "timeout")], "file string, status string")
    assert one(R.compile_document(files)) == {"total_processed": 4, "ok": 1, "warnings": 0, "errors": 2, "timeouts": 1, "pass_rate": "25.0%", "error_files": ["a", "b"], "timeout_files": ["d"]}
    assert one(R.compile_document(files.limit(0)))["pass_rate"] == "N/A"
    found = spark.createDataFrame([("b", "q", "easy"), ("a", "p", "easy"), ("c", "r", "hard"), ("d", "s", "error")], "name string, statement string, split string")
    assert one(R.probe_document(found, 1.5)) == {"stats": {"total": 4, "easy": 2, "hard": 1, "errors": 1, "elapsed_secs": 1.5}, "easy": [{"name": "a", "statement": "p"}, {"name": "b", "statement": "q"}], "hard": [{"name": "c", "statement": "r"}]}


def test_startup_errors(spark):
    lines = ["12:00 Search error, skipping theorem=\"a\" error=Unknown identifier `𝓝` at 3", "Search error, skipping  theorem=\"b\" error=expected token", "Search error, skipping theorem=\"b\" error= Tactic timed out ", "nothing", "Search error, skipping theorem=\"c\" error=Unknown identifier `tetration`", "Search error, skipping theorem=\"d\" error=Unknown identifier", "Search error, skipping theorem=\"e\" error=Symbol not found"]
    log = spark.createDataFrame(list(enumerate(lines)), "at int, line string")
    assert sorted(map(tuple, R.startup_errors(log, "line", "at").collect())) == [
        ("a", "unknown_identifier", "𝓝", "neighbourhood filter", True), ("b", "timeout", None, None, False), ("c", "unknown_identifier", "tetration", "own definition", False),
        ("d", "unknown_identifier", "???", "own definition", True), ("e", "symbol_not_found", None, None, True)]
    o = R.skipped_and_failed(log.selectExpr("'a' AS theorem").distinct(), R.startup_errors(log, "line", "at")).first()
    assert (o.skipped_only, o.failed_only, o.both, o.blocked) == (0, 4, 1, 5)


def test_evaluation_document(spark, tmp_path):
    import json

    from cairn import __main__ as commands
    from cairn.operators import tree
    from cairn.plans import traces

    t = tree.label_paths(traces.raw(spark, "/root/testdata/sf0.001"))
    t.write.parquet(str(tmp_path / "t"))
    assert "solved" in commands.main(["evaluation", "--input", str(tmp_path / "t"), "--output", str(tmp_path / "e")], spark)
    doc = json.loads(spark.read.text(str(tmp_path / "e")).first()[0])
    rows = t.collect()
    names = sorted({r.theorem_name for r in rows})
    deep = {n: min((r.depth_from_root for r in rows if r.theorem_name == n and r.is_proof_complete), default=None) for n in names}
    assert [x["name"] for x in doc["per_theorem"]] == names and doc["solved"] == sum(d is not None for d in deep.values()) == 7
    assert {int(k): n for k, n in doc["depth_distribution"].items()} == {d: list(deep.values()).count(d) for d in set(deep.values()) if d is not None}
    assert all((x["failure_reason"] == "") == x["proved"] and x.get("proof_depth") == deep[x["name"]] for x in doc["per_theorem"])
    times = sorted(max(r.timestamp_ms for r in rows if r.theorem_name == n) / 1000 - min(r.timestamp_ms for r in rows if r.theorem_name == n) / 1000 for n in names)
    assert abs(doc["median_time_secs"] - times[len(times) // 2]) <= 0.06 and doc["total"] == len(names) == 15


def test_report_prints_every_analysis(spark, tmp_path, capsys):
    from cairn import __main__ as commands
    from cairn.operators import tree
    from cairn.plans import traces

    tree.label_paths(traces.raw(spark, "/root/testdata/sf0.001")).write.parquet(str(tmp_path / "t"))
    commands.main(["report", "--input", str(tmp_path / "t")], spark)
    out = capsys.readouterr().out
    assert out.count("## ") == 12 and "exact_search_closes" in out and "median_heads" in out


def test_unchanged_chains(spark):
    rows = [("t", 0, "⊢ a", None), ("t", 1, "h : P\n⊢ a", 0), ("t", 2, "k : Q\n⊢ a", 1), ("t", 3, "⊢ b", 2), ("t", 4, "x : P\n⊢ b", 3)]
    df = spark.createDataFrame(rows, "theorem_name string, state_id long, state_pp string, parent_state_id long")
    assert {r.state_id: r.chain for r in R.unchanged_chains(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}


TREE = "theorem_name string, state_id long, state_pp string, tactic_applied string, parent_state_id long, label string, depth_from_root int, remaining_depth int, llm_log_prob double, ebm_score double, is_proof_complete boolean, timestamp_ms long, q_value double, visits long"


def test_state_over_batches(spark, tmp_path):
    row = lambda s, p, lp, done=False: ("t", s, "", "x", p, "unknown", 0, -1, lp, 0.0, done, 1, 0.0, 0)
    folder, seen = str(tmp_path / "in"), []

    def go(name):
        q = stateful.frontiers(spark.readStream.schema(schemas.TRAJECTORY).parquet(folder)).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    spark.createDataFrame([row(0, None, 0.0), row(1, 0, -2.0), row(2, 0, -1.0)], TREE).coalesce(1).write.mode("append").parquet(folder)
    go("one")
    spark.createDataFrame([row(3, 2, -9.0, True)], TREE).coalesce(1).write.mode("append").parquet(folder)
    go("two")
    assert [(r.rows, r.open, r.proved, r.next_id) for r in seen] == [(3, 2, False, 2), (4, 1, True, 1)]


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "index.json").write_text(json.dumps({"theorems": [{"name": "t", "statement": "a"}, {"name": "u", "statement": "b"}, {"name": "v", "statement": "c"}]}))
    moves = [("t", 0, "intro h", "success", 1, ["⊢ b"]), ("t", 1, "exact h", "complete", 2, None), ("u", 0, "simp", "complete", 1, None)]
    spark.createDataFrame(moves, "theorem_name string, state_id long, tactic string, kind string, next_state_id long, goals array<string>").write.parquet(at("moves"))
    spark.createDataFrame([("t", "", "default", 0, "intro h\nexact h", -1.0)], "theorem_name string, pattern string, match string, ord long, text string, log_prob double").write.parquet(at("policy"))
    world = ["--theorems", at("index.json"), "--transitions", at("moves")]
    run = lambda *a: [json.loads(x) for x in main(["--json", *a], spark).split("\n")]
    assert run("search", *world, "--policy", at("policy"), "--num-theorems", "2", "--output", at("out"))[0]["proved"] == 2
    assert run("search", *world, "--resume-from", at("out"), "--output", at("more"))[0]["theorems"] == 3
    assert run("summary", "--input", at("out"))[0]["theorems"] == 2
    assert run("export-proof-paths", "--trajectories", at("out"), at("out"), "--min-steps", "2", "--output", at("pairs")) == [{"theorems": 1, "steps": 2}]
    assert [(r["split"], r["theorems"]) for r in run("probe", *world, "--output", at("probe"))] == [("easy", 1), ("hard", 2)]
    assert (r := run("eval", *world, "--policies", at("policy"), at("policy"), "--output", at("eval"))[0])["solved"] == 2 and r["total"] == 3
    (tmp_path / "gt.jsonl").write_text("".join(json.dumps({"theorem": "t", "state": s, "tactic": x, "depth": d}) + "\n" for s, x, d in (("⊢ a", "intro h", 0), ("⊢ b", "exact h", 1))))
    assert sum(r["positive"] for r in run("generate-negatives", "--pairs", at("gt.jsonl"), "--transitions", at("moves"), "--output", at("neg"))) == 2
    for name, rate in (("r1", 0.25), ("r2", 0.5)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"solved": 1, "total": 4, "rate": rate}))
    assert run("compare", "--results", at("r1.json"), at("r2.json"))[-1]["delta"] == 0.25


def test_breaker():
    from cairn.operators.remote import Breaker

    now = [0.0]
    b = Breaker(2, 10, lambda: now[0])

    def fail():
        raise OSError("down")

    for _ in range(2):
        with pytest.raises(OSError):
            b.call(fail)
    with pytest.raises(ConnectionError):
        b.call(lambda: 1)
    now[0] = 11.0
    assert b.call(lambda: 1) == 1 and b.failures == 0


def test_remote(spark):
    from cairn.operators import remote

    def connect():
        def ask(state):
            if state == "bad":
                raise ValueError("no")
            return [(f"{state}!", -1.0), (f"{state}?", -2.0)]
        return ask

    states = spark.createDataFrame([("t", "a"), ("u", "bad"), ("v", None)], "theorem_name string, state string")
    got = sorted((r.theorem_name, r.ord, r.text, r.error) for r in remote.generated(states, connect).collect())
    assert got == [("t", 0, "a!", None), ("t", 1, "a?", None), ("u", 0, None, "no")]
    e = remote.encoded(states.select(F.col("state").alias("state_pp")).union(states.select("state")), lambda: lambda xs: [[float(len(x))] for x in xs])
    assert sorted((r.state_pp, r.embedding) for r in e.collect()) == [("a", [1.0]), ("bad", [3.0])]
    assert remote.missing(states.select(F.col("state").alias("state_pp")), e.filter("state_pp = 'a'")).collect()[0].state_pp == "bad"


def test_small_curation(spark, tmp_path):
    from cairn.operators import curate, metrics
    from cairn.sources import readers, writers

    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "k int, d int")
    kept = curate.depth_quotas(rows, "k", "d", [(1, 2), (3, 4)])
    assert sorted((r.d, r.n) for r in kept.groupBy("d").agg(F.count("*").alias("n")).groupBy((F.col("d") >= 3).alias("d")).agg(F.sum("n").alias("n")).collect()) == [(False, 2), (True, 4)]
    refs = spark.createDataFrame([("Nat.add_left_neg", 3), ("add_left_neg", 1), ("xadd_left_neg", 9)], "lemma string, n int")
    assert sorted(r.n for r in curate.renamed_references(refs, spark.createDataFrame([("add_left_neg", "neg_add_cancel")], "old string, new string")).collect()) == [1, 3]
    e = spark.createDataFrame([(1.0, 2), (0.0, 1), (9.0, -1)], "energy double, remaining_depth int")
    assert metrics.depth_loss(e).first().depth_loss == 0.125 and metrics.depth_loss(e.limit(0)).first().depth_loss == 0
    (tmp_path / "b.json").write_text(json.dumps([{"name": "a", "split": "test", "formal_statement": "theorem a (x : N) : x = x := by"}, {"name": "a", "formal_statement": "theorem a : P := by"}, {"name": "b", "formal_statement": "theorem b : Q := by sorry"}, {"name": ""}]))
    assert sorted(map(tuple, readers.benchmark_entries(spark, str(tmp_path / "b.json")).collect())) == [("test", "a", "∀ (x : N), x = x"), ("valid", "b", "Q")]
    th = spark.createDataFrame([(0, "a:", "∀ IsLeast S 1"), (1, "b", " "), (2, "c", "P"), (3, "d", "Q")], "pos int, name string, statement string")
    text = writers.source_file(th, spark.createDataFrame([("d",)], "name string"), "M", ("Nat",)).first().text
    assert "open Real Nat\n" in text and "theorem a : IsLeast S 1 := by sorry\n" in text and text.endswith("theorem c : P := by sorry\n\n-- Skipped 2 theorems:\n--   b: empty statement\n--   d: in skip list\n")
    assert curate.extended_skip_list(spark.createDataFrame([("a",), ("a",)], "name string"), th.select("name")).count() == 5


def test_pace(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("r", 1000), ("r", 3000), ("r", 5000), ("s", 7), ("s", None)], "run string, ts_ms long").coalesce(1).write.parquet(folder)
    q = stateful.pace(spark.readStream.schema("run string, ts_ms long").parquet(folder), 10, 2).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, seen)) == [("r", 3, 20.0), ("s", 1, None)]


def test_more_commands(spark, tmp_path):
    row = lambda s, p, label, done=False: ("t", s, "⊢ a", "x" if s else "", p, label, 0 if p is None else 1, -1, -1.0 * s, 0.0, done, s, 0.0, 0)
    spark.createDataFrame([row(0, None, "positive"), row(1, 0, "positive", True), row(2, 0, "negative")], TREE).write.parquet(str(tmp_path / "t"))
    got = [json.loads(x) for x in main(["--json", "sample", "--trajectories", str(tmp_path / "t"), "--samples", "5", "--negatives", "2", "--output", str(tmp_path / "o")], spark).split("\n")]
    assert sum(r["n"] for r in got) == 15
    assert main(["report", "--input", str(tmp_path / "t")], spark).startswith("|")


def test_more_readers(spark, tmp_path):
    from cairn.sources import readers

    (tmp_path / "x.jsonl").write_text('{"text": "a", "theorem": "t", "source": "s", "depth": 1}\n')
    assert tuple(readers.training_texts(spark, str(tmp_path / "x.jsonl")).first()) == ("a", "t", "s", 1)
    spark.createDataFrame([("u", "f", "n", "1", "2", "s", "t", 9)], "url string, file_path string, full_name string, start string, end string, state_before string, tactic string, more int").write.parquet(str(tmp_path / "p"))
    assert readers.traced_steps(spark, str(tmp_path / "p")).columns == ["url", "file_path", "full_name", "start", "end", "state_before", "tactic"]
