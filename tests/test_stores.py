"""Keyed streaming state, bucketed stores, data sources and table functions, profiles and statistics of pairs."""
import json
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import metrics as M
from cairn.operators import profile, table_functions, tree
from cairn.plans import traces
from cairn.sources import documents, store
from cairn.streaming import summaries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def state_store(spark):
    before = spark.conf.get(summaries.PROVIDER[0])
    spark.conf.set(*summaries.PROVIDER)
    yield
    spark.conf.set(summaries.PROVIDER[0], before)


def test_changes_add_up_over_restarts(spark, tmp_path, state_store):
    into, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rng, data = random.Random(1), []
    for k in range(3):
        part = [(rng.choice([None, *(f"t{i}" for i in range(40))]), rng.choice(["positive", "negative", "negative", "odd", None]), rng.random() < 0.1) for _ in range(200)]
        data += part
        spark.createDataFrame(part, "theorem_name string, label string, is_proof_complete boolean").coalesce(1).write.mode("append").parquet(into)
        # each round starts anew from the checkpoint
        stream = spark.readStream.schema("theorem_name string, label string, is_proof_complete boolean").parquet(into)
        made = summaries.changes(stream).writeStream.outputMode("update").option("checkpointLocation", mark)
        query = made.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    made = spark.read.parquet(out)
    count = Counter(label if label in ("positive", "negative") else "unknown" for _, label, _ in data)
    t = summaries.totals(made).first()
    assert (t.n_rows, t.positive, t.negative, t.theorems, t.proved) == (600, count["positive"], count["negative"], len({n for n, _, _ in data}), len({n for n, _, done in data if done}))
    names = defaultdict(set)
    for n, label, _ in data:
        names[label if label in ("positive", "negative") else "unknown"].add(n)
    assert {r.label: (r.n, r.theorems) for r in summaries.label_totals(made).collect()} == {k: (count[k], len(v)) for k, v in names.items()}
    last = {r.theorem_name: r.total_rows for r in made.groupBy("theorem_name").agg(F.max("total_rows").alias("total_rows")).collect()}
    assert last == Counter(n for n, _, _ in data)
    plan = made._jdf.queryExecution().toString()
    assert "collect_set" not in plan


def test_a_theorem_that_rested_too_long_is_new(spark, tmp_path, state_store):
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "theorem_name string, label string, is_proof_complete boolean"
    write = lambda: spark.createDataFrame([("t", "positive", True)], schema).write.mode("append").parquet(into)
    seen = lambda: [(r.new_theorem, r.completed, r.total_rows) for r in spark.read.schema(summaries.CHANGES + ", batch long").parquet(out).orderBy("batch").collect()] if os.path.isdir(out) else []

    def wait(n):
        for _ in range(100):
            if len(seen()) >= n:
                return
            time.sleep(0.5)

    write()
    made = summaries.changes(spark.readStream.schema(schema).parquet(into), 1_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark"))
    query = made.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(processingTime="500 milliseconds").start()
    try:
        wait(1)
        time.sleep(4)
        write()
        wait(2)
    finally:
        query.stop()
    assert seen() == [(1, 1, 1), (1, 1, 1)]


def test_store_resumes_without_shuffling_what_it_holds(spark):
    rows = tree.label_paths(traces.raw(spark, SF))
    name = "held_results"
    store.create(spark, name, rows, 8)
    store.create(spark, name, rows, 8)
    own = lambda k: rows.filter(f"pmod(crc32(theorem_name), 4) = {k}")
    store.add(own(0), name, 0)
    store.add(own(0).union(own(1)), name, 1)
    store.add(own(2), name, 1)  # a batch that is tried again changes nothing
    # an attempt that was written but not logged doesn't count
    own(2).withColumn("attempt", F.lit("2-lost")).select(*spark.table(name).columns).write.insertInto(name)
    spark.catalog.refreshTable(name)
    assert sorted(map(str, store.rows(spark, name).select(*rows.columns).collect())) == sorted(map(str, own(0).union(own(1)).collect()))
    left = store.unfinished(rows.select("theorem_name").distinct(), name)
    assert {r.theorem_name for r in left.collect()} == {r.theorem_name for r in own(2).union(own(3)).collect()}
    assert store.unfinished(spark.createDataFrame([(None,)], "theorem_name string"), name).count() == 1
    plan = store.unfinished(spark.createDataFrame([("x",)], "theorem_name string"), name)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # that of the names
    assert {r.batch: r.theorems for r in store.finished(spark, name).collect()}.keys() == {0, 1}


def test_store_collects_a_stream(spark, tmp_path):
    df = tree.label_paths(traces.raw(spark, SF))
    into, name = str(tmp_path / "in"), "collected"
    for part in (df.filter("theorem_name < 'thm_2'"), df):
        part.coalesce(1).write.mode("append").parquet(into)
        store.collect(spark.readStream.schema(df.schema).parquet(into), name, str(tmp_path / "mark"), 4).awaitTermination()
    assert store.rows(spark, name).count() == df.count()


ODD = ["x", 'a"b', "\\", '"7": {', '{"seq": 3', "é" * 50, "\n", "", '\\"9": {"status": "pass"}', "m" * 9000, "} ]"]


@pytest.mark.parametrize("size", [16_000_000, 5_003, 100_000])
@pytest.mark.parametrize("indent", [None, 1])
def test_documents_are_read_in_ranges(spark, tmp_path, size, indent):
    documents.register(spark)
    rng = random.Random(size)
    results = {str(i): {"status": rng.choice(["pass", "fail", None]), "module": rng.choice(ODD)} for i in range(400)}
    manifest = [{"seq": i, "problem_id": rng.choice(ODD), "filename": f"f{i}"} for i in range(400)]
    (tmp_path / "r.json").write_text(json.dumps({"completed": results}, ensure_ascii=False, indent=indent))
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=indent))
    read = lambda kind, f: spark.read.format(kind).option("bytes", size).load(str(tmp_path / f))
    got = read("result_map", "r.json").collect()
    assert len(got) == 400 and {r.seq: (r.status, r.module) for r in got} == {k: (v["status"], v["module"]) for k, v in results.items()}
    assert sorted(map(tuple, read("manifest", "m.json").collect())) == sorted((m["seq"], m["problem_id"], m["filename"]) for m in manifest)
    some = read("result_map", "r.json").filter("status = 'pass' AND module LIKE '%m%' AND seq IN ('1', '2', '50', '399')")
    assert {r.seq for r in some.collect()} == {k for k in ("1", "2", "50", "399") if results[k]["status"] == "pass" and "m" in results[k]["module"]}
    assert "Filter" not in read("result_map", "r.json").filter("status = 'pass'")._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert (read("result_map", "r.json").rdd.getNumPartitions() > 5) == (size == 5_003)


@pytest.mark.parametrize("size", [16_000_000, 1_000, 7_777])
@pytest.mark.parametrize("end", ["", "\n"])
def test_logs_are_read_in_ranges(spark, tmp_path, size, end):
    documents.register(spark)
    lines = [f"line {i} \x1b[31mred\x1b[0m é" if i % 3 else "" for i in range(900)] + ["last"]
    (tmp_path / "a.log").write_text("\n".join(lines) + end)
    (tmp_path / "_hidden.log").write_text("no")
    got = spark.read.format("run_log").option("bytes", size).load(f"{tmp_path}/*.log").orderBy("at").collect()
    assert [r.line for r in got] == [x.replace("\x1b[31m", "").replace("\x1b[0m", "") for x in lines]
    found = spark.read.format("run_log").option("bytes", size).load(f"{tmp_path}/a.log").filter(F.col("line").contains("line 7 "))
    assert [r.line for r in found.collect()] == ["line 7 red é"]


def test_other_documents(spark, tmp_path):
    documents.register(spark)
    (tmp_path / "p.json").write_text(json.dumps({"t1": {"0.7": ["a", "b"], "1.0": ["c"]}, "t2": {"0.7": []}, "t3": {}}, indent=2))
    assert list(map(tuple, spark.read.format("proof_attempts").load(str(tmp_path / "p.json")).collect())) == [("t1", "0.7", 0, "a"), ("t1", "0.7", 1, "b"), ("t1", "1.0", 0, "c")]
    (tmp_path / "cut.json").write_text('{"completed": {"1": {"status": "pa')
    with pytest.raises(Exception, match="no end"):
        spark.read.format("result_map").load(str(tmp_path / "cut.json")).collect()
    (tmp_path / "empty.json").write_text('{"completed": {}}')
    assert spark.read.format("result_map").load(str(tmp_path / "empty.json")).count() == 0


def test_table_functions_are_the_walks(spark):
    table_functions.register(spark)
    raw = traces.raw(spark, SF).withColumn("more", F.lit("x"))
    raw.createOrReplaceTempView("walked")
    ask = lambda f: spark.sql(f"SELECT * FROM {f}(TABLE(walked) PARTITION BY theorem_name ORDER BY state_id)")
    for f, want in (("label_paths", tree.label_paths(raw)), ("backed_up", tree.backed_up(raw)), ("have_runs", tree.have_chains(raw))):
        columns = sorted(want.columns)
        assert sorted(map(str, ask(f).select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
        assert "more" in ask(f).columns
    # further SQL around it
    assert spark.sql("SELECT count(*) AS n FROM label_paths(TABLE(SELECT * FROM walked WHERE state_id < 5) PARTITION BY theorem_name) WHERE label = 'negative' OR label = 'positive'").first().n == raw.filter("state_id < 5").count()
    with pytest.raises(Exception, match="PARTITION BY theorem_name"):
        spark.sql("SELECT * FROM label_paths(TABLE(walked) WITH SINGLE PARTITION)").collect()
    with pytest.raises(Exception, match="no column visits"):
        spark.sql("SELECT * FROM backed_up(TABLE(SELECT theorem_name, state_id, parent_state_id, is_proof_complete FROM walked) PARTITION BY theorem_name)").collect()


def test_apportionment():
    def plain(n, weights, available):
        """Seat by seat: in each round the exact shares, rounded down, then one more for the largest remainders."""
        out, total = [0] * len(weights), min(n, sum(available))
        w = list(weights)
        while sum(out) < total:
            able = [i for i in range(len(w)) if out[i] < available[i]]
            if all(w[i] == 0 for i in able):
                w = [1] * len(w)
            left, s = total - sum(out), sum(w[i] for i in able)
            give = {i: left * w[i] // s for i in able}
            rest = left - sum(give.values())
            for i in sorted(able, key=lambda i: (-(left * w[i] % s), i))[:rest]:
                give[i] += 1
            for i in able:
                out[i] = min(available[i], out[i] + give[i])
        return out

    rng = random.Random(6)
    for _ in range(400):
        k = rng.randint(1, 6)
        weights, available, n = [rng.randint(0, 9) for _ in range(k)], [rng.randint(0, 40) for _ in range(k)], rng.randint(0, 120)
        got = profile.apportioned(n, weights, available)
        assert got == plain(n, weights, available) and sum(got) == min(n, sum(available))
    assert profile.apportioned(10, [2.0, 1.0], [100, 100]) == [7, 3] and profile.apportioned(10, [1.0, 1.0, 2.0], [1, 100, 100]) == [1, 3, 6]
    assert profile.apportioned(0, [], []) == []


def test_stratified_theorems(spark):
    rows = [(f"a{i}", "⊢ p", f"h{i % (d + 1)} x", d) for i in range(60) for d in range(i % 5 + 1)]
    pairs = spark.createDataFrame(rows, "theorem string, state string, tactic string, depth int")
    for n in (0, 1, 17, 59, 60, 100):
        assert profile.stratified_theorems(pairs, n).count() == min(n, 60)
    assert profile.stratified_theorems(pairs.limit(0), 5).count() == 0


def similarities(rows):
    out = defaultdict(list)
    unit = lambda e: np.zeros(len(e)) if np.linalg.norm(e) < 1e-10 else np.array(e, float) / np.linalg.norm(e)
    for i, (g, k, p, e) in enumerate(rows):
        for h, m, q, f in rows[i + 1 :]:
            if g == h and g is not None:
                out["positive" if p and q else "mixed" if p or q else "negative"].append(float(unit(e) @ unit(f)))
    return out


def test_pair_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [("g%d" % (i % 3) if i % 17 else "one", i, bool(rng.random() < 0.4), [0.0] * 5 if i % 11 == 0 else rng.standard_normal(5).tolist()) for i in range(120)]
    df = spark.createDataFrame([(g, k, p, e) for g, k, p, e in rows], "g string, k int, p boolean, embedding array<double>").repartition(7)
    want = similarities(rows)
    for r in M.pair_moments(df, "g", "p").collect():
        c = np.array(want[r.kind])
        assert r.n == len(c) and abs(r["mean"] - c.mean()) < 2e-6 and abs(r["std"] - c.std()) < 2e-6
    for r in M.pair_similarities(df, "g", "k", "p").collect():
        c = sorted(want[r.kind])
        n = len(c)
        assert r.n == n and np.allclose([r["mean"], r["std"], r.least, r.p10, r.p50, r.p90, r.most], [np.mean(c), np.std(c), c[0], c[n // 10], c[n // 2], c[9 * n // 10], c[-1]], atol=2e-6)
    plan = M.pair_moments(df, "g", "p")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert M.pair_moments(df.limit(0), "g", "p").count() == 0


def test_drawn_pairs(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], i % 2 == 0, float(i // 2)) for i in range(50)], "k int, embedding array<double>, p boolean, s double")
    once, again = M.drawn_similarities(df, "k", 300).first(), M.drawn_similarities(df.repartition(9), "k", 300).first()
    assert once == again and 250 < once.n <= 300 and -1 <= once.least <= once.p10 <= once.p50 <= once.p90 <= once.most <= 1.000001
    assert M.drawn_similarities(df.limit(1), "k").first() is None or M.drawn_similarities(df.limit(1), "k").first().n == 0
    a = M.sampled_accuracy(df, "s", "p", 400).first()
    assert a.pairs == 400 and abs(a.accuracy - 0.48) < 0.1 and abs(a.gap) < 1e-9
