"""Order statistics, scans over one order, first rows and threshold samples, against plain Python; analyses on trees worked out by hand."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import analytics as A
from cairn.operators import curate as C
from cairn.operators import ranks, scans, topk

#: two theorems; goals by the number of turnstiles. a is proved along 0-1-3; 2 and 4 are siblings of path states, 5 hangs below 2
TREE = [
    # theorem, state, parent, tactic, goals, done, positive, log probability, time
    ("a", 0, None, "", 1, False, True, 0.0), ("a", 1, 0, "have h : p", 2, False, True, -1.0), ("a", 2, 0, "simp", 1, False, False, -0.5),
    ("a", 3, 1, "exact? at h", 5, True, True, -2.0), ("a", 4, 1, "have k : q", 2, False, False, -2.0), ("a", 5, 2, "ring", 4, False, False, -0.1),
    ("b", 0, None, "", 1, False, False, 0.0), ("b", 1, 0, "simp", 1, False, False, -0.7), ("b", 2, 0, "simp", 3, False, False, -0.7),
]


@pytest.fixture(scope="module")
def prepared(spark):
    depth = {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 2, ("a", 5): 2, ("b", 0): 0, ("b", 1): 1, ("b", 2): 1}
    rows = [(t, s, "\n\n".join(["x : N\n⊢ p"] * g), tac, up, "positive" if pos else "negative", depth[t, s], -1, lp, 0.0, done, 1000 + s, 0.0, 0) for t, s, up, tac, g, done, pos, lp in TREE]
    return A.prepare(spark.createDataFrame(rows, "theorem_name string, state_id long, state_pp string, tactic_applied string, parent_state_id long, label string, depth_from_root int, remaining_depth int, llm_log_prob double, ebm_score double, is_proof_complete boolean, timestamp_ms long, q_value double, visits long"))


def test_goal_delta_by_hand(prepared):
    # have: 1 - 2 on the path, 2 - 2 off it; exact? closes: 2 - 0; simp: 1 - 1 in a, 1 - 1 and 1 - 3 in b; ring: 1 - 4
    every = {r["head"]: r for r in A.goal_delta(prepared, False, 1).collect()}
    assert {h: (r.n, r.mean_delta) for h, r in every.items()} == {"have": (2, -0.5), "exact?": (1, 2.0), "simp": (3, round(-2 / 3, 6)), "ring": (1, -3.0)}
    assert (every["exact?"].up_pct, every["have"].down_pct, every["have"].same_pct) == (100.0, 50.0, 50.0)
    assert {r["head"]: r.mean_delta for r in A.goal_delta(prepared, True, 1).collect()} == {"have": -1.0, "exact?": 2.0}


def test_proved_theorems_only_by_hand(prepared):
    t = A.training_signal(prepared).first()
    assert (t.positives, t.hard_negatives, t.easy_negatives, t.exact_search, t.exact_search_closes, t.single_proof, t.multi_proof) == (2, 2, 1, 1, 1, 1, 0)
    sizes = [len("x : N\n⊢ p") * 2 + 2 + len("have h : p"), len("x : N\n⊢ p") * 5 + 8 + len("exact? at h")]
    assert t.tokens_p95 == round(float(np.percentile(np.array(sizes) / 3.5, 95)), 6)
    g = A.completion_groups(prepared).first()  # (0, -1), (0, -0.5), (1, -2) twice, (2, -0.1)
    assert (g.groups, g.nodes, g.mean_size, g.max_size) == (4, 5, 1.25, 2)
    assert {r.depth_from_root: (r.pos_n, r.neg_n, r.neg_mean) for r in A.log_prob_by_depth(prepared).collect()} == {1: (1, 1, -0.5), 2: (1, 2, -1.05)}
    h = {r.depth_from_root: (r.path_n, r.path_hypotheses, r.dead_n) for r in A.hypotheses_by_depth(prepared).collect()}
    assert set(h) == {1, 2} and h[2][0] == 1 and h[2][2] == 2
    assert {r.on_path: r.n for r in A.log_prob_distribution(prepared).collect()} == {True: 2, False: 3}
    assert [tuple(r) for r in A.time_to_proof(prepared).select("theorem_name", "position", "n", "ratio").collect()] == [("a", 3, 6, 0.5)]
    assert {(r.proved, r.goal_count): r.n for r in A.root_goals(prepared).collect()} == {(True, 1): 1, (False, 1): 1}
    assert [(r.depth_from_root, r["head"], r.n, r["rank"]) for r in A.top_heads_by_depth(prepared, closing=True).collect()] == [(2, "exact?", 1, 1)]
    first = {r.proved: (r.theorems, r.mean_heads, r.have_median) for r in A.first_step_diversity(prepared).collect()}
    assert first == {True: (1, 2.0, 0.5), False: (1, 1.0, 0.0), None: (2, 1.5, 0.25)}


@pytest.mark.parametrize("cell,marks", [(100_000, 1000), (40, 5)])
def test_ranks(spark, cell, marks):
    rng = random.Random(3)
    data = [(g, rng.choice([None, float(rng.randint(0, 30)), rng.gauss(0, 1e6), rng.random()])) for g in ("one", None, "two") for _ in range(400)] + [("none", None), ("single", 7.0)] + [("ties", 1.0)] * 500
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"med": ("v", ranks.linear(0.5)), "p95": ("v", ranks.linear(0.95)), "at": ("v", ranks.indexed(0.9)), "up": ("v", ranks.upper_median()), "last": ("v", ranks.indexed(1.0))}
    got = {r.g: r for r in ranks.percentiles(df, wanted, "g", cell=cell, marks=marks).collect()}
    assert set(got) == {"one", None, "two", "single", "ties"}
    for g, r in got.items():
        v = sorted(x for k, x in data if k == g and x is not None)
        n = len(v)
        want = [float(np.percentile(v, 50)), float(np.percentile(v, 95)), v[min(math.floor(n * 0.9), n - 1)], v[n // 2], v[-1]]
        assert np.allclose([r.med, r.p95, r["at"], r.up, r["last"]], want, rtol=1e-12, atol=0)
    kept = ranks.beside(df.groupBy("g").agg(F.count("*").alias("n")), ranks.percentiles(df, wanted, "g", cell=cell, marks=marks), "g")
    assert {r.g: r.med is None for r in kept.collect()} == {"one": False, None: False, "two": False, "single": False, "ties": False, "none": True}


@pytest.mark.parametrize("parts", [1, 50])
def test_scans(spark, parts):
    rng = random.Random(8)
    data = [(rng.choice(["x", "x", "x", "y", None]), k, rng.randint(-5, 5), rng.choice([None, None, f"n{k}"])) for k in range(700)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, k int, v int, name string").withColumn("part_of", F.lit(1))
    ordered = sorted(data, key=lambda r: r[1])
    total, last, sums, lasts, before = {}, {}, {}, {}, {}
    for g, k, v, name in ordered:
        sums[k], before[k] = total.get(g, 0), last.get(g)
        total[g] = total.get(g, 0) + v
        last[g] = name or last.get(g)
        lasts[k] = last[g]
    df = df.drop("part_of")
    assert {r.k: r.s for r in scans.running_sum(df, F.col("v"), "s", ["k"], ["g"], parts).collect()} == sums
    assert {r.k: r.s for r in scans.last_value(df, F.col("name"), "s", ["k"], ["g"], parts=parts).collect()} == lasts
    assert {r.k: r.s for r in scans.last_value(df, F.col("name"), "s", ["k"], ["g"], False, parts).collect()} == before
    assert {r.k: r.at for r in scans.numbered(df, "at", ["k"], parts=parts).collect()} == {k: k for k in range(700)}
    moving = scans.moving(df, 7, {"s": lambda w: F.sum("v").over(w)}, ["k"], parts)
    values = [r[2] for r in ordered]
    assert {r.k: r.s for r in moving.collect()} == {k: sum(values[max(0, k - 6) : k + 1]) for k in range(700)}
    assert scans.numbered(df.limit(0), "at", ["k"], parts=parts).count() == 0


def test_moving_windows_take_a_halo_over_blocks(spark):
    df = spark.range(25_000)
    got = scans.moving(df, 3, {"s": lambda w: F.sum("id").over(w)}, ["id"], 9)
    assert got.filter(F.col("s") != F.when(F.col("id") > 1, 3 * F.col("id") - 3).otherwise(F.col("id"))).count() == 0 and got.count() == 25_000


@pytest.mark.parametrize("parts", [1, 50])
def test_packing(spark, parts):
    rng = random.Random(2)
    data = [(k, rng.choice(["p", "p", "q"]), rng.choice([None, [], [rng.randint(0, 99) for _ in range(rng.randint(1, 40))]])) for k in range(300)]
    df = spark.createDataFrame(data, "k int, g string, tokens array<int>")
    for by in ((), ("g",)):
        want = []
        for g in ("p", "q") if by else (None,):
            ids, labels = [], []
            for _, h, t in data:
                if g in (None, h):
                    ids += [*(t or []), 7]
                    labels += [*(t or []), -100]
            want += [(g, r, ids[r * 16 : r * 16 + 16], labels[r * 16 : r * 16 + 16]) for r in range(len(ids) // 16)]
        got = [(r.g if by else None, r.run, r.input_ids, r.labels) for r in scans.packed(df, "tokens", 16, 7, ["k"], by, parts).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_no_single_task_orders_all_rows(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    for made in (scans.numbered(df, "n", ["id"], parts=20), scans.moving(df, 5, {"s": lambda w: F.sum("v").over(w)}, ["id"], 20), scans.packed(df.withColumn("t", F.array("id")), "t", 8, -1, ["id"], parts=20)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition, ENSURE" not in plan.split("Window")[0] and "ExistingRDD" not in plan
        spread = scans.cut_by_range(df, ["id"], [], 20).groupBy("part_").count().agg(F.max("count"), F.count("*")).first()
        assert spread[0] < 200 and spread[1] >= 10


def test_first_rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 10**6)]), k) for k in range(2000)]
    df = spark.createDataFrame(data, "g string, v long, k long").repartition(13)
    got = {}
    for r in topk.first_k(df, ["g"], ["v", "k"], 3).collect():
        got.setdefault(r.g, {})[r.place] = (r.v, r.k)
    for g in ("a", "b", None):
        want = sorted(((v is not None, v or 0), k) for h, v, k in data if h == g)[:3]
        assert [(None if not v[0] else v[1], k) for v, k in want] == [got[g][i] for i in (1, 2, 3)]
    assert "Window" not in topk.first_k(df, ["g"], ["v", "k"], 3)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 37, 999, 5000])
def test_threshold_samples(spark, n, monkeypatch):
    monkeypatch.setattr(C, "_EDGE", 5)
    df = spark.range(1000).withColumnRenamed("id", "key")
    hashed = sorted((hashlib.md5(f"s{k}".encode()).hexdigest(), k) for k in range(1000))
    made = C.hash_sample(df, "key", n, "s")
    assert sorted(r.key for r in made.collect()) == sorted(k for _, k in hashed[:n])
    assert "TakeOrdered" not in made._jdf.queryExecution().executedPlan().toString()
    share = min(n, 1000) / 1000
    assert C.validation_split(df, "key", share, "s").filter("is_val").count() == int(1000 * share + 0.5)
    per = C.hash_sample(df.withColumn("g", F.when(F.col("key") % 3 > 0, F.col("key") % 3)), "key", n, "s", "g")
    want = sorted(k for g in range(3) for _, k in [x for x in hashed if x[1] % 3 == g][:n])
    assert sorted(r.key for r in per.collect()) == want
