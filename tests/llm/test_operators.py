"""The corpus operators against brute force, exact round trips and held-out accuracy, and their edge cases."""
import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: what every operator must bear: nulls, empty, blank, repeated and long texts, clashing names
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 3), (4, "same words here again", "en", "b", 1), (5, "same words here again", "en", "b", 1),
    (5, "same words here again", "en", "b", 1), (None, "no id at all", "de", "b", 1), (7, "word " * 30_000, "en", "a", 1), (8, "Über straße œuvre 中文 ١٢٣ ½ <|endoftext|> x", "de", "c", 1), (9, "1234 5678", "fr", "c", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], DOCS + ", row string, fp long")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def held(i, m, r):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m == r


# 1 mixing

def brute_slots(weights, counts):
    """Slot by slot: of the blocks released, the one due first."""
    shares = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    done, out, t = [0] * len(counts), [], 0
    while any(d < c for d, c in zip(done, counts)):
        able = [(math.ceil((done[s] + 1) / x), s) for s, x in enumerate(shares) if done[s] < counts[s] and math.floor(done[s] / x) <= t]
        if able:
            due, s = min(able)
            assert due > t
            out.append((t, s, done[s]))
            done[s] += 1
        t += 1
    return out


def test_schedule_is_the_brute_force_one():
    from cairn.llm.mixing import _slots, whole

    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 12)
        weights, counts = [rng.random() ** 3 + 1e-2 for _ in range(n)], [rng.randint(0, 40) for _ in range(n)]
        assert list(_slots(whole(weights), counts)) == brute_slots(weights, counts)
    shares = [w / sum(weights) for w in weights]
    seen = Counter()
    for t, s, _ in _slots(whole(weights), [10_000] * n):
        seen[s] += 1
        if t < 2000:
            assert all(abs(seen[j] - (t + 1) * w) < 1 for j, w in enumerate(shares))


def test_mix_numbers_hot_sources_in_two_levels(spark):
    from cairn.llm import mixing

    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) as source")
    want = {r.doc_id: (r.source, r.slot, r.position) for r in mixing.mix(df, block_rows=4, bucket_rows=2).select("row.doc_id", "source", "slot", "position").collect()}
    assert sorted(v[2] for v in want.values()) == list(range(3000))
    span, mixing._SPAN = mixing._SPAN, 3
    try:
        assert {r.doc_id: (r.source, r.slot, r.position) for r in mixing.mix(df, block_rows=4, bucket_rows=2).select("row.doc_id", "source", "slot", "position").collect()} == want
    finally:
        mixing._SPAN = span
    few = mixing.mix(df, block_rows=4, max_blocks=50).collect()  # blocks grow: a bounded plan
    assert sorted(r.position for r in few) == list(range(3000)) and len({(r.source, r.block) for r in few}) <= 50 + 8


def test_mix_places_every_row_once(spark, docs, odd, none, tmp_path):
    from cairn.llm.mixing import mix, mixed

    rows = mix(docs, block_rows=4, bucket_rows=5).select("row.doc_id", "source", "slot", "position", "within_target").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(docs.count())) and len({r.doc_id for r in rows}) == docs.count()
    assert all(a.slot <= b.slot for a, b in zip(rows, rows[1:]))
    n = Counter(r.source for r in rows)
    total, seen = sum(v**0.7 for v in n.values()), Counter()
    for t, r in enumerate((r for r in rows if r.within_target), 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * v**0.7 / total) < 4 * 1.1 for s, v in n.items())
    assert mix(odd).count() == len(ODD) and mix(none).count() == 0
    with pytest.raises(ValueError):
        mix(docs, weights={"src0": 1.0})
    mixed(docs, block_rows=4).write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()
    assert [r.doc_id for r in back] == [r.row.doc_id for r in mix(docs, block_rows=4).orderBy("position").collect()]


def test_long_schedules_keep_the_exact_weights():
    from cairn.llm.mixing import _plan

    sizes = [1_000_000] + [2_000_000 // 19] * 19  # a third of the rows in one source
    weights = [n**0.7 for n in sizes]
    table, horizon = _plan(sizes, weights, 64)
    sid, slot, w = table["sid"].to_numpy(), table["slot"].to_numpy(), np.array(weights) / sum(weights)
    seen = np.cumsum(sid[slot < horizon][:, None] == np.arange(20), 0)
    assert len(seen) > 3 * 4096 and (slot[: len(seen)] == np.arange(len(seen))).all()
    assert (abs(seen - np.arange(1, len(seen) + 1)[:, None] * w) < 1).all()
    assert table.num_rows == sum(-(-n // 64) for n in sizes) and (np.diff(slot) > 0).all()


def test_mix_takes_any_number_of_sources(spark):
    from cairn.llm.mixing import mix

    df = spark.range(6000).selectExpr("id as doc_id", "cast(id % 5000 as string) as source")
    assert sorted(r.position for r in mix(df).collect()) == list(range(6000))


# 2 neighbours

def brute_neighbours(rows, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = [(j, s) for j, s in sorted(((j, float((q * x).sum())) for j, x in good if j != i), key=lambda r: (-r[1], r[0]))[:k]]
    return out


def test_neighbours(spark):
    from cairn.llm.ann import neighbours

    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * (1 + i % 3)]) for i in range(900)]
    same = [float(np.float32(x)) for x in rng.standard_normal(8)]
    rows += [(1000 + i, same) for i in range(400)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours(df, cell_rows=100, block_rows=120, query_rows=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert set(got) == set(want)
    found = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    for q, w in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(w) + 1))
        assert all(abs(s - float((np.array(dict(rows)[q]) * np.array(dict(rows)[v])).sum())) < 1e-12 for _, v, s in got[q])
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
    hot = [v for _, v, _ in got[1000]]
    assert hot == [v for v, _ in want[1000]]  # 399 ties: the smallest ids
    assert neighbours(df.filter("vec_id < 5")).count() == 4 and neighbours(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    from cairn.llm.ann import neighbours

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    assert x.shape[1] == 64
    got = defaultdict(set)
    for r in neighbours(df.selectExpr("vec_id", "embedding", "1 as e", "2 as cell", "3 as query_id", "4 as s")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


# 3 near-duplicates

def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, docs, odd, none):
    from cairn.llm.simhash import fingerprint, keep_first, simhash_groups

    base = [(r.doc_id, r.text) for r in docs.collect()]
    more = [(10_000 + i, t.replace(" ", "  ", 1)) for i, t in base[:30]] + [(20_000 + i, f"{t} extra{i}") for i, t in base[:60]] + [(30_000 + k, base[0][1] + f" tail{k}") for k in range(40)]
    rows = base + more
    assert all(fingerprint((t or "").encode()) == brute_fingerprint(t) for _, t in rows[:150])
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], DOCS)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_groups(df).collect()}
    assert got == {d: (fps[i], low[find(i)]) for i, (d, _) in enumerate(rows)}
    assert {r.doc_id for r in keep_first(df).collect()} == set(low.values())
    out = [(r.doc_id, r.component_id) for r in simhash_groups(odd).collect()]
    assert len(out) == len(ODD) and {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)} <= set(out)
    assert keep_first(odd).columns == odd.columns and sorted(r.doc_id or 0 for r in keep_first(odd).collect()) == [0, 1, 4, 7, 8, 9]
    assert simhash_groups(none).count() == 0 and keep_first(none).count() == 0


def test_keep_first_drops_rows_of_their_own_group_only(spark):
    from cairn.llm.simhash import keep_first
    from cairn.llm.similar import similar_groups, similar_rows

    rows = [(1, "alpha beta gamma delta", "x"), (1, "totally different words in here", "x"), (2, "alpha beta gamma delta", "y"), (2, "another quite separate text", "z"), (2, "another quite separate text", "z"), (2, "Another quite separate text", "z"), (None, "alpha beta gamma delta", "n"), (None, "one more text without any id", "n"), (None, "words that no other text here has", "n"), (3, None, "m"), (4, "", "m"), (None, " ", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    texts = ["alpha beta gamma delta", "another quite separate text", "one more text without any id", "totally different words in here", "words that no other text here has"]
    for kept in (keep_first(df), keep_first(df, similar_groups(df), similar_rows)):
        got = kept.collect()
        assert kept.columns == df.columns
        assert sorted((r.text or "").lower() for r in got) == ["", *texts]
        assert {(r.doc_id, r.text) for r in got if r.text and r.text[0] in "at" and r.text[1] != "n"} == {(1, rows[0][1]), (1, rows[1][1])}
        assert {r.doc_id for r in got if not r.text} == {3}


def test_links_find_all_pairs(spark):
    from cairn.llm.simhash import links

    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(20)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {frozenset((r.a, r.b)) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_similar_groups_link_every_pair(spark, odd, none):
    from cairn.llm.similar import similar_groups
    from cairn.llm.simhash import keep_first

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    more = [(10_000, " ".join(base))]
    for k in range(1, 60):  # one hot group whose copies differ from each other more than from the first
        own = list(base)
        own[rng.randrange(5, 55)] = f"x{k}"
        more.append((10_000 + k, " ".join(own)))
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in more], DOCS))
    rows = [(r.doc_id, r.text) for r in df.collect()]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    root, holders, common = list(range(len(rows))), defaultdict(list), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            common.update((j, i) for j in holders[x])
            holders[x].append(i)
    changed = 0
    for (i, j), n in common.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            changed += sets[i] != sets[j]
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    assert changed > 60
    for sample in (10, 2000):
        assert {r.doc_id: r.component_id for r in similar_groups(df, sample=sample).collect()} == {d: low[find(i)] for i, (d, _) in enumerate(rows)}
    assert {r.doc_id for r in keep_first(df, similar_groups(df)).collect()} == set(low.values())
    out = [(r.doc_id, r.component_id) for r in similar_groups(odd).collect()]
    assert len(out) == len(ODD) and {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)} <= set(out)
    assert similar_groups(none).count() == 0


def test_simhash_makes_the_links_of_near_copies(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from cairn.llm import similar
    from cairn.llm.simhash import fingerprint, shingle_hashes, wide_fingerprint

    rng = random.Random(8)
    texts = {}
    for i in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts[i] = " ".join(words)
        words[rng.randrange(10, 90)] = "other"
        texts[1000 + i] = " ".join(words)  # similarity 0.9
    prints = {i: wide_fingerprint(shingle_hashes(t.encode(), 5), similar.WORDS) for i, t in texts.items()}
    assert all(int(p[0]) == fingerprint(texts[i].encode(), 5) for i, p in prints.items())
    df = spark.createDataFrame([(i, 96, p.view(np.int64).tolist()) for i, p in prints.items()], "fp long, n int, print array<long>")
    pairs = {(r.a, r.b) for r in similar.simhash_pairs(df, 0.8).collect()}
    assert len(pairs & {(i, 1000 + i) for i in range(100)}) >= 95

    asked, plans = [], []
    real, write = similar.simhash_pairs, similar.materialise
    monkeypatch.setattr(similar, "simhash_pairs", lambda *a: asked.append(a) or real(*a))
    monkeypatch.setattr(similar, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or write(df, name))
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF)
    assert {r.doc_id for r in kept.collect()} == set(range(100)) and asked
    whole = [p for name, p in plans if name == "similar"]
    assert whole and not any("MapInArrow" in p for p in whole)  # pairs of whole sets would be large batches in Python


def test_simhash_pairs_keep_a_row_for_each_set_and_segment(spark):
    from cairn.llm import similar
    from cairn.llm.simhash import wide_fingerprint

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    sets = [[*base[:i], rng.getrandbits(64), *base[i + 1 :]] for i in range(60)]  # one group of near copies
    df = spark.createDataFrame([(i, 60, wide_fingerprint(np.array(x, np.uint64), similar.WORDS).view(np.int64).tolist()) for i, x in enumerate(sets)], "fp long, n int, print array<long>")
    found = similar.simhash_pairs(df, 0.8)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # that of the segments
    pairs = {(r.a, r.b) for r in found.collect()}
    assert {x for p in pairs for x in p} == set(range(60)) and len(pairs) <= 60 and all(a < b for a, b in pairs)


def test_few_pairs_left_end_the_rounds_at_once(spark, monkeypatch):
    from cairn.llm import similar

    rng = random.Random(10)
    texts = {}
    for i in range(260):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts[i] = " ".join(words)
        if i < 30:
            texts[1000 + i] = " ".join([*words[:-1], "other"])
    real = similar.simhash_pairs
    monkeypatch.setattr(similar, "simhash_pairs", lambda *a: real(*a).filter("false"))  # so the exact search has all to find
    monkeypatch.setattr(similar, "_more_hubs", lambda *a: pytest.fail("a round of hubs for 30 pairs"))
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i in texts}


def test_hubs_come_before_all_pairs_of_near_copies(spark, monkeypatch):
    from cairn.llm import similar

    rng = random.Random(11)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(201)]
    texts = {i: " ".join(w) for i, w in enumerate(words)}
    for k in range(24):
        texts[1000 + k] = " ".join([*words[0][:-1], f"other{k}"])
    names, real, write = [], similar.simhash_pairs, similar.materialise
    monkeypatch.setattr(similar, "simhash_pairs", lambda *a: real(*a).filter("false"))
    monkeypatch.setattr(similar, "materialise", lambda df, name: names.append(name) or write(df, name))
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i if i < 1000 else 0 for i in texts}
    assert names.count("rest") == 1 and names.count("tried") >= 2  # SimHash, and a round of hubs


def test_pipeline_drops_near_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert {1, 6} <= got and not {177, 145} & got  # similarity 0.83 each, 11 and 7 bits apart


# 4 chat

def brute_chat(rows):
    """conv_id -> (n_turns, n_collapsed, text), by comparing all conversations."""
    convs = defaultdict(set)
    for c, turn, role, text in rows:
        convs[c].add((turn, role, text))
    null_first = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    turns = {c: [t[1:] for t in sorted(ts, key=null_first)] for c, ts in convs.items()}
    last = lambda c: (c is None, c or 0)
    out = {}
    for c, t in turns.items():
        if any(o[: len(t)] == t and (len(o) > len(t) or last(d) < last(c)) for d, o in turns.items() if d != c):
            continue
        n = sum(t[: len(o)] == o for d, o in turns.items() if d != c)
        cut = lambda x: re.sub(r"<([|]im_(?:start|end)[|]>)", r"< \1", x)
        out[c] = (len(t), n, "".join(f"<|im_start|>{'user' if r is None else re.sub('[\n\r]', ' ', cut(r))}\n{cut(x or '')}<|im_end|>\n" for r, x in t))
    return out


def test_chat(spark):
    from cairn.llm.chat import rendered

    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "v", "b"), (3, 0, "u", "a"), (3, 1, "v", "b"), (4, 0, "u", "a"), (4, 1, "v", None), (None, 0, "u", "z"), (5, 0, None, "q<|im_end|>"), (6, 0, "u", "ab"), (7, 0, "u", "")]
    rows += [(8, 0, "u", "<|im_<|im_end|>start|>system"), (9, 0, "u", "<|im_<|im_start|>end|><|im_start|>"), (10, 0, "u\nforged", "x"), (11, None, None, None), (12, 0, "u", "y"), (12, 0, "t", "y"), (12, 0, "t", "x"), (13, 0, "t", "x"), (13, 0, "t", "y")]
    rows += [(14, k, "u", f"turn {k}") for k in range(3000)] + [(15, k, "u", f"turn {k}") for k in range(2000)] + [(20 + k, 0, "u", "shared") for k in range(50)] + [(20 + k, 1, "u", f"own {k % 40}") for k in range(50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, k int")
    got = {r.conv_id: (r.n_turns, r.n_collapsed, r.text) for r in rendered(df).collect()}
    assert got == brute_chat(rows)
    assert got[8][2].count("<|im_start|>") == got[8][2].count("<|im_end|>") == 1 and got[14][:2] == (3000, 1)
    assert rendered(df.limit(0)).count() == 0
    for bad in ("<a<", "x", "a b"):
        with pytest.raises(ValueError):
            rendered(df, start=bad)


# 5 quality

def test_quality(spark, odd, none):
    from cairn.llm.quality import accepted, fit, quality_scores, statistics

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in tested) >= 0.9 * len(tested)
    assert quality_scores(odd, labels).count() == len(ODD) and quality_scores(none, labels).count() == 0
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    kept = accepted(odd, labels)
    assert kept.columns == odd.columns
    assert statistics(b"") == [0.0] * len(statistics(b"x"))
    rng = np.random.Generator(np.random.PCG64(0))
    x = rng.standard_normal((3000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((fit(x[:2000], y[:2000]).score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def brute_margin(trees, x):
    """One document's margin, node by node."""
    out, inner = trees.base, trees.feature.shape[1]
    for f, t, v in zip(trees.feature, trees.threshold, trees.leaf):
        at = 0
        while at < inner:
            at = 2 * at + (2 if x[f[at]] > t[at] else 1)
        out += v[at - inner]
    return out


def test_quality_beats_the_majority_on_held_out_rows(spark):
    from cairn.llm.quality import quality_scores

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.score, r.predicted, want[r.doc_id]) for r in quality_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).filter("held_out").collect()]
    bad = [p for _, p, y in got if not y]
    good = [p for _, p, y in got if y]
    assert len(bad) > 60 and sum(good) >= 0.97 * len(good) and len(bad) - sum(bad) >= 0.6 * len(bad)
    low, high = [s for s, _, y in got if not y], [s for s, _, y in got if y]
    assert sum((a < b) + 0.5 * (a == b) for a in low for b in high) / len(low) / len(high) > 0.9


def test_quality_labels_repeat_and_miss(spark):
    from cairn.llm.quality import fit, quality_scores

    docs = spark.createDataFrame([(i, ("good words of a text " if i % 2 else "$$$ !!! ") * 5, 1, "k") for i in range(200)] + [(7, "x", 1, "k")], "doc_id long, text string, quality int, row string")
    labels = [(i, i % 2, 0) for i in range(200)]
    one = quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).orderBy("doc_id", "score").collect()
    odd = labels + [(i, 1, 0) for i in range(0, 50, 2)] + [(None, 1, 0), (3, None, 0), (9999, 1, 1)]
    assert quality_scores(docs, spark.createDataFrame(odd, "doc_id long, quality int, text int")).orderBy("doc_id", "score").collect() == one  # the lower label counts
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.standard_normal((400, 6)).round(1)
    trees = fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), n_trees=7, depth=3)
    assert np.allclose(trees.margin(x), [brute_margin(trees, r) for r in x], atol=1e-12)


# 6 language model

def brute_ctw(units, train, depth):
    """Sequential context-tree weighting of the training units, then the frozen cost of each unit, in logs."""
    from math import lgamma

    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def walk(unit):
        for t, byte in enumerate(unit):
            past = [unit[t - d] if t >= d else 255 for d in range(1, depth + 1)]
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
                yield [(tuple(past[:d]), node) for d in range(depth + 1)], bit

    for unit, n in train.items():
        for path, bit in walk(unit):
            for a, b in zip(path, path[1:]):
                kids[a].add(b)
            for s in path:
                counts[s][bit] += n
    kt = lambda s: lgamma(counts[s][0] + 0.5) + lgamma(counts[s][1] + 0.5) - lgamma(sum(counts[s]) + 1) - math.log(math.pi)
    memo = {}

    def weighted(s):
        if s not in memo:
            own = kt(s)
            if len(s[0]) == depth:
                memo[s] = own, None
            else:
                below = sum(weighted(c)[0] for c in kids[s])
                m = max(own, below)
                total = m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(below - m))
                memo[s] = total, 0.5 * math.exp(own - total)
        return memo[s]

    def cost(unit):
        out = 0.0
        for path, bit in walk(unit):
            p = None
            for s in reversed(path):
                q = (counts[s][1] + 0.5) / (sum(counts[s]) + 1)
                w = weighted(s)[1]
                p = q if p is None else w * q + (1 - w) * p
            out += math.log(p if bit else 1 - p)
        return out

    return {u: cost(u) for u in units}


def brute_word_depth(texts, train, cost):
    """Logs of the texts' probabilities: of each unit after the one before, from its own cost and all training pairs."""
    from math import lgamma

    after = defaultdict(Counter)
    for i in train:
        for a, b in zip([None, *texts[i]], texts[i]):
            after[a][b] += 1
    strengths = [8.0**k for k in range(7)]

    def probability(a, b):
        n, kinds, p = sum(after[a].values()), len(after[a]), math.exp(cost[b])
        fits = [math.exp((kinds - 1) * math.log(s) - lgamma(s + n) + lgamma(s + 1)) if n else 1.0 for s in strengths]
        return sum(f / sum(fits) * (after[a][b] + s * p) / (n + s) for f, s in zip(fits, strengths))

    return {i: sum(math.log(probability(a, b)) for a, b in zip([None, *us], us)) for i, us in texts.items()}


def test_language_model(spark, odd, none):
    from cairn.llm import ctw

    texts = ["the cat sat on the mat", "The dog", "", None, "a cat, a mat and the end " * 3, "zzz qqq", "Ünïcode ßtuff"] + [f"the number {i}" for i in range(20)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ctw.scores(spark.createDataFrame(rows, DOCS), chunk_bytes=100).collect()}
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t, *_ in rows}
    train = [i for i, *_ in rows if not held(i, 7, 2)]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    units = {i: [w + b" " for w in ws[:-1]] + [(ws[-1] if ws else b"") + b"\xff"] for i, ws in words.items()}
    cost = brute_ctw({u for us in units.values() for u in us}, Counter(u for i in train for u in units[i]), ctw.D)
    want = brute_word_depth(units, train, cost)
    for i, ws in words.items():
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7, 2), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
        assert abs(r.bits_per_byte + r.score * math.log2(10) / sum(map(len, units[i]))) < 1e-9
        assert abs(r.base_score - base) < 1e-9 and abs(r.score - want[i] / math.log(10)) < 1e-5
    spread = {r.doc_id: r.score for r in ctw.scores(spark.createDataFrame(rows, DOCS), chunk_bytes=100, part_bytes=20, hot_tokens=2).collect()}
    assert all(abs(spread[i] - got[i].score) < 1e-5 for i in got)
    assert ctw.scores(odd).count() == len(ODD) and ctw.scores(none).count() == 0


def test_language_model_beats_the_unigrams(spark):
    from pyspark.sql import functions as F

    from cairn.llm import ctw

    r = ctw.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_packed_arrays():
    from cairn.llm import ctw

    arrays = [np.array([0, 1, 255, 256, 2**63], np.uint64), np.array([], np.int64), np.array([1.5, -2.25], np.float32), np.array([True, False]), np.array([7, 0, 0], np.int32)]
    for a, b in zip(arrays, ctw._unpack(ctw._pack(*arrays)), strict=True):
        assert np.array_equal(a.astype(b.dtype), b)


def test_log_gamma():
    from cairn.llm.ctw import log_gamma

    x = np.array([0.5, 1, 2.5, 10, 1e3, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


# 7 decontamination

def test_leaks(spark, none):
    from itertools import combinations

    from cairn.llm.decontam import MASKS, leaks, without_leaks

    for gaps in combinations(range(15), 3):  # the masks' promise
        assert any(not any(p + o in gaps for o in m) for m in MASKS for p in range(15 - m[-1]))
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 9, 15, 30])))) for i in range(40)] + [(99, None), (98, " "), (97, "only three words")]
    docs, want = [], set()
    for i, text in items[:40]:
        w = text.split()
        for k, changed in ((0, []), (1, rng.sample(range(len(w)), max(0, int(0.2 * min(len(w), 15))) if len(w) >= 15 else 0))):
            own = [word() if j in changed else x for j, x in enumerate(w)]
            docs.append((i * 10 + k, " ".join([word() for _ in range(20)] + own + [word() for _ in range(20)]).upper()))
            if len(w) <= 15 or not changed:
                want.add((i * 10 + k, i))
    docs += [(5000 + k, " ".join(word() for _ in range(60))) for k in range(50)] + [(6000, None), (6001, ""), (6002, "these are only three words of it")]
    want.add((6002, 97))
    d = spark.createDataFrame([(*r, "en", "a", 1) for r in docs], DOCS)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert want <= got and not any(5000 <= x < 6002 for x, _ in got)
    assert {(r.doc_id, r.item_id) for r in leaks(d, b, block_bytes=500).collect()} == got
    assert {r.doc_id for r in without_leaks(d, b).collect()} == {x for x, _ in docs} - {x for x, _ in got} and without_leaks(d, b).columns == d.columns
    assert leaks(none, b).count() == 0 and leaks(d, b.limit(0)).count() == 0


def brute_leaks(docs, items):
    """(doc, item) of all alignments of which a window agrees enough."""
    cut = lambda t: (t or "").encode().lower().split()
    out, numbers = set(), {}
    number = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64)
    its = [(i, number(cut(t))) for i, t in items if cut(t)]
    for d, t in docs:
        x = number(cut(t))
        have = set(x.tolist())
        for i, own in its:
            n, w = len(own), min(15, len(own))
            need = w if n < 8 else -(-4 * w // 5)
            if sum(v in have for v in own.tolist()) < need:
                continue
            for base in range(w - n, len(x) - w + 1):
                a, z = max(0, base), min(len(x), base + n)
                eq = (x[a:z] == own[a - base : z - base]).astype(int)
                if z - a >= w and np.convolve(eq, np.ones(w, int), "valid").max() >= need:
                    out.add((d, i))
                    break
    return out


def test_leaks_are_those_of_brute_force(spark):
    from cairn.llm.decontam import leaks, without_leaks

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["the"] * 20
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([1, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 22, 30])))) for k in range(40)] + [(90, "the " * 20), (91, "the " * 9), (3, "again under one id of another text here now"), (None, "an item without id is found as well here"), (95, None), (96, " ")]
    docs = []
    for k in range(150):
        own = rng.choice(items[:42])[1].split()
        for j in rng.sample(range(len(own)), min(len(own), rng.randint(0, 5))):
            own[j] = rng.choice(vocabulary)
        docs.append((k, " ".join(words(rng.randint(0, 12)) + own[rng.choice([0, 0, 0, 2]) :] + words(rng.randint(0, 12)))))
    docs += [(200, "the " * 400), (201, None), (202, ""), (203, " \n"), (None, "so an item without id is found as well here"), (204, docs[0][1]), (204, docs[0][1])]
    want = brute_leaks(docs, items)
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, row int, hits int, item_id int")
    b = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, row string, doc_id int")
    rows = leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 100
    assert {(r.doc_id, r.item_id) for r in leaks(d, b.unionByName(b), block_bytes=900).collect()} == want
    assert sum(r.doc_id == 204 for r in rows) == 2 * sum(x == 204 for x, _ in want)
    bad = {x for x, _ in want}
    assert sorted(str(r.doc_id) for r in without_leaks(d, b).collect()) == sorted(str(x) for x, _ in docs if x not in bad) and without_leaks(d, b).columns == d.columns


def test_items_of_any_length_are_found_with_every_allowed_substitution():
    from itertools import combinations

    from cairn.llm.decontam import Index

    for n in range(8, 17):
        item = [f"t{k}" for k in range(n)]
        index = Index.build([(1, " ".join(item))])
        allowed = min(15, n) - -(-4 * min(15, n) // 5)
        texts = [" ".join(["a", "b", *["x" if k in gone else w for k, w in enumerate(item)], "c"]).encode() for gone in combinations(range(n), allowed)]
        assert all(index.find(texts)), n
        if n <= 15:
            more = [" ".join(["x" if k in gone else w for k, w in enumerate(item)]).encode() for gone in combinations(range(n), allowed + 1)]
            assert not any(index.find(more)), n


def test_repeated_words_take_bounded_memory():
    import time
    import tracemalloc

    from cairn.llm.decontam import Index

    for text, item in ((30_000, 200), (15_000, 2000), (30_000, 20)):
        index = Index.build([(1, "word " * item), (2, "word " * 9 + "other " * 9)])
        tracemalloc.start()
        began = time.time()
        got = index.find([b"word " * text, b"nothing here"])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == [[(1, item, 15, 15, 0)], []] and peak < 200e6 and time.time() - began < 20


# 8 token ids

def test_tokens_round_trip(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cairn.llm.tokenout import PieceEncoder, default_vocabulary, read_tokens, token_digests, write_tokens

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, rng = PieceEncoder(default_vocabulary()), random.Random(1)
    pool = [*"aBZ .,'s\tt\nréÉßİΣ١²½中<|>-\x1c\xa0ﬁ", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "Word", "The."]
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert pieces.encode(t.encode()) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, df in (("a", docs), ("b", odd), ("c", none)):
        folder = str(tmp_path / name)
        write_tokens(df, folder)
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        ids = [whole.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
        starts = np.cumsum([0, *map(len, ids)]).tolist()
        want = sorted((repr(d), s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), s, x in zip(rows, starts, ids))
        assert sorted((repr(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_digests(spark, folder).collect()) == want
    some = {r.doc_id: r.ids for r in read_tokens(spark, str(tmp_path / "a"), [3, 17]).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert some == {i: whole.encode(text[i], add_special_tokens=False).ids + [1] for i in (3, 17)}


def test_new_words_are_asked_for_together(monkeypatch):
    """Most words of a corpus are rare; one call of the library for each took op8 over its CPU budget."""
    from types import SimpleNamespace

    import pyarrow as pa
    from tokenizers import Tokenizer

    from cairn.llm import tokenout

    path, rng, asked = tokenout.default_vocabulary(), random.Random(3), []
    whole, pieces = Tokenizer.from_file(path), tokenout.PieceEncoder(path)

    def counted(ask):
        return lambda x, **options: (asked.append(x), ask(x, **options))[1]

    pieces.tokenizer = SimpleNamespace(encode=counted(pieces.tokenizer.encode))
    pieces.bare = SimpleNamespace(encode_batch_fast=counted(pieces.bare.encode_batch_fast))
    syllables = "th an er tion en ß é ci\u00f3n Ou wh".split()
    texts = [None, ""] + [" ".join("".join(rng.choices(syllables, k=rng.randint(2, 6))) + rng.choice(["", ".", ",", "***", "'s", "'RE", "!?", " 23.1.4"]) for _ in range(300)) for _ in range(50)]
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(pieces.encode_all(pa.array(texts))) == want
    assert len(set(" ".join(texts[2:]).lower().split())) > 10_000 and len(asked) <= 5
    assert list(pieces.encode_all(pa.array(texts, pa.large_string()).slice(1))) == want[1:] and len(asked) <= 5

    # words of all rows are cut at once: rows, odd characters, special tokens and small caches change nothing
    pool = [*"aBsStdmrevl .,'\t\nréÉßİΣ²½º×÷ÿÞ中<|>-\x1c\xa0\x85\x00\u0301'07", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'RE", "</w>", "%%%", "<|"]
    pieces = tokenout.PieceEncoder(path)
    for span, cache, ask in ((1, 5, 1), (100, 200, 3), (4_000_000, 200_000, 10_000)):
        for name, value in (("_SPAN", span), ("_CACHE", cache), ("_ASK", ask)):
            monkeypatch.setattr(tokenout, name, value)
        texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(500)]
        for t, got in zip(texts, pieces.encode_all(pa.array(texts)), strict=True):
            assert got == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_other_vocabularies_encode_whole_texts():
    import glob

    import public_tokenizers
    from tokenizers import Tokenizer

    from cairn.llm.tokenout import PieceEncoder, default_vocabulary

    folder = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    assert PieceEncoder(default_vocabulary()).piecewise
    others = 0
    for path in sorted(glob.glob(f"{folder}/**/*.json", recursive=True)):
        try:
            whole = Tokenizer.from_file(path)
        except Exception:  # noqa: BLE001 not a tokenizer's file
            continue
        pieces = PieceEncoder(path)
        others += not pieces.piecewise
        for t in ("", "Plain words, and more.  Two blanks", "Über\tstraße 中文 x\r\ny", "don't  I'LL 12 345"):
            assert pieces.encode(t.encode()) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), path
    assert others


# 9 licences

FILLER = ("prose of the old mill by the river where a man and his dog were walking to the town " * 10).split()


def brute_windows(text):
    """(paragraph, first word, words) of all windows."""
    from cairn.llm.licenses import words

    for k, part in enumerate(re.split(r"\n[ \t-\r]*\n", text or "")):
        w = words(part)
        for a in range(0, max(1, len(w)), 30):
            if a == 0 or a + 30 < len(w):
                yield k, a, w[a : a + 60]


def brute_licences(rows, negatives):
    """(doc, paragraph, family) -> (probability, overlap, confirmed): every window, triggers or not."""
    from cairn.llm.licenses import FAMILIES, FURTHER, TEMPLATES, features, own_features, train

    vocabulary, w, temperature = train(negatives)
    own = own_features()
    out = {}
    for n, (doc, text) in enumerate(rows):
        found = []
        for k, a, ws in brute_windows(text):
            grams = {f"{x} {y}" for x, y in zip(ws, ws[1:])}
            z = (w[[vocabulary[g] for g in grams if g in vocabulary]].sum(0) + w[-1]) / temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            if p[0] < 0.5 and len(ws) > 1:
                c = int(p[1:-1].argmax())
                sure = p[1 + c] >= 0.6
                over = max(min(1.0, len(grams & features(t)) / min(24, len(features(t)))) for t in TEMPLATES[FAMILIES[c]])
                found.append((k, a, FAMILIES[c] if sure else "unknown", p[1 + c] if sure else 1 - p[0] - p[1 + c], over, bool(sure and over >= 0.5 and grams & own[c] and not grams & set(FURTHER.get(FAMILIES[c], ())))))
        for k, a, family, p, over, confirmed in found:
            if family == "unknown" and any(f[0] == k and abs(f[1] - a) <= 30 and f[2] != "unknown" for f in found):
                continue
            old = out.get((n, doc, k, family))
            out[n, doc, k, family] = max(old, (confirmed, p, -a, over)) if old else (confirmed, p, -a, over)
    return Counter((doc, k, family, round(v[1], 9), round(v[3], 9), v[0]) for (_, doc, k, family), v in out.items())


def test_licences(spark, odd, none):
    from cairn.llm.licenses import FAMILIES, TEMPLATES, sampled_windows, scan

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [(c, t) for c, ts in TEMPLATES.items() for t in ts]
    more = [(100_000 + i, t) for i, (_, t) in enumerate(texts)]
    more += [(200_000 + i, f"{' '.join(FILLER[:k])}\n{t} {' '.join(FILLER[:k])}") for i, (_, t) in enumerate(texts) for k in (40,)]
    mit = next(t for t in TEMPLATES["MIT"] if t.startswith("Permission")).split()
    foreign = ["Licensed under the Eclipse Public License, version 2.0.", "Distributed under the Boost Software License, Version 1.0.", "All rights reserved. Proprietary.", "Copyright 2021 ACME Corp. All rights reserved. Proprietary and confidential.", "Licensed under the Microsoft Public License."]
    plain = ["He renewed his license in the city.", "The general public was under the impression that the version was free.", "prose of the old mill"]
    more += [(300_000, "/*\n * " + " ".join(mit[:15]) + "\n * " + " ".join(mit[15:32]) + "\n * " + " ".join(mit[32:]) + "\n */"), (300_001, "first part\n \nReleased under the MIT License.\n\nmore prose"), (300_001, "first part\n \nReleased under the MIT License.\n\nmore prose"), (None, "Licensed under CC BY-NC 4.0.")]
    more += [(400_000 + i, t) for i, t in enumerate(foreign)] + [(500_000 + i, t) for i, t in enumerate(plain)] + [(600_000, "word " * 20_000 + "Released under the MIT License. " + "word " * 9000)]
    df = docs.unionByName(spark.createDataFrame([(*r, "en", "a", 1) for r in more], DOCS))
    rows = scan(df).collect()
    got = Counter((r.doc_id, r.paragraph, r.family, round(r.probability, 9), round(r.template_overlap, 9), r.confirmed) for r in rows)
    assert got == brute_licences([(r.doc_id, r.text) for r in df.collect()], sampled_windows(df))
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.paragraph, r.family, r.confirmed))
    lines = {r.doc_id: x for r in docs.collect() for x in r.text.split("\n") if "icense" in x}
    assert {i for i in by if i is not None and i < 100_000 and any(f[2] for f in by[i])} == set(lines)
    assert {i for i in by if i is not None and i < 100_000} - set(lines) == {r.doc_id for r in docs.collect() if "All rights reserved." in r.text} - set(lines)
    right = [by[100_000 + i] == {(0, c, True)} for i, (c, _) in enumerate(texts)] + [(0, c, True) in by[200_000 + i] for i, (c, _) in enumerate(texts)]
    assert sum(right) >= 0.9 * len(right) and len(FAMILIES) == 12
    assert by[300_000] == {(0, "MIT", True)} and by[300_001] == {(1, "MIT", True)} and sum(r.doc_id == 300_001 for r in rows) == 2 and by[None] == {(0, "CC-BY-NC", True)} and by[600_000] == {(0, "MIT", True)}
    assert all(by[400_000 + i] == {(0, "unknown", False)} for i in range(len(foreign))) and not any(500_000 + i in by for i in range(len(plain)))
    assert scan(odd).count() == 0 and scan(none).count() == 0


def test_short_notices_and_near_misses(spark):
    from cairn.llm.licenses import scan

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    right = [("SPDX-License-Identifier: MIT", "MIT"), ("License: MIT", "MIT"), ("See LICENSE for details. MIT licensed.", "MIT"), ("License: GPL-3.0", "GPL"), ("This is distributed under the terms of the GNU GPL v3", "GPL"), ("Modified BSD License", "BSD"), ("License: Apache-2.0", "Apache-2.0"),
             ("Licensed under CC BY 4.0.", "CC-BY"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"), ("Released under the ISC License.", "ISC"), ("License: MPL-2.0", "MPL-2.0")]
    other = ["SPDX-License-Identifier: MIT-0", "License: MIT-0", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "Licensed under the Apache License, Version 1.1.", "Licensed under the Eclipse Public License, version 2.0.", "Distributed under the Boost Software License, Version 1.0."]
    rows = [(100_000 + i, t) for i, (t, _) in enumerate(right)] + [(200_000 + i, t) for i, t in enumerate(other)] + [(300_000, "Er ging mit dem Hund, mit no und mit 0 Sorgen."), (300_001, "Das Spiel endete mit 0 Toren."), (300_002, "Version 1 of the map was sold by nd, the old firm.")]
    got = {r.doc_id: (r.family, r.confirmed) for r in scan(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).filter("doc_id >= 100000").collect()}
    assert {t: got.get(100_000 + i) for i, (t, _) in enumerate(right)} == {t: (c, True) for t, c in right}
    assert {t: got.get(200_000 + i) for i, t in enumerate(other)} == {t: ("unknown", False) for t in other}
    assert not {300_000, 300_001, 300_002} & set(got)


def test_licence_probabilities_are_calibrated(spark):
    from cairn.llm import licenses as L

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    negatives = L.sampled_windows(docs)
    vocabulary, w, temperature = L.train(negatives)
    # licences, names, words and prose that neither training nor the temperature has seen
    others = ["Licensed under the Eclipse Public License, version 2.0.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Microsoft Public License.", "This file may be used under the terms of the Zope Public License.", "All rights reserved. Proprietary."]
    rng = np.random.Generator(np.random.PCG64(99))
    names, L._SYLLABLES[2] = "alpha brook cedar delta ember frost grove".split(), "al bro ce del em fro gro".split()
    lines, y = L.variants(rng, FILLER + names, 6, 2, others)
    rest = [" ".join(x[k : k + 60]) for r in docs.limit(400).collect() for x in [L.words(r.text.replace("icense", "x").replace("rights", "x"))] for k in (0, 60)]
    lines, y = lines + rest, np.array(y + [0] * len(rest))
    p = L.softmax(L._vectors(lines, vocabulary) @ w / temperature)
    top, sure = p.argmax(1), p.max(1)
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(sure[bins == b].mean() - (top == y)[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert error < 0.05 and (top == y)[y > 0].mean() > 0.9 and (top == y)[y == len(L.CLASSES) - 1].mean() > 0.85


# 10 languages

def test_languages(spark, odd, none):
    from cairn.llm.langid import identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    tested = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == want[r.doc_id] for r in tested) >= 0.97 * len(tested)
    out = {r.doc_id: r.lang_pred for r in identify(odd).collect()}
    assert [out[i] for i in (1, 2, 3, 9)] == ["und"] * 4 and out[8] != "und" and len(identify(odd).collect()) == len(ODD)
    assert identify(none).count() == 0 and {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, "lang").limit(5)).collect()} == {"und"}


def test_languages_that_tie_go_by_name(spark):
    from cairn.llm.langid import identify

    rows = [(i, "same words in both", "zz" if i % 2 else "aa", 1) for i in range(1, 400)]
    ids = {m: [i for i, *_ in rows if not held(i, 5, 0) and i % 2 == m] for m in (0, 1)}
    n = min(map(len, ids.values()))
    keep = set(ids[0][:n]) | set(ids[1][:n])
    df = spark.createDataFrame([r for r in rows if r[0] in keep or held(r[0], 5, 0)], "doc_id long, text string, lang string, score int")
    assert {(r.lang_pred, round(r.score, 9)) for r in identify(df).collect()} == {("aa", 0.5)}


# pipeline

def shingle_set(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute_first(rows):
    """Of (doc_id, text) with different ids, the smallest id of each group of similar texts."""
    sets = [(d, shingle_set(t)) for d, t in sorted(rows)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {sets[find(i)][0] for i in range(len(sets))}


def brute_order(spark, docs):
    """doc_ids in the order of the mixture, of a table whose sources fill one bucket each."""
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h1"), F.xxhash64(*docs.columns).alias("h2")).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.h1, r.h2)):
        by[r.source].append(r.doc_id)
    names = sorted(by, key=lambda s: (s is not None, s or ""))
    assert max(map(len, by.values())) <= 1024
    slots = brute_slots([len(by[s]) ** 0.7 for s in names], [len(by[s]) // 64 + 1 for s in names])
    return [d for _, s, k in slots for d in by[names[s]][64 * k : 64 * k + 64]]


def test_pipeline_is_brute_force(spark):
    """Every stage anew, in plain Python; only the trained trees are the library's."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from cairn.llm import quality
    from cairn.llm.tokenout import default_vocabulary

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    trees = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if 1 / (1 + math.exp(-brute_margin(trees, quality.statistics((r.text or "").encode())))) >= 0.3]
    first = brute_first(rows)
    leaked = {d for d, _ in brute_leaks([r for r in rows if r[0] in first], [(r.item_id, r.text) for r in bench.collect()])}
    assert len(rows) < docs.count() and len(first) < len(rows) and leaked
    final, text = docs.filter(docs.doc_id.isin(sorted(first - leaked))), dict(rows)
    whole = Tokenizer.from_file(default_vocabulary())
    start, want = 0, {}
    for d in brute_order(spark, final):
        ids = whole.encode(text[d], add_special_tokens=False).ids + [1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in pipeline.run(spark, SF).collect()} == want


def python_bytes(df):
    """Bytes that go to the Python workers, and that come back."""
    df._jdf.queryExecution().toRdd().count()
    out, plans = [0, 0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        for k, name in enumerate(("pythonDataSent", "pythonDataReceived")):
            out[k] += p.metrics().apply(name).value() if p.metrics().contains(name) else 0
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_texts_go_to_workers_once_and_stay_there(spark):
    from cairn.llm.decontam import without_leaks
    from cairn.llm.quality import accepted

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for df in (accepted(docs, labels), without_leaks(docs, bench), without_leaks(docs, bench, 1000).limit(10**6)):
        sent, back = python_bytes(df)
        assert df.count() and back < size / 10
    for df in (accepted(docs, labels), without_leaks(docs, bench)):
        assert size <= python_bytes(df)[0] < 1.2 * size


def test_pipeline_bounds_the_bytes_of_batches(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from cairn.llm.common import passing

    spark.range(100).selectExpr("id doc_id", "repeat(cast(id as string), 500000) text").coalesce(1).write.parquet(str(tmp_path / "long"))
    spark.read.parquet(f"{SF}/documents.parquet").limit(50).write.parquet(str(tmp_path / "few"))
    docs = spark.read.parquet(str(tmp_path / "long"))  # 95 MB
    for stage in (pipeline.drop_low_quality, pipeline.drop_near_duplicates, pipeline.drop_leaks, pipeline.write_token_ids):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, spark.read.parquet(str(tmp_path / "few")), SF)
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) > 95e6 and max(r.n for r in sizes) < 4e6
    assert passing(docs, lambda texts: pa.array([texts.nbytes < 4e6] * len(texts))).count() == 100


def test_small_tables_start_no_workers(spark, docs, none, tmp_path, monkeypatch):
    from cairn.llm.mixing import mixed
    from cairn.llm.tokenout import write_tokens

    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (made.append(data), create(self, data, *a, **b))[1])
    assert mixed(docs).count() == docs.count() and mixed(none).count() == 0
    write_tokens(docs, str(tmp_path / "tokens"))
    assert len(made) == 5 and all(isinstance(x, pa.Table) for x in made)


def test_pipeline_bears_odd_tables(spark, odd, none, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    more = spark.createDataFrame([(*r, "x", 1) for r in [(50 + i, f"text number {i} of its own, " + " ".join(f"w{i}x{k}" for k in range(40 + i)), None if i % 3 else "s", "a" if i % 2 else None, 1) for i in range(30)]], DOCS + ", row string, fp long")
    for name, df in (("odd", odd.unionByName(more)), ("none", none)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            df.write.parquet(str(tmp_path / f"{name}{k}"))
            before = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            df = stage(spark, before, str(tmp_path))
            if k < 4:
                assert df.columns == before.columns
        out = df.collect()
        assert len(out) == (spark.read.parquet(str(tmp_path / f"{name}4")).count())
        assert len(out) >= 30 if name == "odd" else not out


# 11 warc

def test_warc_round_trip(spark, tmp_path):
    from cairn.llm import warc

    rng = random.Random(11)
    body = ["", "<p>a</p>", "é中" * 40, "x" * 5_000, "0\r\n\r\n WARC/1.1\r\nContent-Length: 3\r\n\r\n", "y\r\n" * 3_000, None]
    rows = [(i if i % 9 else (None if i == 9 else 9), rng.choice([f"http://h/{i}?a b\r\nX: y", None]), rng.choice(body)) for i in range(1, 90)] + [(200, "u", "z" * 300_000), (201, "v", "z" * 300_000), (5, "same", "<p>a</p>"), (5, "same", "<p>a</p>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, row int, digest string").repartition(5)
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder, segment_bytes=1_500, chunk_bytes=700)
    records = warc.read_records(spark, folder).collect()
    assert all(r.problem is None for r in records) and len(records) == len(rows) == len({r.record_id for r in records})
    assert max(r.n_segments for r in records) == -(-(len(warc._HTTP) + len(warc.framed(b"z" * 300_000, 700))) // 1_500)
    got = sorted(map(tuple, warc.resolved(spark.createDataFrame(records, warc._RECORD)).drop("problem").collect()), key=str)
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(least.get(h or "", (True, 0)), (i is None, i or 0))
    first = set()
    want = []
    for i, _, h in rows:
        h = h or ""
        new = (i is None, i or 0) == least[h] and h not in first
        first |= {h} if new else set()
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if new else "revisit", None if new else (None if least[h][0] else least[h][1])))
    assert got == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in records if r.record_type == "response"} == {h or "" for _, _, h in rows}
    # files are members one after the other, as any reader takes them
    data = b"".join(open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.startswith("part"))
    text = gzip.decompress(data)
    assert text.count(b"WARC-Type: response\r\n") == len(first) and b"%0D%0A" in text and b"\r\nX: y" not in text
    assert warc.resolved(warc.read_records(spark, folder, payloads=False)).count() == len(rows)


def test_warc_segments_that_do_not_fit():
    from cairn.llm.warc import assembled

    parts = [b"ab", b"cd", b"e"]
    assert assembled([3, 1, 2], [5, None, None], [parts[2], parts[0], parts[1]]) == (b"abcde", 3, None)
    assert assembled([1, 2, 2, 3], [None, None, None, 5], [parts[0], parts[1], parts[1], parts[2]]) == (b"abcde", 3, None)
    assert assembled([1, 3], [None, 5], [parts[0], parts[2]])[2] == "segment missing"
    assert assembled([1, 2], [None, None], parts[:2])[2] == "segment missing"
    assert assembled([1, 2, 2], [None, None, 4], [parts[0], parts[1], b"xx"])[2] == "segments differ"
    assert assembled([1, 2], [None, 9], parts[:2])[2] == "length differs"
    assert assembled([None, 2], [None, 4], parts[:2])[2] == "segment missing"


def test_warc_chunk_framing():
    from cairn.llm.warc import framed, payload_of, unframed

    for n in (0, 1, 9, 10, 11, 999):
        for size in (1, 10, 4096):
            assert unframed(framed(b"q" * n, size)) == b"q" * n
    assert unframed(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert [unframed(x) for x in (b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"", b"3\r\nabc\r\n", b"-1\r\n")] == [None] * 5
    assert payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding:  Chunked\r\n\r\n<html>") == (b"<html>", "chunk framing")
    assert payload_of(b"HTTP/1.0 200 OK\r\nA: b\r\n c\r\n\r\n3\r\nabc") == (b"3\r\nabc", None) and payload_of(b"x") == (b"x", "no HTTP head")


def test_warc_reads_other_archives(spark, tmp_path):
    from cairn.llm import warc

    record = lambda kind, block, *more: b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, b"%d" % len(block), b"".join(x + b"\r\n" for x in more), len(block), block)
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    plain = record(b"warcinfo", b"software: x") + record(b"response", http, b"WARC-Payload-Digest: sha1:" + warc.sha1_base32(b"hello").encode()) + record(b"response", http + b"!", b"WARC-Payload-Digest: sha1:AAAA") + record(b"resource", b"bytes", b"WARC-Block-Digest: sha1:BBBB")
    last = record(b"continuation", b"tail", b"WARC-Segment-Origin-ID: <nobody>", b"WARC-Segment-Number: 2", b"WARC-Segment-Total-Length: 9")
    for name, data in (("a.warc", plain + last), ("b.warc.gz", gzip.compress(plain[: plain.index(b"WARC/1.0", 9)]) + gzip.compress(last)), ("c.warc", plain[:-6]), ("d.warc.gz", gzip.compress(plain)[:-30]), ("e.warc", b"")):
        (tmp_path / name).write_bytes(data)
    read = lambda name: sorted((r.record_type or "", r.problem or "", None if r.payload is None else bytes(r.payload)) for r in warc.read_records(spark, str(tmp_path / name)).collect())
    whole = [("continuation", "segment missing", None), ("resource", "block digest differs", b"bytes"), ("response", "", b"hello"), ("response", "payload digest differs", b"hello!"), ("warcinfo", "", b"software: x")]
    assert read("a.warc") == whole
    assert read("b.warc.gz") == [whole[0], whole[4]]
    assert any(r[1] == "truncated" for r in read("c.warc")) and any(r[1] in ("truncated", "broken member") for r in read("d.warc.gz"))
    assert read("e.warc") == []


def test_warc_empty_table_and_query(spark, tmp_path):
    from cairn.llm import warc

    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{SF}/pages.parquet'")
    want = duckdb.sql(warc.OP11_SQL)
    got = warc.op11_query(spark, SF)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# 12 alignment

def brute_alignment(rows, path_a, path_b):
    """Whole texts through both libraries, groups by a walk over the bytes, pairs by documents."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    of_a = lambda i: bytes(back[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    kept, held = [], Counter()
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or not b"".join(map(of_a, x)) == (" " + text).encode() == b"".join(map(of_b, y)):
            kept.append((doc, []))
            continue
        ends = [list(np.cumsum([len(f(i)) for i in ids]).tolist()) for f, ids in ((of_a, x), (of_b, y))]
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in both:
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        kept.append((doc, groups))
        held.update({(u, v) for g, h in groups for u in g for v in h})
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    for doc, groups in kept:
        links = [(u, v) for g, h in groups for u in g for v in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""


BITS = ["a", "the", "Word", "é", " ", "  ", "\n", ".", ",", "'s", "'", "!", "…", "中", "½", "1", "22", "\t", "\u00a0", "\u3000", "\x85", "\x1c", "ß", "×", "x\u0301", "_", "-", "<|endoftext|>", "🙂", "\ufeff", "<s>", "<0x41>", "▁"]


def test_alignment_is_the_brute_force_one(spark):
    from cairn.llm import align

    rng = random.Random(12)
    odd = [None, "", " ", "  ", "\n", " \n a", "a  b", "a ", "don't x's, dogs' ''s", "\x00a \x00", "a" * 3_000, "word " * 6_000, "١٢٣ Ⅷ ǅ ʰ", "same text", "same text", "▁x"]
    odd += ["".join(rng.choices(BITS[: len(BITS) - (k % 4 > 0)], k=rng.randint(1, 40))) for k in range(1_200)]
    rows = [(i if i else None, t) for i, t in enumerate(odd)] + [(4, "  "), (4, "again here")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, key string, chunk int").repartition(3)
    want = sorted(brute_alignment(rows, *align.default_vocabularies()), key=str)
    for size in (3_000, 8_000_000):
        assert sorted(map(tuple, align.aligned(df, *align.default_vocabularies(), chunk_bytes=size).collect()), key=str) == want
    assert sum(r[1] > 0 for r in want) > 800 and align.aligned(df.limit(0), *align.default_vocabularies()).count() == 0


def test_alignment_query_and_pairs(spark, docs):
    from cairn.llm import align

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, align.op12_query(spark, SF).collect())) == sorted(brute_alignment(rows, *align.default_vocabularies()))
    pairs = align.pair_counts(align.chunks(docs, *align.default_vocabularies(), chunk_bytes=50_000))
    assert pairs.groupBy("a").agg(F.max(F.col("best"))).filter("not `max(best)`").count() == 0
    assert pairs.groupBy("a", "b").count().filter("count > 1").count() == 0


def test_alignment_forgets_words_within_bounds(spark, docs, monkeypatch):
    from cairn.llm import align

    made = align.Aligner(*align.default_vocabularies())
    assert made.cuts and made.stems and made.ranks is not None
    before = [made.words[w] for w in made.cut(b"some words, more words")]
    made.learn()
    texts = [made.text[i] for i in before]
    monkeypatch.setattr(align, "_WORDS", 1)
    assert made.full()
    made.forget()
    again = [made.words[w] for w in made.cut(b"more words some words,")]
    made.learn()
    assert {made.text[i] for i in again} == set(texts)
    # without safe cuts, texts are encoded whole, to the same groups
    made.forget()
    made.cuts = made.stems = False
    made.ranks = None
    whole = [made.words[w] for w in made.cut(b"some words, more words")]
    made.learn()
    assert [made.text[i] for i in whole] == [";".join(texts)]


# 13 importance resampling

def brute_resampling(rows, target, percent=25, least=20, seed=7):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    features = lambda t: [bucket(w) for w in words(t)] + [bucket(f"{x} {y}") for x, y in zip(words(t), words(t)[1:])]
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for k, (doc, text) in enumerate(rows):
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if len(words(text)) >= least:
            able.append((-score, doc is None, doc or 0, len(f), k))
    for rank, (*_, k) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


def test_resampling_is_the_brute_force_one(spark, docs):
    from cairn.llm import resample

    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, resample.op13_query(spark, SF).collect()), key=str) == brute_resampling(rows, target)


def test_resampling_of_odd_rows(spark, docs, odd, none, monkeypatch):
    from cairn.llm import resample

    rng = random.Random(13)
    rows = [(r[0], r[1]) for r in ODD] + [(i, " ".join(rng.choices(["Foo", "b-ar", "ÉÀ", "7up", "x_y", "中文"], k=rng.randint(0, 60)))) for i in range(20, 120)] + [(500, "tie word " * 15)] * 30 + [(None, "tie word " * 15)] * 30
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, weight int, w string").repartition(4)
    target = spark.createDataFrame([("foo bar 7up",), (None,), ("",)], "text string")
    monkeypatch.setattr(resample, "_STEP", 7)
    for percent in (0, 25, 90, 100):
        got = resample.drawn(df, target, percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute_resampling(rows, ["foo bar 7up", None, ""], percent)
    assert resample.drawn(none, target).count() == 0
    assert resample.drawn(odd, target.limit(0)).count() == odd.count()
    plan = resample.weights(docs, target)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan


def test_queries_and_their_sql():
    from cairn.llm import queries

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and all(isinstance(q, str) for q in queries.ORACLE_SQL.values()) and all(map(callable, queries.QUERIES.values()))
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == [*range(1, 14)]
