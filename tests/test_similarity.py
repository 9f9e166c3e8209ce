"""Sketches, candidates, exact pairs and diffs against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tagloom.operators import graphs as G
from tagloom.operators import headlines as H
from tagloom.operators import similarity as N


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def corpus():
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base = [say(rng.randint(250, 500)) for _ in range(12)]
    rows, day = [], datetime(2024, 1, 1)
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 4, 12, 40])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, day + timedelta(days=rng.randrange(30)), "".join(t)))
    return rows + [(100, day, "short"), (101, day, None), (102, day, rows[0][2])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, at timestamp_ntz, t string").withColumn("body", F.col("t"))


def pairs_of(rows, days=7):
    texts = [(i, at, t, grams(t)) for i, at, t in rows if t and len(grams(t)) >= 100]
    for k, (a, ta, x, gx) in enumerate(texts):
        for b, tb, y, gy in texts[:k]:
            if abs((ta - tb).total_seconds()) <= days * 86400:
                yield min(a, b), max(a, b), x, y, gx, gy


def test_shingle_hashes_are_those_of_the_shingles():
    for _, _, t in corpus():
        if t:
            assert len(N.shingle_hashes(t)) == len(grams(t))
    assert len(N.shingle_hashes("")) == len(N.shingle_hashes("abcd")) == 0
    assert N.shingle_hashes("αβγδε").tolist() != N.shingle_hashes("αβγδζ").tolist()


def test_estimates_are_close_to_the_similarity():
    x = np.arange(0, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shared in (0, 400, 1000, 1600):
        a, b = N.sketch(x[:1000]), N.sketch(np.concatenate([x[:shared][:1000], x[1000 : 2000 - min(shared, 1000)]]))
        k = min(shared, 1000)
        assert abs((a == b).mean() - k / (2000 - k)) < 0.13


def test_recall_of_candidates_and_exact_pairs(spark):
    rows = corpus()
    f = frame(spark, rows)
    sketched = N.sketches(f).join(f.select("id", "at"), "id")
    few = {(r.a, r.b) for r in N.measured(N.candidates(sketched, least_bands=2), f).collect()}
    found = N.candidates(sketched)
    got = {(r.a, r.b): r for r in N.measured(found, f).collect()}
    want = {}
    for a, b, x, y, gx, gy in pairs_of(rows):
        both = len(gx & gy)
        if both >= 100 and 2 * both / (len(gx) + len(gy)) >= 0.5:
            want[a, b] = (both, 2 * both / (len(gx) + len(gy)), both / min(len(gx), len(gy)), "identical" if x == y else "high")
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 50
    assert few <= set(got) and len(few) >= 0.95 * len(want)
    for k, r in got.items():
        assert (r.shared, r.kind) == (want[k][0], want[k][3]) and abs(r.dice - want[k][1]) < 1e-6 and abs(r.containment - want[k][2]) < 1e-6


def test_incremental_batch_finds_what_the_whole_run_finds(spark):
    rows = corpus()
    f = frame(spark, rows)
    sketched = N.sketches(f).join(f.select("id", "at"), "id")
    whole = {(r.a, r.b) for r in N.candidates(sketched).collect()}
    old = f.where("id % 3 <> 0").select("id")
    got = {(r.a, r.b) for r in N.index_batch(f, old).collect()}
    assert got == {(a, b) for a, b in whole if a % 3 == 0 or b % 3 == 0}
    newest = [r.id for r in f.where("id % 3 = 0 AND length(t) > 200").orderBy(F.desc("at"), F.desc("id")).limit(4).collect()]
    got = {(r.a, r.b) for r in N.index_batch(f, old, batch=2, rounds=2).collect()}
    assert got == {(a, b) for a, b in whole if a in newest or b in newest}


def test_texts_meet_once_in_few_blocks(spark, monkeypatch):
    rows = [(i, at, t) for i, at, t in corpus() if t]
    f = frame(spark, rows).select("id", N.seconds("at").alias("sec"), "t")
    counted = f.select("sec", F.length("t").alias("size"))
    want = {(r.a, r.b): tuple(r) for r in N.measured(N.candidates(N.sketches(f).join(frame(spark, rows).select("id", "at"), "id")), frame(spark, rows)).collect()}
    for block in (4000, 7):
        monkeypatch.setattr(N, "BLOCK_TEXTS", block)
        met = N.meeting(f.select("id", "sec"), counted, 7).collect()
        groups = {}
        for r in met:
            groups.setdefault((r.slot, r.block, r.turn), []).append(r)
        times = dict(f.select("id", "sec").collect())
        seen = [tuple(sorted((x.id, y.id))) for (_, _, turn), g in groups.items() for k, x in enumerate(g) for y in g[:k] if x.mine != y.mine or (x.mine and turn == 0)]
        assert {(a, b) for i, a in enumerate(sorted(times)) for b in sorted(times)[i + 1 :] if abs(times[a] - times[b]) <= 7 * 86400} <= set(seen) and len(seen) == len(set(seen))
        assert max(len(g) for g in groups.values()) < 5 * block and (block < 4000 or len(met) < 2 * len(rows))  # each text goes to two places at most, not to its pairs
        got = N.near_pairs(N.sketched_texts(f), counted, least_bands=1).collect()
        assert {(r.a, r.b): tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_shared_passages():
    rng = random.Random(3)
    common = "".join(rng.choice("abcdef") for _ in range(70))
    a, b = "x" * 10 + common + "y" * 50, "z" * 7 + common
    got = N.shared_passage(a, b)
    assert len(got) == 60 and got in a and got in b
    assert N.shared_passage("abc", "abc") is None and N.shared_passage(None, "a" * 50) is None
    assert N.shared_passage("k" * 25, "k" * 25) == "k" * 20


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        line, old = [0], line
        for j, y in enumerate(b):
            line.append(old[j] + 1 if x == y else max(old[j + 1], line[j]))
    return line[-1]


def test_edit_scripts_are_shortest():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        k = lcs(a, b)
        want = len(a) + len(b) - 2 * k
        got = H.edit_script(a, b, 30)
        assert got[:2] == (len(a) - k, len(b) - k) and (got[2] > 0) == (want > 0) and got[2] <= max(want, 0)
        assert want == 0 or H.edit_script(a, b, want - 1) is None
    assert H.edit_script(list("abxcd"), list("abcyd"), 9) == (1, 1, 2)


def test_common_characters_and_brackets(spark):
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(2))
        x, y = H.common_characters(a, b)
        assert [a[i] for i in sorted(x)] == [b[i] for i in sorted(y)] and len(x) == lcs(a, b)
    got = spark.createDataFrame([("price rises", "prices rise"), (None, "a")], "x string, y string").select(H.headline_diff("x", "y").alias("d")).select("d.*").collect()
    assert got[0].left.replace("[", "").replace("]", "") == "price rises" and got[0].right.replace("[", "").replace("]", "") == "prices rise" and got[1].right == "a"


def test_cosine_pairs_of_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(70)] + [(100, None), (101, [0.0] * 6), (102, [1.0, 2.0])]
    f = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    cosine = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = {(a, b) for a, x in vectors[:70:5] for b, y in vectors[:70] if a != b and cosine(x, y) >= 0.5}
    for size in (7, 2000):
        got = {(r.a, r.b): r.cosine for r in G.cosine_pairs(f.where("vec_id % 5 = 0"), f, 0.5, size).collect()}
        assert set(got) == want and all(abs(c - cosine(vectors[a][1], vectors[b][1])) < 1e-9 for (a, b), c in got.items())
