"""Centroid clustering against a version that compares every vector with every centroid."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tagloom.llm.annulus import Annuli, cluster_vectors, clusters_sql

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, ids string"


def brute(rows, k, rounds, dims=4, scale=256, salt="2:"):
    kept = []
    for vec_id, x, *_ in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [math.floor(scale * float(np.float32(v))) for v in x]))
    start = sorted(kept, key=lambda r: ("g" if r[0] is None else hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [g for _, g in start]
    near = lambda g: min((sum((a - b) ** 2 for a, b in zip(g, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, g in kept:
            groups.setdefault(near(g)[1], []).append(g)
        for i, gs in groups.items():
            centroids[i] = [sum(v) // len(gs) for v in zip(*gs)]
    found = [(vec_id, *near(g)) for vec_id, g in kept]
    inertia = {i: sum(d for _, d, j in found if j == i) for _, _, i in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, i, d, inertia[i], sum(inertia.values()), digest[i]) for v, d, i in found), key=repr)


def odd_vectors(n=400, dims=4, seed=5):
    rng = random.Random(seed)
    rows = [[i, [rng.gauss(rng.choice([-1, 0, 2]), 0.4) for _ in range(dims)]] for i in range(n)]
    rows += [[n + i, rows[i % 3][1]] for i in range(n // 3)]  # a third holds one of three vectors
    rows += [[n * 2 + i, [float(rng.randint(-1, 1)) for _ in range(dims)]] for i in range(60)]  # ties
    rows += [[5000, None], [5001, []], [5002, [1.0] * (dims - 1)], [5003, [1.0] * (dims + 1)], [5004, [None] + [1.0] * (dims - 1)]]
    rows += [[5005, [math.nan] + [0.0] * (dims - 1)], [5006, [math.inf] + [0.0] * (dims - 1)], [None, [0.5] * dims], [None, [0.5] * dims], [7, [0.0] * dims], [7, [3.0] * dims]]
    return [(i, v, 1, "c", "d", "x") for i, v in rows]


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (7, 3), (1, 2), (3, 0)])
def test_equals_brute_force(spark, k, rounds):
    rows = odd_vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(cluster_vectors(frame, k=k, rounds=rounds, dims=4)) == brute(rows, k, rounds)


def test_sql_says_the_same(spark):
    rows = [r for r in odd_vectors(150) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r[:2]) for r in rows])
    assert sorted(con.execute(clusters_sql(k=9, rounds=3, dims=4)).fetchall(), key=repr) == brute(rows, 9, 3)


def test_few_and_no_vectors(spark):
    rows = odd_vectors(4)[:3]
    assert got(cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=40, rounds=5, dims=4)) == brute(rows, 40, 5)
    assert got(cluster_vectors(spark.createDataFrame(rows[:0], SCHEMA), dims=4)) == []
    assert got(cluster_vectors(spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA), dims=4)) == []


def test_large_components_are_exact_and_larger_ones_refused(spark):
    big = float(1 << 18)
    rows = [(i, [big + i % 5, -big, i / 4, 0.0], 0, "", "", "") for i in range(60)]
    assert got(cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=6, rounds=4, dims=4)) == brute(rows, 6, 4)
    rows += [(99, [float(1 << 20), 0.0, 0.0, 0.0], 0, "", "", "")]
    with pytest.raises(Exception, match="grid steps"):
        cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=6, rounds=1, dims=4).collect()


def test_annulus_leaves_most_centroids_out_and_no_tie():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (3000, 8)) * rng.integers(1, 30, (3000, 1))
    c = np.concatenate([x[:200], x[:3], -x[:200]])  # equal centroids, and pairs of one norm
    full = ((x[:, None, :] - c[None]) ** 2).sum(-1)
    rough, _, _ = Annuli(c).nearest(x)
    number, distance, made = Annuli(c).nearest(x, rough)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert made < 0.5 * full.size
    assert (rough == number).all()
