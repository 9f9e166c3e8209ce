"""Pairs that are found in blocks of rows, against plain Python."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tagloom.operators import events as E
from tagloom.operators import headlines as H
from tagloom.operators import related as RELATED
from tagloom.operators import windows as V


def two(s):
    return {s[i : i + 2] for i in range(len(s) - 1)}


def dice(a, b):
    return 2 * len(two(a) & two(b)) / (len(two(a)) + len(two(b)))


def test_best_pairs_of_headlines(spark, monkeypatch):
    rng = random.Random(2)
    words = ["storm", "hits", "coast", "town", "mayor", "opens", "bridge", "losses", "zoo"]
    rows = [(i, f"e{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.randrange(4), rng.choice(["blue", "green", "other"]), rng.randrange(30)) for i in range(150)]
    rows += [(200, "e0", "", 1, "blue", 3), (201, "e0", None, 1, "green", 3), (202, "lone", "storm", 1, "blue", 1)]
    want = {}
    for event in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == event]
        seed = min(own)
        near = {r[0]: 1.0 if r is seed else dice(r[2], seed[2]) for r in own if r[2] and two(r[2])}
        for a in own:
            for b in own:
                if a[4] == "blue" and b[4] == "green" and a[3] != b[3] and abs(a[5] - b[5]) <= 12 and min(near.get(a[0], 0), near.get(b[0], 0)) >= 0.18 and dice(a[2], b[2]) >= 0.24:
                    key = (round(dice(a[2], b[2]) + near[a[0]] + near[b[0]], 6), a[5], -a[0], -b[0], a[2], b[2])
                    want[event] = max(want.get(event, key), key)
    real = H._best_pair
    for block in (256, 3):
        monkeypatch.setattr(H, "_best_pair", lambda *a, block=block: real(*a, block=block))
        got = H.compared_headlines(spark.createDataFrame(rows, "id long, event string, title string, media long, camp string, hour int")).collect()
        assert {r.event: (round(r.score, 6), r.blue, r.green, r.blue_title, r.green_title) for r in got} == {e: (k[0], -k[2], -k[3], k[4], k[5]) for e, k in want.items()} and len(want) == 3


def test_followers_in_blocks(spark):
    rng, day = random.Random(4), datetime(2024, 1, 1)
    spans = [(rng.randrange(25), rng.choice("ab"), day + timedelta(minutes=m), day + timedelta(minutes=m + rng.randrange(30))) for m in (rng.randrange(3000) for _ in range(300))]
    want = {(x[0], y[0], x[1]) for x in spans for y in spans if x[1] == y[1] and x[0] != y[0] and x[3] < y[2] <= x[3] + timedelta(minutes=20)}
    f = spark.createDataFrame([*spans, (None, "a", day, day), (1, None, day, day)], "user_id long, section string, a timestamp_ntz, z timestamp_ntz")
    for block in (400_000, 40):
        got = [tuple(r) for r in V.followers(f, block=block).collect()]
        assert set(got) == want and len(got) == len(want) > 100


def test_followers_are_told_run_by_run(spark, monkeypatch):
    day = datetime(2024, 1, 1)
    f = spark.createDataFrame([(u, "a", day + timedelta(minutes=5 * (u // 30)), day + timedelta(minutes=5 * (u // 30))) for u in range(120)], "user_id long, section string, a timestamp_ntz, z timestamp_ntz")
    want = {(a, b) for a in range(120) for b in range(120) if a // 30 < b // 30}
    sizes = [len(b) for b in _told_in_runs(f, monkeypatch)]
    assert sum(sizes) == len(want) and max(sizes) < len(want) / 2


def _told_in_runs(f, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "PAIRS", 500)
    rows = f.select("section", F.col("user_id").alias("who"), F.unix_micros(F.col("a").cast("timestamp")).alias("at")).toPandas()
    both = pa.Table.from_pandas(rows.assign(left=True), preserve_index=False), pa.Table.from_pandas(rows.assign(left=False), preserve_index=False)
    return list(V._follow(20 * 60_000_000)(iter(pa.concat_tables(both).to_batches())))


def test_threads_go_on_in_blocks(spark):
    rng, day = random.Random(5), datetime(2024, 1, 12)
    t = []
    for i in range(150):
        first = day + timedelta(hours=rng.randrange(-10, 60))
        t.append((f"t{i}", first, first + timedelta(hours=rng.randrange(20)), rng.sample("abcde", rng.randint(0, 4))))
    now = datetime(2024, 1, 15)
    fresh = [x for x in t if day <= x[2] < now - timedelta(hours=7)]
    want = set()
    for x in fresh:
        for y in fresh:
            hits = len(set(x[3]) & set(y[3]))
            if y[1] >= day and x[1] < y[1] <= x[2] + timedelta(days=1) and hits and (hits >= 3 or hits == len(x[3])):
                want.add((x[0], y[0], hits))
    f = spark.createDataFrame(t, "id string, first_at timestamp_ntz, last_at timestamp_ntz, majors array<string>")
    assert {tuple(r) for r in E.merge_links(f, F.lit(now).cast("timestamp_ntz")).collect()} == want and len(want) > 50
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    told = f.select("id", micros("first_at").alias("first"), micros("last_at").alias("last"), "majors")
    one, few = ({tuple(r) for r in V.going_on(told, told, block=n).collect()} for n in (20_000, 20))
    assert one == few and len(one) > 50


def test_related_articles_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    tags = {i: set(rng.choices("abcdefgh", weights=[8, 7, 6, 5, 4, 3, 2, 1], k=4)) for i in range(120)}
    rows = [(i, i % 6, t) for i, own in tags.items() for t in own]
    df = {t: sum(t in own for own in tags.values()) for t in "abcdefgh"}
    weight = {t: math.log(121 / (df[t] + 1)) for t in df}
    f = spark.createDataFrame(rows, "article_id long, media long, tag string")
    for each in (False, True):
        want = set()
        for a in range(0, 120, 10):
            scores = sorted((-round(sum(weight[t] for t in tags[a] & tags[b]), 6), b) for b in tags if b != a and len(tags[a] & tags[b]) >= 2)
            if each:
                scores = [s for k, s in enumerate(scores) if s[1] % 6 not in {x[1] % 6 for x in scores[:k]}]
            want |= {(a, b, -s) for s, b in scores[:5]}
        for given, others in ((1024, 8192), (5, 11)):
            monkeypatch.setattr(RELATED, "GIVEN", given)
            monkeypatch.setattr(RELATED, "OTHERS", others)
            got = [(r.a, r.b, round(r.score, 6)) for r in RELATED.related(f, "article_id % 10 = 0", each=each).collect()]
            assert set(got) == want and len(got) == len(want) > 30
