"""Event graphs, greedy decisions, threads, stories and communities against plain versions."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tagloom.functions import schedule as T
from tagloom.operators import events as E
from tagloom.operators import headlines as H


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_aliases_are_followed_to_the_end(spark):
    g = [("abcd", "abc", 5, 10, 20), ("abcd", "ab", 9, 10, 30), ("abc", "ab", 6, 10, 30), ("ab", "a", 10, 30, 9), ("xy", "x", 1, 10, 9), ("zab", "ab", 4, 10, 30)]
    got = dict(rows(E.alias_tags(spark.createDataFrame(g, "a string, b string, shared int, na int, nb int"))))
    assert got == {"abcd": "a", "abc": "a", "ab": "a", "zab": "a"}


def test_hubs_and_bridges(spark):
    """Two unrelated pairs reach h; h is written about most with the second. t is equal to tags of both stories."""
    shared = {("a1", "h"): 6, ("a2", "h"): 6, ("b1", "h"): 9, ("b2", "h"): 9, ("a1", "a2"): 5, ("b1", "b2"): 5, ("t", "a1"): 3, ("t", "b1"): 4}
    n = {"a1": 10, "a2": 10, "b1": 10, "b2": 10, "h": 100, "t": 5}
    both = [(x, y, k, n[x], n[y]) for (a, b), k in shared.items() for x, y in ((a, b), (b, a))]
    g = spark.createDataFrame(both, "a string, b string, shared int, na int, nb int")
    equal, together = g.where("shared > 0.5 * na").select("a", "b"), g.where("shared >= 0.5 * least(na, nb)").select("a", "b").where("a <> 'h' and b <> 'h' and a <> 't' and b <> 't'")
    blocks = rows(E.hub_blocks(g, equal, together))
    assert ("a1", "h") in blocks and ("a2", "h") in blocks and ("b1", "h") not in blocks
    assert rows(E.bridge_cuts(g, equal, together)) == [("t", "a1")]


def brute_duplicates(members, scores, share):
    order = sorted(scores, key=lambda e: (-scores[e], e))
    dropped = set()
    for e in reversed(order):
        if not members.get(e):
            continue
        elsewhere = set().union(*[members[o] for o in order if o != e and o not in dropped and members.get(o)] or [set()])
        if len(members[e] & elsewhere) >= share * len(members[e]):
            dropped.add(e)
    return {e for e in order if e not in dropped and members.get(e)}


def test_duplicate_events(spark):
    rng = random.Random(7)
    for _ in range(3):
        members = {f"e{i}": {rng.randrange(60) for _ in range(rng.randint(1, 12))} for i in range(14)}
        scores = {e: float(rng.randrange(6)) for e in members}
        m = spark.createDataFrame([(e, a) for e, s in members.items() for a in s], "event string, article_id int")
        got = E.drop_duplicates(m, spark.createDataFrame(list(scores.items()), "event string, score double"))
        assert {r.event for r in got.collect()} == brute_duplicates(members, scores, 0.5)


def test_first_picks(spark):
    rng = random.Random(8)
    conflicts = {(i, rng.randrange(i)) for i in range(1, 40) for _ in range(2)}
    want = []
    for i in range(40):
        if not any((i, j) in conflicts for j in want):
            want.append(i)
    got = E.first_picks(spark.range(40), spark.createDataFrame(sorted(conflicts), "id long, before long"))
    assert sorted(r.id for r in got.collect()) == want


def test_day_folding(spark):
    t = [(1, 1, 50, ["a", "b"]), (1, 2, 40, ["c", "a", "b"]), (1, 3, 30, ["d", "c"]), (1, 4, 20, ["c"]), (2, 5, 9, ["a"]), (1, 6, 50, [])]
    got = {(r.day, r.lead): (r.weight, r.folded) for r in E.fold_day(spark.createDataFrame(t, "day int, id long, weight long, majors array<string>")).collect()}
    assert got == {(1, 1): (110, [2, 4]), (1, 3): (30, []), (1, 6): (50, []), (2, 5): (9, [])}


def test_thread_links(spark):
    day = datetime(2024, 1, 10)
    at = lambda h: day + timedelta(hours=h)
    t = [(1, at(0), at(5), ["a", "b", "c"]), (2, at(6), at(9), ["a", "b", "c", "d"]), (3, at(20), at(22), ["a", "b"]), (4, at(40), at(41), ["a", "b", "c"]), (5, at(8), at(47), ["a", "b", "c"]), (6, at(1), at(2), ["z"]), (7, at(3), at(4), ["z", "y"])]
    got = rows(E.merge_links(spark.createDataFrame(t, "id long, first_at timestamp_ntz, last_at timestamp_ntz, majors array<string>"), F.lit(at(48)).cast("timestamp_ntz")))
    assert got == [(1, 2, 3), (6, 7, 1)]


def test_stories(spark):
    day = datetime(2024, 1, 1)
    articles = spark.createDataFrame([(i, day + timedelta(minutes=m)) for i, m in ((1, 30), (2, 0), (3, 90), (4, 5), (5, 6))], "id long, at timestamp_ntz")
    pairs = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.9), (4, 5, 0.7)], "a long, b long, score double")
    assert rows(E.stories(pairs, articles)) == [(2, 1, True, 0.6, 30), (2, 3, False, 0.9, 90), (4, 5, True, 0.7, 1)]


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 5) for k in (0, 10) for a in range(k, k + 5) for b in range(k, a)] + [(0, 10, 1), (3, 3, 9)]
    got = dict(rows(E.communities(spark.createDataFrame(edges, "a int, b int, n int"))))
    assert got == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}}
    with pytest.raises(ValueError):
        E.communities(spark.createDataFrame(edges, "a int, b int, n int"), most_nodes=3)


def test_picks_of_headlines(spark):
    r = [(1, "e", "storm hits the coast today", 1, "blue", 9, 3), (2, "e", "storm hits the coast today", 2, "green", 8, 3), (3, "e", "coast towns count storm losses", 3, "green", 7, 2), (4, "e", "unrelated words only", 4, "blue", 9, 2), (5, "e", "after the storm the coast cleans up", 1, "other", 6, 1)]
    frame = spark.createDataFrame(r, "id long, event string, title string, media long, camp string, hour int, hits long")
    got = [(x.camp, x.id) for x in H.camp_picks(frame).orderBy("place").collect()]
    assert got[0] == ("blue", 1) and ("green", 2) not in got and ("green", 3) in got and len({i for _, i in got}) == len(got)
    r = [(1, "e", "storm hits the coast", 1, "blue", 9, 3), (2, "e", "storm hits the coast!", 2, "green", 8, 3), (3, "e", "mayor opens a bridge", 3, "blue", 9, 2), (4, "e", "unlike words", 4, "blue", 7, 2), (5, "e", "quiz night", 1, "other", 6, 1), (6, "e", "zoo born panda", 6, "green", 1, 0)]
    lead = lambda n: [x.id for x in H.lead_picks(spark.createDataFrame(r, frame.schema), n).orderBy("place").collect()]
    assert lead(3) == [1, 3, 6] and lead(4) == [1, 3, 6, 4]


def test_schedules(spark):
    day = datetime(2024, 2, 28, 23, 59)
    minutes = [(day + timedelta(minutes=m),) for m in range(0, 4000, 7)]
    frame = spark.createDataFrame(minutes, "at timestamp_ntz")
    for text, holds in {
        "*/15 * * * *": lambda t: t.minute % 15 == 0, "5-20/5,50 8-18 * * *": lambda t: t.minute in (5, 10, 15, 20, 50) and 8 <= t.hour <= 18,
        "* * 29 * 5": lambda t: t.day == 29 or t.weekday() == 4, "* * * 3 0": lambda t: t.month == 3 and t.weekday() == 6, "* * 1 * *": lambda t: t.day == 1,
    }.items():
        assert [r.at for r in frame.where(T.cron_matches(text, F.col("at"))).orderBy("at").collect()] == [t for (t,) in minutes if holds(t)]
    assert spark.range(1).select(T.next_run("30 3 1 * *", F.lit(day).cast("timestamp_ntz")).alias("n")).first().n == datetime(2024, 3, 1, 3, 30)
    with pytest.raises(ValueError):
        T.cron_matches("61 * * * *", F.col("at"))
