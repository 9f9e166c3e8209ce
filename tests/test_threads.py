"""Live threads: a stream with late rows, a restart and forgotten threads equals a plain version that keeps all history."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tagloom.streaming import threads as T

START = datetime(2024, 1, 1)
SCHEMA = "category string, hour timestamp_ntz, rank int, tags array<string>, scores array<double>"


def make(hours=24 * 9, seed=2):
    """Stories that run for hours, pause, come back under changed tags, and stop for good."""
    rng, rows = random.Random(seed), []
    for category in ("news", "sport"):
        stories = [[f"{category}{i}{j}" for j in range(6)] for i in range(7)]
        for h in range(hours):
            if category == "sport" and 80 <= h < 170:
                continue  # everything is forgotten in between
            told = [s for i, s in enumerate(stories) if (h // (5 + 3 * i)) % 3 != 2]
            for rank, s in enumerate(rng.sample(told, min(len(told), 4))):
                tags = rng.sample(s[(h // 40) % 3 : (h // 40) % 3 + 4], rng.choice([1, 2, 3, 3])) + ["x"] * (rng.random() < 0.1)
                rows.append((category, START + timedelta(hours=h), rank, tags, [round(rng.random() * 9, 3) for _ in tags]))
    return rows


def plain(rows, stop):
    """The same by the rules, hour by hour, with all of a thread's history."""
    out = []
    for category in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == category]
        threads, links, n, hour = {}, set(), 0, min(r[1] for r in mine)
        stats = lambda th: _stats(th["history"])
        while hour + timedelta(hours=1) <= stop:
            for _, _, rank, tags, scores in sorted((r for r in mine if r[1] == hour), key=lambda r: r[2:]):
                if len(tags) < 2:
                    continue
                best, hits = None, 1
                for i, th in threads.items():
                    if th["last"] < hour - timedelta(hours=6):
                        continue
                    k = sum(t in stats(th)["all_tags"] for t in tags)
                    if k > hits or k == hits and best and th["last"] > threads[best]["last"]:
                        best, hits = i, k
                kind = "event"
                if best is None:
                    n, kind = n + 1, "start"
                    best = n
                    threads[n] = {"first": hour, "last": hour, "history": {}}
                threads[best]["last"] = hour
                threads[best]["history"][hour] = list(zip(tags, scores))
                out.append((category, kind, hour, rank, best, None, stats(threads[best])))
            now = hour + timedelta(hours=1)
            for i in [i for i, th in threads.items() if th["last"] < now - timedelta(days=3)]:
                out.append((category, "end", now, None, i, None, stats(threads.pop(i))))
                links = {x for x in links if i not in x}
            for i, a in threads.items():
                for j, b in threads.items():
                    limit = (a["last"] + timedelta(days=1)).replace(hour=15, minute=59, second=59)
                    over = a["last"] < now - timedelta(hours=7) and b["last"] < now - timedelta(hours=7)
                    if i != j and (i, j) not in links and over and b["first"] >= now - timedelta(days=3) and a["first"] < b["first"] <= limit:
                        x, y = stats(a)["major_tags"], stats(b)["major_tags"]
                        common = len([t for t in y if t in x])
                        if common >= 3 or common == len(x):
                            links.add((i, j))
                            out.append((category, "link", now, None, i, j, None))
            hour = now
    return out


def _stats(history):
    newest = sorted(history, reverse=True)[:24]
    every = list(dict.fromkeys(t for h in newest for t, _ in history[h]))[:4]
    tag, score, count = None, 0.0, {}
    for h in history:
        for t, s in history[h]:
            if s > score and len(t.encode()) > 1:
                tag, score = t, s
            count[t] = count.get(t, 0) + 1
    return {"hours": len(history), "max_tag": tag, "max_score": score, "all_tags": every, "major_tags": sorted(count, key=lambda t: -count[t])[:5]}


def key(row):
    return tuple(str(x) for x in row)


def wanted(rows, stop):
    seconds = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp())
    return sorted(((c, k, seconds(h), r, i, j, *(s or {}).values()) if s else (c, k, seconds(h), r, i, j, None, None, None, None, None) for c, k, h, r, i, j, s in plain(rows, stop)), key=key)


def told(frame):
    return sorted(((r.category, r.kind, r.hour, r["rank"], r.thread, r.other, r.hours, r.max_tag, r.max_score, r.all_tags, r.major_tags) for r in frame.collect()), key=key)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def run(spark, folder, place):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = T.live_threads(stream).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def test_plain_sums_equal_those_of_the_whole_history():
    rows = make()
    for category in ("news", "sport"):
        mine = [r for r in rows if r[0] == category]
        seconds = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp())
        pending = {}
        for _, h, rank, tags, scores in mine:
            pending.setdefault(seconds(h), []).append((rank, tags, scores))
        stop = START + timedelta(hours=24 * 14)
        got = T.advance(T.Category({}, set(), 0), pending, min(pending), seconds(stop))
        got = sorted(((category, *(r.get(c) for c in T._COLUMNS[:5]), *(r.get(c) for c in T._COLUMNS[5:])) for r in got), key=key)
        want = wanted(mine, stop)
        assert got == want
        assert {"start", "event", "link", "end"} == {r[1] for r in got}


def test_stream_with_late_rows_and_a_restart(rocks, tmp_path):
    rows = make(24 * 6)
    folder = str(tmp_path / "events")
    rng = random.Random(4)
    late = [r for r in rows if rng.random() < 0.2]  # up to two hours late
    order = sorted(rows, key=lambda r: (r[1] + timedelta(hours=2 * (r in late)), r))
    cuts = [0, len(order) // 5, len(order) // 2, len(order)]
    for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
        part = rocks.createDataFrame(order[a:z], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
        got = run(rocks, folder, tmp_path)  # each run is a restart from the checkpoint
        stop = max(r[1] for r in order[:z]) - timedelta(hours=3)
        stop = stop.replace(minute=0)
        want = wanted(order[:z], stop)
        have = told(got)
        assert [r for r in have if r not in want] == []
        if i == len(cuts) - 2:
            assert have == want
    # rows far behind the watermark change nothing
    rocks.createDataFrame([("news", START, 0, ["a", "b"], [1.0, 2.0])], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert told(run(rocks, folder, tmp_path)) == have


def test_odd_rows(rocks, tmp_path):
    end = START + timedelta(days=2)
    rows = [(None, START, 0, ["a", "b"], [1.0, 2.0]), ("n", None, 0, ["a", "b"], [1.0, 2.0]), ("n", START, 0, None, None), ("n", START, 0, [], []), ("n", START, 0, ["a"], [1.0]), ("n", START, 1, ["a", "b"], [1.0]), ("n", START, 2, ["a", "b"], [1.0, 2.0]), ("n", START, 2, ["a", "b"], [1.0, 2.0]), ("n", end, 0, ["z"], [0.0])]
    rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events"))
    got = told(run(rocks, str(tmp_path / "events"), tmp_path))
    assert [(r[1], r[3], r[4]) for r in got] == [("event", 2, 1), ("start", 2, 1)]
