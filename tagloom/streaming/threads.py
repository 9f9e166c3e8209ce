"""Event threads that live on: hourly events join threads, threads end, go on in later ones, and are forgotten.

A category's threads are keyed state of a stream. Events wait until the watermark has passed their hour, so
late ones come in their place and the outcome doesn't depend on how rows are dealt to batches; timers
move a category from hour to hour. A thread's state is a few sums and its newest hours, not its history,
and goes when the thread has been quiet for FORGOTTEN hours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom.sources.sinks import scratch

#: Fixed values, in hours: a thread takes events so long after its last one, is over after that, and is forgotten; a later one starts a day later at most.
ACTIVE, OVER, FORGOTTEN = 6, 7, 72
#: Newest hours whose tags a thread answers to, how many of them, frequent tags told, common tags of an event and a thread and of two threads.
NEWEST, ANSWERS, FREQUENT, SHARED, CONTINUED = 24, 4, 5, 2, 3
HOUR = 3600

OUT = "kind string, hour long, rank int, thread long, other long, hours long, max_tag string, max_score double, all_tags array<string>, major_tags array<string>"
_STATE = "first long, last long, hours long, max_tag string, max_score double, counts array<struct<tag: string, n: long>>, newest array<struct<hour: long, tags: array<string>, scores: array<double>>>"


@dataclass
class Thread:
    """What is kept of a thread. ``newest`` has its last hours, the latest last; that one isn't in the sums yet, as a later event of the same hour takes its place."""

    first: int
    last: int
    hours: int = 0
    max_tag: str | None = None
    max_score: float = 0.0
    counts: dict[str, int] = field(default_factory=dict)
    newest: list[tuple[int, list[str], list[float]]] = field(default_factory=list)

    def _sums(self) -> tuple[int, str | None, float, dict[str, int]]:
        """The sums with the latest hour in them."""
        _, tags, scores = self.newest[-1]
        tag, score, counts = self.max_tag, self.max_score, dict(self.counts)
        for t, s in zip(tags, scores):
            if s > score and len(t.encode()) > 1:
                tag, score = t, s
            counts[t] = counts.get(t, 0) + 1
        return self.hours + 1, tag, score, counts

    def add(self, hour: int, tags: list[str], scores: list[float]) -> None:
        if self.newest and self.newest[-1][0] == hour:
            self.newest.pop()
        elif self.newest:
            self.hours, self.max_tag, self.max_score, self.counts = self._sums()
        self.last = hour
        self.newest = [*self.newest[-(NEWEST - 1) :], (hour, tags, scores)]

    def answers(self) -> list[str]:
        return list(dict.fromkeys(t for _, tags, _ in reversed(self.newest) for t in tags))[:ANSWERS]

    def told(self) -> dict:
        hours, tag, score, counts = self._sums()
        return {"hours": hours, "max_tag": tag, "max_score": score, "all_tags": self.answers(), "major_tags": sorted(counts, key=lambda t: -counts[t])[:FREQUENT]}

    def row(self) -> tuple:
        return (self.first, self.last, self.hours, self.max_tag, float(self.max_score), [tuple(x) for x in self.counts.items()], [(h, [*t], [float(x) for x in s]) for h, t, s in self.newest])

    @classmethod
    def of(cls, row: tuple) -> Thread:
        first, last, hours, tag, score, counts, newest = row
        return cls(first, last, hours, tag, score, {t: n for t, n in counts}, [(h, list(t), list(s)) for h, t, s in newest])


def _day_after(last: int) -> int:
    """The end of the next day, UTC+8, by the UTC day of ``last`` a day on."""
    day = datetime.fromtimestamp(last + 24 * HOUR, timezone.utc).replace(hour=15, minute=59, second=59)
    return int(day.timestamp())


class Category:
    """The threads of a category at an hour."""

    def __init__(self, threads: dict[int, Thread], links: set[tuple[int, int]], made: int) -> None:
        self.threads, self.links, self.made = threads, links, made
        self.touched: set[int] = set()

    def event(self, hour: int, rank: int, tags: list[str], scores: list[float]) -> Iterator[dict]:
        """An event joins the active thread with the most of its tags (at least SHARED; then the most recent, then the older one), or starts one."""
        if len(tags) < SHARED:
            return
        hits = [(-sum(t in th.answers() for t in tags), -th.last, i) for i, th in self.threads.items() if th.last >= hour - ACTIVE * HOUR]
        best = min(hits, default=(0, 0, 0))
        if best[0] <= -SHARED:
            i, kind = best[2], "event"
        else:
            i, kind, self.made = self.made + 1, "start", self.made + 1
            self.threads[i] = Thread(hour, hour)
        self.threads[i].add(hour, tags, scores)
        self.touched.add(i)
        yield {"kind": kind, "hour": hour, "rank": rank, "thread": i} | self.threads[i].told()

    def tick(self, now: int) -> Iterator[dict]:
        """At the end of an hour: threads that are over go on in others, and forgotten ones go."""
        for i in [i for i, th in sorted(self.threads.items()) if th.last < now - FORGOTTEN * HOUR]:
            yield {"kind": "end", "hour": now, "thread": i} | self.threads.pop(i).told()
            self.touched.add(i)
            self.links = {x for x in self.links if i not in x}
        over = {i: th for i, th in sorted(self.threads.items()) if th.last < now - OVER * HOUR}
        recent = {i: th for i, th in over.items() if th.first >= now - FORGOTTEN * HOUR}
        majors = {i: th.told()["major_tags"] for i, th in over.items()}
        for i, a in over.items():
            for j, b in recent.items():
                if i != j and (i, j) not in self.links and a.first < b.first <= _day_after(a.last):
                    common = len(set(majors[i]) & set(majors[j]))
                    if common >= CONTINUED or common == len(majors[i]):
                        self.links.add((i, j))
                        yield {"kind": "link", "hour": now, "thread": i, "other": j}


def advance(category: Category, pending: dict[int, list[tuple]], start: int, stop: int) -> Iterator[dict]:
    """The rows of all hours from ``start`` that end by ``stop``; hours without threads and events cost nothing."""
    hour = start
    while hour + HOUR <= stop:
        if not category.threads:
            later = [h for h in pending if h >= hour]
            if not later or min(later) + HOUR > stop:
                return
            hour = min(later)
        for rank, tags, scores in sorted(pending.pop(hour, [])):
            yield from category.event(hour, rank, tags, scores)
        yield from category.tick(hour + HOUR)
        hour += HOUR


_COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]


def _frame(key: object, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"category": pd.Series([key] * len(rows), dtype=object)} | {c: pd.Series([r.get(c) for r in rows], dtype=object if "tag" in c or c == "kind" else None) for c in _COLUMNS})


class LiveThreads(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "hour long", "events array<struct<rank: int, tags: array<string>, scores: array<double>>>")
        self.threads = handle.getMapState("threads", "thread long", _STATE)
        self.links = handle.getMapState("links", "a long, b long", "hour long")
        self.clock = handle.getValueState("clock", "hour long, made long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.clock.get()[0] if self.clock.exists() else None
        for frame in rows:
            seconds = frame["hour"].map(lambda t: int(t.timestamp()) if t.tzinfo else int(t.tz_localize("UTC").timestamp()))
            for hour, part in frame.assign(hour=seconds).groupby("hour"):
                hour = int(hour)
                if done is not None and hour < done:
                    continue  # its hour has been told
                had = list(self.pending.getValue((hour,))[0]) if self.pending.containsKey((hour,)) else []
                new = [(int(r), [*t], [float(x) for x in s]) for r, t, s in zip(part["rank"], part["tags"], part["scores"])]
                self.pending.updateValue((hour,), ([(x[0], list(x[1]), list(x[2])) for x in had] + new,))
                self.handle.registerTimer((hour + HOUR) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stop = timerValues.getCurrentWatermarkInMs() // 1000
        pending = {k[0]: [(x[0], list(x[1]), list(x[2])) for x in v[0]] for k, v in self.pending.iterator()}
        done, made = self.clock.get() if self.clock.exists() else (min(pending, default=0), 0)
        if done + HOUR > stop:
            return
        threads = {k[0]: Thread.of(v) for k, v in self.threads.iterator()}
        category = Category(threads, {(k[0], k[1]) for k in self.links.keys()}, made)
        hours, links = set(pending), set(category.links)
        rows = list(advance(category, pending, done, stop))
        for hour in hours - pending.keys():
            self.pending.removeKey((hour,))
        for i in category.touched:
            if i in category.threads:
                self.threads.updateValue((i,), category.threads[i].row())
            elif self.threads.containsKey((i,)):
                self.threads.removeKey((i,))
        for a, b in links - category.links:
            self.links.removeKey((a, b))
        for a, b in category.links - links:
            self.links.updateValue((a, b), (stop,))
        at = stop - stop % HOUR
        self.clock.update((at, category.made))
        if category.threads:
            self.handle.registerTimer((at + HOUR) * 1000)
        if rows:
            yield _frame(key[0], rows)

    def close(self) -> None:
        pass


def live_threads(events: DataFrame, lateness: str = "3 hours") -> DataFrame:
    """What becomes of a stream of hourly events (category, hour, rank, tags, scores): a row for each.

    kind is *start* or *event* (the event of ``rank`` started or joined ``thread``, whose sums follow),
    *link* (thread goes on in ``other``) or *end* (it is forgotten). hour is in seconds since 1970: of
    the event, or the end of the hour in which the rest happened. Rows come when the watermark, ``lateness``
    behind the latest hour, has passed their hour; later rows are left out. Events with fewer than two tags start nothing.
    """
    rows = events.select(F.col("category").cast("string").alias("category"), F.col("hour").cast("timestamp").alias("hour"), F.col("rank").cast("int").alias("rank"), "tags", F.col("scores").cast("array<double>").alias("scores"))
    rows = rows.where("category IS NOT NULL AND hour IS NOT NULL AND tags IS NOT NULL AND size(tags) = size(scores)").withWatermark("hour", lateness)
    return rows.groupBy("category").transformWithStateInPandas(LiveThreads(), f"category string, {OUT}", "append", "eventTime")


def run_live_threads(events: DataFrame, lateness: str = "3 hours", files: int = 4) -> DataFrame:
    """``live_threads`` over a table of hourly events, as a stream reads it: ``files`` files by time. Hours that end after the latest one less ``lateness`` are still open."""
    spark, place = events.sparkSession, scratch(events.sparkSession)
    events.repartitionByRange(files, "hour").sortWithinPartitions("hour").write.parquet(f"{place}/events")
    provider, had = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        rows = live_threads(spark.readStream.schema(events.schema).parquet(f"{place}/events"), lateness)
        rows.writeStream.format("parquet").option("path", f"{place}/threads").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, had)
    return spark.read.schema(rows.schema).parquet(f"{place}/threads")
