"""Structured Streaming versions of the windowed and stateful operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(articles: DataFrame, lateness: str) -> DataFrame:
    """Watermarks need timestamps; times without a zone are UTC."""
    return articles.withColumn("published_at", F.col("published_at").cast("timestamp")).withWatermark("published_at", lateness)


def sliding_counts(articles: DataFrame, length: str = "24 hours", slide: str = "1 hour", lateness: str = "7 days") -> DataFrame:
    """start, section, n over sliding windows of event time; rows later than ``lateness`` are left out."""
    w = _timed(articles, lateness).groupBy(F.window("published_at", length, slide).alias("w"), "section").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "section", "n")


def sessions_by_gap(articles: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """user_id, start, stop, n of runs of a user's events without a pause of ``gap``."""
    s = _timed(articles, lateness).groupBy(F.session_window("published_at", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def first_by_key(articles: DataFrame, keys: list[str], lateness: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(articles, lateness).dropDuplicatesWithinWatermark(keys)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, hours, best = state.get if state.exists else (None, None, 0, 0)
    seen: dict[pd.Timestamp, int] = {}
    for rows in batches:
        for hour, n in rows.groupby("hour").size().items():
            seen[hour] = seen.get(hour, 0) + int(n)
    for hour in sorted(seen):
        h = hour.value // 3_600_000_000_000
        hours += last is None or h > last
        first, last, best = h if first is None else min(first, h), h if last is None else max(last, h), max(best, seen[hour])
    state.update((first, last, int(hours), best))
    yield pd.DataFrame({"tag": [key[0]], "first_hour": [first], "last_hour": [last], "hours_count": [int(hours)], "max_count": [best]})


def statistics_by_tag(articles: DataFrame) -> DataFrame:
    """A running record for each tag: first and last hour (hours since 1970), hours counted once, best hour.

    An hour counts when it is later than the last one, so that a rerun of the same hour changes nothing.
    """
    rows = articles.select("tag", F.date_trunc("hour", "published_at").cast("timestamp").alias("hour"))
    return rows.groupBy("tag").applyInPandasWithState(_fold, "tag string, first_hour long, last_hour long, hours_count long, max_count long", "first long, last long, hours long, best long", "update", GroupStateTimeout.NoTimeout)


#: A thread keeps so many of its newest hours.
KEPT_HOURS = 24 * 60


def _thread(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    history: dict[str, dict[str, float]] = json.loads(state.get[0]) if state.exists else {}
    for rows in batches:
        for hour, tag, score in zip(rows["hour"].dt.strftime("%Y-%m-%d %H"), rows["tag"], rows["score"]):
            of = history.setdefault(hour, {})
            of[tag] = max(float(score), of.get(tag, float("-inf")))
    newest = sorted(history, reverse=True)
    history = {h: history[h] for h in newest[:KEPT_HOURS]}
    state.update((json.dumps(history),))
    tags = list(dict.fromkeys(t for h in newest[:24] for t in sorted(history[h])))[:4]
    count: dict[str, int] = {}
    for of in history.values():
        for t in of:
            count[t] = count.get(t, 0) + 1
    major = sorted(count, key=lambda t: (-count[t], t))[:5]
    best = min((-s, h, t) for h, of in history.items() for t, s in of.items())
    yield pd.DataFrame({"thread": [key[0]], "hours": [len(history)], "max_score": [-best[0]], "max_tag": [best[2]], "all_tags": [",".join(tags)], "major_tags": [",".join(major)]})


def thread_states(rows: DataFrame) -> DataFrame:
    """What each thread holds after every batch of rows (thread, hour, tag, score): hours, best score and its tag, the tags of its newest
    24 hours (four at most) and its most frequent ones (five at most). An hour's tag counts by its best score."""
    flat = rows.select("thread", F.col("hour").cast("timestamp").alias("hour"), "tag", F.col("score").cast("double").alias("score"))
    schema = "thread long, hours long, max_score double, max_tag string, all_tags string, major_tags string"
    return flat.groupBy("thread").applyInPandasWithState(_thread, schema, "history string", "update", GroupStateTimeout.NoTimeout)


def index_batches(texts: DataFrame, sink, checkpoint: str):
    """Runs ``sink(batch, batch_id)`` over each micro-batch of new texts once (the checkpoint is the marker of what is done) and returns the query."""
    return texts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(frame: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now, into a memory table (for tests and small results)."""
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)
