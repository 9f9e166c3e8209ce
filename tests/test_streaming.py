"""Streams over a folder of events give what the batch queries give."""

import pytest
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.sources.tables import stream
from tagloom.streaming import windows as W

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def live(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("live") / "events")
    rows = stream(spark, SF)
    rows.orderBy("published_at").coalesce(1).write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_sliding_counts(spark, live, tmp_path):
    got = W.run_once(W.sliding_counts(live), "sliding", "complete", str(tmp_path))
    w = stream(spark, SF).groupBy(F.window("published_at", "24 hours", "1 hour").alias("w"), "section").agg(F.count(F.lit(1)).alias("n"))
    assert same(got, w.select(F.col("w.start").cast("timestamp").alias("start"), "section", "n"))


def test_first_by_key(spark, live, tmp_path):
    got = W.run_once(W.first_by_key(live.select("published_at", "media", "tag"), ["media", "tag"]), "firsts", "append", str(tmp_path))
    assert got.select("media", "tag").distinct().count() == stream(spark, SF).select("media", "tag").distinct().count() == got.count()


def test_statistics(spark, live, tmp_path):
    got = W.run_once(W.statistics_by_tag(live), "statistics", "update", str(tmp_path))
    h = stream(spark, SF).groupBy("tag", F.date_trunc("hour", "published_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    want = h.groupBy("tag").agg(F.count(F.lit(1)).alias("hours_count"), F.max("n").alias("max_count"))
    assert same(got.select("tag", "hours_count", "max_count"), want)


def test_thread_states(spark, live, tmp_path):
    rows = lambda f: f.select(F.col("user_id").alias("thread"), F.date_trunc("hour", "published_at").alias("hour"), F.col("section").alias("tag"), F.col("value").alias("score"))
    got = W.run_once(W.thread_states(rows(live)), "threads", "update", str(tmp_path))
    want = catalog.queries()["r08_thread_state"](spark, SF).withColumnRenamed("user_id", "thread")
    assert same(got, want)


def test_each_new_text_is_indexed_once(spark, tmp_path):
    folder, done = str(tmp_path / "texts"), []
    frame = spark.createDataFrame([(i, "t") for i in range(5)], "id long, t string")
    read = lambda: spark.readStream.schema(frame.schema).parquet(folder)
    sink = lambda batch, _: done.extend(r.id for r in batch.collect())
    for part in (frame.where("id < 3"), frame.where("id >= 3")):
        part.coalesce(1).write.mode("append").parquet(folder)
        W.index_batches(read(), sink, str(tmp_path / "marker")).awaitTermination()
    assert sorted(done) == list(range(5))
