"""Dense time series, moving averages, histories and vocabularies over tagged articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.ranking import SCALE, media_score

#: Business days are UTC+8 without daylight saving.
OFFSET = "INTERVAL 8 HOURS"


def hour(at: Column) -> Column:
    return F.date_trunc("hour", at).cast("timestamp_ntz")


def local_day(at: Column) -> Column:
    return F.to_date(at + F.expr(OFFSET))


def spine(spark, since: str, until: str, step: str, name: str = "hour") -> DataFrame:
    """One row for each step from ``since`` on, before ``until``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz") - F.expr(f"INTERVAL {step}"), F.expr(f"INTERVAL {step}"))).alias(name))


def dense(rows: DataFrame, hours: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """keys, hour, n with a row for each key and hour of the spine, 0 where nothing was."""
    counts = rows.groupBy(*keys, "hour").agg(F.count(F.lit(1)).alias(name))
    return rows.select(*keys).distinct().crossJoin(F.broadcast(hours)).join(counts, [*keys, "hour"], "left").fillna(0, [name])  # a spine of hours


def moving_average(series: DataFrame, keys: list[str], width: int = 24, value: str = "n") -> Column:
    """The mean of an hour and the ``width - 1`` before it, of which missing ones count 0."""
    frame = Window.partitionBy(*keys).orderBy("hour").rowsBetween(1 - width, 0)
    return F.sum(value).over(frame) / width


def moving_score(series: DataFrame, roster: int, width: int = 24) -> DataFrame:
    """tag, hour, score from tag, media, hour, n: the sum over outlets of the score of the moving 24 h count, normalised."""
    average = series.withColumn("a", moving_average(series, ["tag", "media"], width))
    return average.groupBy("tag", "hour").agg(F.round(F.sum(media_score(F.col("a") * width)) / roster * SCALE, 6).alias("score"))


def histories(rows: DataFrame) -> DataFrame:
    """tag, first_at, last_at, articles, peak_day, peak_count: the earliest of the best local days."""
    days = rows.groupBy("tag", local_day(F.col("published_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("a"), F.max("published_at").alias("z"))
    best = F.struct("n", -F.datediff("day", F.lit("1970-01-01")))
    return days.groupBy("tag").agg(F.min("a").alias("first_at"), F.max("z").alias("last_at"), F.sum("n").alias("articles"), F.max_by("day", best).alias("peak_day"), F.max("n").alias("peak_count"))


def vocabulary(rows: DataFrame, as_of: str) -> DataFrame:
    """tag, n, first_at, last_at and counts of the last 30, 90 and 180 days."""
    age = F.lit(as_of).cast("timestamp_ntz") - F.col("published_at")
    recent = [F.count_if(age <= F.expr(f"INTERVAL {d} DAYS")).alias(f"r{d}") for d in (30, 90, 180)]
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), *recent)
