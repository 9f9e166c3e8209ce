"""Tag ranking: counts by tag and outlet, geometric decay within an outlet, bursts over several horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Horizons of the burst and their weights.
BURST = {3: 0.92, 6: 0.84, 12: 0.7, 24: 0.5, 48: 0.25}
SCALE = 50


def media_score(n: Column) -> Column:
    """What n articles of one outlet add to a tag: 1 + 1/2 + 1/4 ... = 2 (1 - 0.5^n)."""
    return 2 * (1 - F.pow(F.lit(0.5), n))


def summed(values: Column) -> Column:
    """The sum of a group's numbers from the least to the greatest: the same for the same numbers, in whatever order they come."""
    return F.aggregate(F.array_sort(F.collect_list(values)), F.lit(0.0), lambda total, x: total + x)


def media_counts(articles: DataFrame, *by: str) -> DataFrame:
    """tag, media, n for exploded articles (tag, media), for each value of ``by``."""
    return articles.groupBy(*by, "tag", "media").agg(F.count(F.lit(1)).alias("n"))


def tag_scores(articles: DataFrame, *by: str) -> DataFrame:
    """tag, score, count, outlets for each value of ``by``."""
    return media_counts(articles, *by).groupBy(*by, "tag").agg(F.sum(media_score(F.col("n"))).alias("score"), F.sum("n").alias("count"), F.count(F.lit(1)).alias("outlets"))


def rank_tags(articles: DataFrame, top: int = 500) -> DataFrame:
    """tag, score, count, outlets, rank of the ``top`` tags by score; equal scores stand in byte order of the tag."""
    scored = tag_scores(articles).withColumn("score", F.round("score", 6))
    best = scored.orderBy(F.desc("score"), "tag").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tag")).cast("long"))


def charts_at_lags(articles: DataFrame, as_of: str, days: int, top: int, lags: tuple[int, ...] = (0, *BURST)) -> DataFrame:
    """lag, tag, norm, count, rank, weight, full of the charts that end ``lag`` days before ``as_of``.

    One scan serves all charts: an article joins each window that holds it. norm is the score for an
    outlet, times SCALE; full says that the chart has more tags than are kept.
    """
    age = F.lit(as_of).cast("timestamp_ntz") - F.col("published_at")
    hits = [F.when((age > F.make_dt_interval(days=F.lit(h))) & (age <= F.make_dt_interval(days=F.lit(h + days))), F.lit(h)) for h in lags]
    first = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(max(lags) + days))
    inside = articles.where((F.col("published_at") >= first) & (F.col("published_at") < F.lit(as_of).cast("timestamp_ntz")))
    counts = media_counts(inside.withColumn("lag", F.explode(F.array_compact(F.array(*hits)))), "lag")
    sizes = counts.groupBy("lag").agg(F.count_distinct("media").alias("weight"), F.count_distinct("tag").alias("tags"))
    scored = counts.groupBy("lag", "tag").agg(summed(media_score(F.col("n"))).alias("score"), F.sum("n").alias("count"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lag").orderBy(F.desc("score"), "tag")).cast("long")).where(F.col("rank") <= top)
    told = ranked.join(F.broadcast(sizes), "lag")  # a row for each lag
    return told.select("lag", "tag", (F.col("score") / F.col("weight") * SCALE).alias("norm"), "count", "rank", "weight", (F.col("tags") > top).alias("full"))


def burst(charts: DataFrame) -> DataFrame:
    """tag, norm, burst: norm + sum of w_h (norm - norm h days before), for the tags of lag 0.

    A tag absent from an earlier chart counts 0 there, or the least norm of the chart if that was cut
    off. Without an earlier chart at all the burst is unknown (null). The charts, which are short, are
    read once into one row of arrays.
    """
    whole = charts.agg(F.collect_list(F.struct("lag", "tag", "norm", "full")).alias("c"))
    at = lambda h: F.filter("c", lambda x: x["lag"] == h)
    past = [F.struct(F.map_from_entries(F.transform(at(h), lambda x: F.struct(x["tag"], x["norm"]))).alias("was"), F.when(F.exists(at(h), lambda x: x["full"]), F.array_min(F.transform(at(h), lambda x: x["norm"]))).otherwise(0.0).alias("floor")).alias(f"h{h}") for h in BURST]
    now = whole.select("c", *past).select(F.explode(at(0)).alias("now"), *[f"h{h}" for h in BURST])
    steps = [F.when(F.size(f"h{h}.was") > 0, w * (F.col("now.norm") - F.coalesce(F.try_element_at(F.col(f"h{h}.was"), F.col("now.tag")), F.col(f"h{h}.floor")))) for h, w in BURST.items()]
    return now.select("now.tag", "now.norm", sum(steps, F.col("now.norm")).alias("burst"))


def early_gate(n: str = "n") -> Column:
    """At least two outlets with two articles each (an aggregate over outlets)."""
    return F.count_if(F.col(n) >= 2) >= 2


def broad_gate(n: str = "n") -> Column:
    """At least three outlets, two of them with two articles and one with three."""
    return (F.count(n) >= 3) & (F.count_if(F.col(n) >= 2) >= 2) & (F.max(n) >= 3)


def pool(articles: DataFrame, gate: Column, top: int = 100) -> DataFrame:
    """Window pool: tag, tag_id, score, count, outlets, rank of the tags that pass the gate."""
    scored = media_counts(articles.select("article_id", "media", "tag").distinct()).groupBy("tag").agg(
        F.round(F.sum(media_score(F.col("n"))), 6).alias("score"), F.sum("n").alias("count"), F.count(F.lit(1)).alias("outlets"), gate.alias("pass")
    )
    best = scored.where("pass").drop("pass").orderBy(F.desc("score"), "tag").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tag")).cast("long")).withColumn("tag_id", F.sha2("tag", 256))
