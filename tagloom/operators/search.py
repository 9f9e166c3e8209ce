"""Filters, joins, set operations and paging over tables of tagged articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.sources.sinks import settle


def half_open(at: Column, since: str, until: str) -> Column:
    return (at >= F.lit(since).cast("timestamp_ntz")) & (at < F.lit(until).cast("timestamp_ntz"))


def closed(at: Column, since: str, until: str) -> Column:
    return at.between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"))


def text_or_tag(words: list[Column], tags: Column | None, wanted: str) -> Column:
    """A case-insensitive substring of any of ``words``, or exactly one of ``tags``."""
    found = F.lit(False)
    for w in words:
        found = found | F.coalesce(F.contains(F.lower(w), F.lit(wanted.lower())), F.lit(False))
    return found if tags is None else found | F.coalesce(F.array_contains(tags, wanted), F.lit(False))


def all_words(hay: Column, wanted: list[str]) -> Column:
    """Every word occurs, whatever its case."""
    return F.forall(F.array(*[F.lit(w.lower()) for w in wanted]), lambda w: F.contains(F.lower(hay), w))


def keyset_page(rows: DataFrame, after: tuple | None, limit: int, at: str = "published_at", key: str = "article_id") -> DataFrame:
    """The page of ``limit`` rows, newest first, after the cursor (at, key); more: another page follows."""
    if after is not None:
        rows = rows.where((F.col(at) < F.lit(after[0]).cast("timestamp_ntz")) | ((F.col(at) == F.lit(after[0]).cast("timestamp_ntz")) & (F.col(key) < after[1])))
    probe = rows.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)
    order = Window.orderBy(F.desc(at), F.desc(key))
    numbered = probe.withColumn("place", F.row_number().over(order).cast("long"))
    return numbered.withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def capped(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def either_end(pairs: DataFrame, ids: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with an end in ``ids`` (id), as two equi-joins instead of one on a disjunction."""
    return pairs.join(ids.withColumnRenamed("id", a), a, "left_semi").select(*pairs.columns).union(pairs.join(ids.withColumnRenamed("id", b), b, "left_semi").select(*pairs.columns)).distinct()


def co_occurrence(tags: DataFrame) -> DataFrame:
    """a, b, shared for each ordered pair of different tags of one article (article_id, tag, distinct)."""
    return tags.select("article_id", F.col("tag").alias("a")).join(tags.select("article_id", F.col("tag").alias("b")), "article_id").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def holding_all(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """article_id of the articles with every one of the wanted tags (relational division)."""
    return tags.where(F.col("tag").isin(wanted)).groupBy("article_id").agg(F.count_distinct("tag").alias("k")).where(F.col("k") == len(set(wanted))).select("article_id")


def holding_some(tags: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """group_id, article_id, hits where an article has at least ``least`` of the tags of a group (group_id, tag)."""
    return tags.join(groups, "tag").groupBy("group_id", "article_id").agg(F.count_distinct("tag").alias("hits")).where(F.col("hits") >= least)


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (upsert or absent) and the new value, for keys whose value differs between snapshots."""
    both = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was")).join(new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is")), key, "full_outer")
    differ = both.where(F.col("_was").isNull() | F.col("_is").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    return differ.select(key, F.when(F.col("_is").isNull(), "absent").otherwise("upsert").alias("change"), F.col("_new").alias(value))


def last_writer(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """For each key the row with the greatest version."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), version).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merged statistics: least first, greatest last, greatest peak (columns first, last, peak)."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("peak").alias("peak"))


def numbered(rows: DataFrame, *order, name: str) -> DataFrame:
    """Rows with their place from 1 in the whole order: numbered in each range of it, from where the ranges before it end."""
    dealt = settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start")
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, place.cast("long")).drop("_part", "_start")
