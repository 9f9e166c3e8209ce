"""Reading the star-schema tables, and the analogue views of tagged articles over them.

Three views stand in for a corpus of tagged articles: *baskets* (orders whose tags are the brands of
their parts), *stream* (events with a key and a type as tags) and *texts* (documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles: article_id, media, published_at, collected_at, section, size, camp."""
    o = table(spark, sf_dir, "orders")
    media = F.col("o_custkey") % 25
    return o.select(
        F.col("o_orderkey").alias("article_id"),
        media.alias("media"),
        F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 10).cast("int"))).alias("collected_at"),
        F.col("o_orderpriority").alias("section"),
        F.col("o_totalprice").alias("size"),
        F.when(media % 3 == 0, "blue").when(media % 3 == 1, "green").otherwise("other").alias("camp"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles, one row per distinct tag: article_id, media, published_at, section, camp, tag.

    A filter on an article's columns reaches the scan of orders and thins out the items before their
    tags are looked up; the distinct rows are found on the partitions of the join.
    """
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("tag"))
    found = articles(spark, sf_dir).select("article_id", "media", "published_at", "section", "camp")
    return found.join(items, "article_id").join(part, "p_partkey").drop("p_partkey").distinct()


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles: article_id, media, published_at, collected_at, section, value, tag."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        (F.col("user_id") % 20).alias("media"),
        F.col("user_id"),
        F.col("ts").alias("published_at"),
        (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))).alias("collected_at"),
        F.col("event_type").alias("section"),
        F.col("value"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("tag"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: article_id, media, published_at, title (first line), body, section."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("media"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") * 10).cast("int"))).alias("published_at"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.col("lang").alias("section"),
    )


#: The same views as SQL table expressions.
ARTICLES_SQL = """articles AS (
  SELECT o_orderkey AS article_id, o_custkey % 25 AS media, o_orderdate AS published_at, o_orderdate + to_days((o_orderkey % 10)::INT) AS collected_at,
    o_orderpriority AS section, o_totalprice AS size, CASE (o_custkey % 25) % 3 WHEN 0 THEN 'blue' WHEN 1 THEN 'green' ELSE 'other' END AS camp FROM orders)"""
BASKETS_SQL = f"""{ARTICLES_SQL},
baskets AS (
  SELECT DISTINCT article_id, media, published_at, section, camp, p_brand AS tag
  FROM articles JOIN lineitem ON l_orderkey = article_id JOIN part ON p_partkey = l_partkey)"""
STREAM_SQL = """stream AS (
  SELECT event_id AS article_id, user_id % 20 AS media, user_id, ts AS published_at, ts + to_hours((event_id % 7)::INT) AS collected_at,
    event_type AS section, value, 'k' || json_extract_string(props, '$.k') AS tag FROM events)"""
TEXTS_SQL = r"""texts AS (
  SELECT doc_id AS article_id, source AS media, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 10)::INT) AS published_at,
    split_part(text, chr(10), 1) AS title, text AS body, lang AS section FROM documents)"""
