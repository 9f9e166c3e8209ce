"""Coverage of events by outlets and camps, shares and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lean(own: Column, other: Column) -> Column:
    """Smoothed log2 ratio of two counts."""
    return F.log2((own + 1) / (other + 1))


def camp_shares(rows: DataFrame, by: str) -> DataFrame:
    """by, camp, outlets, articles, share (percent of the group's outlets), blindspot (under a tenth)."""
    c = rows.groupBy(by, "camp").agg(F.count_distinct("media").alias("outlets"), F.count_distinct("article_id").alias("articles"))
    share = 100 * F.col("outlets") / F.sum("outlets").over(Window.partitionBy(by))
    return c.withColumn("share", F.round(share, 4)).withColumn("blindspot", share < 30)


def whole_percentages(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """Whole percentages that sum to 100: the largest remainders are rounded up (ties by name)."""
    total = F.sum(value).over(Window.partitionBy(by))
    exact = rows.withColumn("_e", 100 * F.col(value) / total).withColumn("_f", F.floor("_e").cast("long"))
    missing = 100 - F.sum("_f").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), name))
    return exact.withColumn("percent", F.col("_f") + (place <= missing).cast("long")).drop("_e", "_f")


def sessions(rows: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    """Rows with the number of their round: a round ends when nothing follows within the gap."""
    order = Window.partitionBy(*by).orderBy(at)
    fresh = F.when(F.col(at) - F.lag(at).over(order) <= F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    return rows.withColumn("_new", fresh).withColumn("round", F.sum("_new").over(order)).drop("_new")


def diverse_pick(rows: DataFrame, by: list[str], outlet: str, order: list[Column], k: int) -> DataFrame:
    """k rows of each group: first one of each outlet, then the rest, each in order."""
    turn = F.row_number().over(Window.partitionBy(*by, outlet).orderBy(*order))
    first = F.least(turn, F.lit(2))
    return rows.withColumn("_turn", first).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_turn", *order)).cast("long")).where(F.col("place") <= k).drop("_turn")
