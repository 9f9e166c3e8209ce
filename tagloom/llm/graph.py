"""Connected components of an edge table by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Stash


#: Rows of two numbers of a table that is sent to all tasks; a larger one is joined by shuffles.
SMALL = 200_000


def components(edges: DataFrame, stash: Stash, rounds: int = 60) -> DataFrame:
    """(id, component) of the ends of ``edges`` (a, b): component is the least id that links reach.

    Each round takes the least label among a node's neighbours and then follows that label once
    more (pointer jumping), so the rounds grow with the logarithm of the diameter. Hubs cost no
    more than their edges: the minimum is pre-aggregated and the joins are split where skewed. Labels of
    at most SMALL nodes are broadcast, so that a round shuffles once.
    """
    both = stash.put(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stash.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    sent = F.broadcast if labels.count() <= SMALL else (lambda frame: frame)
    for _ in range(rounds):
        near = both.join(sent(labels.select(F.col("id").alias("b"), "component")), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(sent(near), "id").select("id", F.least("component", "near").alias("hop"), F.col("component").alias("was"))
        hop = step.select(F.col("id").alias("hop"), F.col("hop").alias("component"))
        jumped = stash.put(step.join(sent(hop), "hop", "left").select("id", F.coalesce("component", "hop").alias("component"), "was"), "labels")
        stash.drop(labels)
        labels = jumped.select("id", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
