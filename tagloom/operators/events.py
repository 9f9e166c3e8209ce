"""Event clusters from tag graphs, and the threads, stories and picks made of them.

Graphs here are tables over tags: equal edges (a, b), pairs written about together, counts. What
depends on an order is decided in rounds of joins: a row waits until all rows before it that it
conflicts with are decided, so the rounds follow the longest chain of conflicts and not the rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.graphs import components
from tagloom.operators.windows import going_on
from tagloom.sources.sinks import settle


def alias_tags(graph: DataFrame, share: float = 0.3) -> DataFrame:
    """tag, canonical: the longest shorter tag that it contains and that ``share`` of its articles carry, followed to the end."""
    fits = F.contains("a", "b") & (F.length("b") < F.length("a")) & (F.col("shared") >= share * F.col("na"))
    best = graph.where(fits).groupBy(F.col("a").alias("tag")).agg(F.max_by("b", F.struct(F.length("b"), "b")).alias("canonical"))
    found = settle(best)
    while True:  # each round halves the chains
        jumped = settle(found.join(found.select(F.col("tag").alias("canonical"), F.col("canonical").alias("next")), "canonical", "left").select("tag", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved")))
        found = jumped.select("tag", "canonical")
        if jumped.where("moved").isEmpty():
            return found


def closures(edges: DataFrame, blocked: DataFrame | None = None, rounds: int = 50) -> DataFrame:
    """root, node for each node that directed edges (a, b) reach from a root other than itself, not through ``blocked`` (root, node)."""
    bar = (lambda x: x) if blocked is None else (lambda x: x.join(blocked, ["root", "node"], "left_anti"))
    seen = front = settle(bar(edges.select(F.col("a").alias("root"), F.col("b").alias("node")).distinct()))
    for _ in range(rounds):
        step = front.join(edges, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        front = settle(bar(step.join(seen, ["root", "node"], "left_anti")))
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    return seen.where("root <> node")


def story_groups(sets: DataFrame, together: DataFrame) -> DataFrame:
    """owner, tag, grp: the tags of each owner's set (owner, tag) grouped by the undirected edges ``together`` (a, b) among them."""
    x, y = sets.toDF("owner", "a"), sets.toDF("owner", "b")
    name = lambda c: F.concat_ws("\u0001", "owner", c)
    links = together.join(x, "a").join(y, ["owner", "b"]).select(name("a").alias("a"), name("b").alias("b"))
    own = sets.select("owner", "tag", name("tag").alias("id"))
    return own.join(components(links), "id", "left").select("owner", "tag", F.coalesce("component", "id").alias("grp"))


def away_from_home(groups: DataFrame, graph: DataFrame) -> DataFrame:
    """owner, tag of the tags outside the group that shares the most articles with the owner (ties: the least group), of owners with two groups or more."""
    weights = groups.join(graph.select(F.col("a").alias("owner"), F.col("b").alias("tag"), "shared"), ["owner", "tag"], "left").groupBy("owner", "grp").agg(F.sum(F.coalesce("shared", F.lit(0))).alias("weight"))
    order = Window.partitionBy("owner").orderBy(F.desc("weight"), "grp")
    others = weights.withColumn("place", F.row_number().over(order)).where("place > 1").select("owner", "grp")
    return groups.join(others, ["owner", "grp"]).select("owner", "tag")


def hub_blocks(graph: DataFrame, equal: DataFrame, together: DataFrame) -> DataFrame:
    """root, node: hubs that a tag may not reach, as it isn't of the hub's home group among those that reach it."""
    callers = closures(equal).select(F.col("node").alias("owner"), F.col("root").alias("tag"))
    shared = callers.join(callers.groupBy("owner").count().where("count > 1"), "owner", "left_semi")
    return away_from_home(story_groups(shared, together), graph).select(F.col("tag").alias("root"), F.col("owner").alias("node"))


def bridge_cuts(graph: DataFrame, equal: DataFrame, together: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """root, node: equal tags that a bridge between unrelated stories gives up, all but those of its home side."""
    near = equal.select(F.col("a").alias("owner"), F.col("b").alias("tag"))
    if blocked is not None:
        near = near.join(blocked.toDF("owner", "tag"), ["owner", "tag"], "left_anti")
    return away_from_home(story_groups(near, together), graph).select(F.col("owner").alias("root"), F.col("tag").alias("node"))


def clusters(graph: DataFrame, share: float = 0.5, together_share: float = 0.2) -> DataFrame:
    """tag, event: tags joined by what each reaches without hubs of other homes and cut bridges; event is the least tag."""
    equal = settle(graph.where(F.col("shared") > share * F.col("na")).select("a", "b"))
    together = settle(graph.where(F.col("shared") >= together_share * F.least("na", "nb")).select("a", "b"))
    hubs = settle(hub_blocks(graph, equal, together))
    blocked = settle(hubs.unionByName(bridge_cuts(graph, equal, together, hubs)).distinct())
    reach = closures(equal, blocked)
    return components(reach.select(F.col("root").alias("a"), F.col("node").alias("b"))).select(F.col("id").alias("tag"), F.col("component").alias("event"))


def event_members(tags: DataFrame, events: DataFrame, least: int = 2) -> DataFrame:
    """event, article_id, hits of the articles (article_id, tag) with at least ``least`` tags of an event (tag, event)."""
    return tags.join(events, "tag").groupBy("event", "article_id").agg(F.count_distinct("tag").alias("hits")).where(F.col("hits") >= least)


def drop_duplicates(members: DataFrame, scores: DataFrame, share: float = 0.5) -> DataFrame:
    """event of those that stay: tested from the lowest score up, an event goes if ``share`` of its articles are in other events that are still there.

    members: event, article_id; scores: event, score (ties: the greater name is tested first).
    """
    order = F.struct(-F.col("score"), "event")
    state = settle(scores.join(members.select("event").distinct(), "event", "left_semi").select("event", order.alias("rank"), F.lit(None).cast("boolean").alias("stays")))
    members = settle(members.select("event", "article_id").distinct())
    x, y = members.toDF("event", "article_id"), members.toDF("other", "article_id")
    after = settle(x.join(y, "article_id").where("event <> other").select("event", "other").distinct().join(state.select("event", "rank"), "event").join(state.select(F.col("event").alias("other"), F.col("rank").alias("other_rank")), "other").where("other_rank > rank").select("event", "other"))
    size = members.groupBy("event").agg(F.count(F.lit(1)).alias("size"))
    while not state.where("stays is null").isEmpty():
        waiting = after.join(state.where("stays is null").select(F.col("event").alias("other")), "other", "left_semi").select("event").distinct()
        ready = state.where("stays is null").select("event").join(waiting, "event", "left_anti")
        there = members.join(state.where("coalesce(stays, true)").select("event"), "event", "left_semi").select(F.col("event").alias("other"), "article_id")
        inside = members.join(ready, "event", "left_semi").join(there, "article_id").where("event <> other").groupBy("event").agg(F.count_distinct("article_id").alias("inside"))
        verdict = ready.join(size, "event").join(inside, "event", "left").select("event", (F.coalesce("inside", F.lit(0)) < share * F.col("size")).alias("now"))
        state = settle(state.join(verdict, "event", "left").select("event", "rank", F.coalesce("stays", "now").alias("stays")))
    return state.where("stays").select("event")


def first_picks(order: DataFrame, conflicts: DataFrame) -> DataFrame:
    """id of the greedy picks: a row (id) is picked if no row before it that it conflicts with (id, before) is."""
    state = settle(order.select("id", F.lit(None).cast("boolean").alias("picked")))
    conflicts = settle(conflicts.select("id", "before").distinct())
    while not state.where("picked is null").isEmpty():
        open_rows = state.where("picked is null").select("id")
        of = conflicts.join(open_rows, "id", "left_semi").join(state.select(F.col("id").alias("before"), F.col("picked").alias("was")), "before")
        told = of.groupBy("id").agg(F.max("was").alias("beaten"), F.count_if(F.col("was").isNull()).alias("unknown"))
        verdict = open_rows.join(told, "id", "left").select("id", F.when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("unknown", F.lit(0)) == 0, True).alias("now"))
        state = settle(state.join(verdict, "id", "left").select("id", F.coalesce("picked", "now").alias("picked")))
    return state.where("picked").select("id")


def kept_boxes(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """id of the square boxes (image, id, x, y, s, score) that no kept box of their image with a better score covers by more than ``most``; ties by id.

    An image's boxes meet in one array, so boxes are shuffled once and no pairs are. A box without image or score covers none and is kept.
    """
    odd = F.col("image").isNull() | F.col("score").isNull()
    of = boxes.where(~odd).groupBy("image").agg(F.collect_set(F.struct((-F.col("score")).alias("o"), "id", "x", "y", "s")).alias("b"))
    side = lambda c, p, q: F.greatest(F.lit(0.0), F.least(p[c] + p["s"], q[c] + q["s"]) - F.greatest(p[c], q[c]))

    def covered(p: Column, q: Column) -> Column:
        both = side("x", p, q) * side("y", p, q)
        return F.coalesce((p["id"] != q["id"]) & (both / (p["s"] * p["s"] + q["s"] * q["s"] - both) > most), F.lit(False))

    ordered = of.select(F.array_sort("b").alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda some, x: F.when(F.exists(some, lambda y: covered(x, y)), some).otherwise(F.array_append(some, x)))
    return ordered.select(F.explode(F.array_distinct(F.transform(kept, lambda x: x["id"]))).alias("id")).unionByName(boxes.where(odd).select("id").distinct())


def fold_day(threads: DataFrame) -> DataFrame:
    """day, lead, weight, folded (a list) from day, id, weight, majors: a thread folds into the heaviest earlier lead of the same story.

    The same story: the same leading tag, two common majors, or one where either has only one. A day's
    threads are at most those of 24 charts, so each day is one group.
    """

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leads: list[list] = []
        for i, weight, majors in frame.sort_values(["weight", "id"], ascending=[False, True])[["id", "weight", "majors"]].itertuples(index=False):
            majors = list(majors)

            def same(other: list) -> bool:
                common = len(set(majors) & set(other))
                return bool(majors and other) and (majors[0] == other[0] or common >= 2 or (common == 1 and min(len(majors), len(other)) == 1))

            lead = next((x for x in leads if any(same(o) for o in x[3])), None)
            if lead:
                lead[1] += weight
                lead[2].append(i)
                lead[3].append(majors)
            else:
                leads.append([i, weight, [], [majors]])
        return pd.DataFrame([(key[0], i, w, f) for i, w, f, _ in leads], columns=["day", "lead", "weight", "folded"])

    day, kind, weight = (threads.schema[c].dataType.simpleString() for c in ("day", "id", "weight"))
    return threads.groupBy("day").applyInPandas(fold, f"day {day}, lead {kind}, weight {weight}, folded array<{kind}>")


def merge_links(threads: DataFrame, now: Column, quiet: str = "7 HOURS", expiry: str = "3 DAYS") -> DataFrame:
    """earlier, later: threads (id, first_at, last_at, majors) of one story, of which the later starts after the earlier and within a day of its end.

    Both ended more than ``quiet`` ago and are not older than ``expiry``. One story: three common
    majors, or all of the earlier one's.
    """
    fresh = threads.where((F.col("last_at") < now - F.expr(f"INTERVAL {quiet}")) & (F.col("last_at") >= now - F.expr(f"INTERVAL {expiry}")))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    told = lambda f, last: f.select("id", micros(F.col("first_at")).alias("first"), micros(last).alias("last"), "majors")
    rows = settle(fresh)
    return going_on(told(rows, F.col("last_at") + F.expr("INTERVAL 1 DAY")), told(rows.where(F.col("first_at") >= now - F.expr(f"INTERVAL {expiry}")), F.col("last_at")))


def related_threads(threads: DataFrame, top: int = 3) -> DataFrame:
    """a, b, hits: for each thread (id, day, majors) the ``top`` of the next day with most common majors: two, or three quarters of the most.

    Threads of a day with the same majors are alike, so sets of majors are compared and not threads; of
    each set the first ``top`` threads can be among the answers.
    """
    t = settle(threads.select("id", "day", F.array_sort("majors").alias("set")))
    order = Window.partitionBy("day", "set").orderBy("id")
    first = t.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).groupBy("day", "set").agg(F.collect_list("id").alias("ids"))
    sets = first.select("day", "set", F.explode("set").alias("major"))
    later = sets.select(F.date_sub("day", 1).alias("day"), F.col("set").alias("later"), "major")
    hits = sets.join(later, ["day", "major"]).groupBy("day", "set", "later").agg(F.count(F.lit(1)).alias("hits"))
    hits = hits.withColumn("strongest", F.max("hits").over(Window.partitionBy("day", "set"))).where("hits >= 2 OR hits >= 0.75 * strongest")
    told = hits.join(first.select(F.date_sub("day", 1).alias("day"), F.col("set").alias("later"), "ids"), ["day", "later"]).select("day", "set", "hits", F.explode("ids").alias("b"))
    best = told.withColumn("k", F.row_number().over(Window.partitionBy("day", "set").orderBy(F.desc("hits"), "b"))).where(F.col("k") <= top)
    return t.join(best, ["day", "set"]).select(F.col("id").alias("a"), "b", "hits")


def stories(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """lead, follower, direct, score, gap_minutes: the components of pairs (a, b, score), each led by its earliest article (id, at).

    A follower's score is that of its pair with the lead, else of its best pair.
    """
    of = components(pairs.select("a", "b")).join(articles.select("id", "at"), "id")
    lead = of.groupBy("component").agg(F.min_by("id", F.struct("at", "id")).alias("lead"), F.min("at").alias("led_at"))
    both = pairs.select("a", "b", "score").union(pairs.select(F.col("b"), F.col("a"), "score")).toDF("id", "other", "score")
    rest = of.join(lead, "component").where("id <> lead").join(both, "id")
    own = F.max(F.when(F.col("other") == F.col("lead"), F.col("score")))
    found = rest.groupBy("lead", F.col("id").alias("follower"), "at", "led_at").agg(own.alias("own"), F.max("score").alias("best"))
    gap = F.round((F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.col("led_at").cast("timestamp"))) / 60).cast("long")
    return found.select("lead", "follower", F.col("own").isNotNull().alias("direct"), F.coalesce("own", "best").alias("score"), gap.alias("gap_minutes"))


def fold_reports(reports: DataFrame, limit: int, share: int) -> DataFrame:
    """lead, copies, place of the reports (grp, id, media, at): copies of a group go under its earliest, groups stand by their newest, one of each outlet first.

    An outlet has at most ``share`` places while others wait; copies of the lead's own outlet aren't told.
    """
    lead = F.min_by(F.struct("id", "media"), F.struct("at", "id"))
    groups = reports.groupBy("grp").agg(lead.alias("lead"), F.max("at").alias("newest"))
    members = reports.join(groups.select("grp", "lead"), "grp").where("id <> lead.id and media <> lead.media")
    copies = members.groupBy("grp").agg(F.array_sort(F.collect_set("id")).alias("copies"))
    newest = [F.desc("newest"), F.desc("id")]
    told = groups.select("grp", "lead.id", "lead.media", "newest").withColumn("turn", F.row_number().over(Window.partitionBy("media").orderBy(*newest)))
    best = told.orderBy(F.col("turn") > share, F.least("turn", F.lit(2)), *newest).limit(limit)
    shown = best.join(copies, "grp", "left").select(F.col("id").alias("lead"), F.coalesce("copies", F.array().cast(f"array<{reports.schema['id'].dataType.simpleString()}>")).alias("copies"), F.least("turn", F.lit(2)).alias("turn"), "newest")
    return shown.select("lead", "copies", F.row_number().over(Window.orderBy("turn", F.desc("newest"), F.desc("lead"))).cast("long").alias("place"))


def communities(edges: DataFrame, passes: int = 30, most_nodes: int = 5000) -> DataFrame:
    """node, community of outlets by weighted modularity (edges: a, b, n); nodes move in order of name until none gains.

    The moves depend on each other, so the graph is one group: its nodes are outlets, and more than ``most_nodes`` are refused.
    """
    both = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.log1p(F.greatest("n", F.lit(1)).cast("double"))).alias("w"))
    nodes = both.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    if nodes > most_nodes:
        raise ValueError(f"{nodes} nodes are too many for one group")

    def move(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, w in frame.sort_values(["a", "b"])[["a", "b", "w"]].itertuples(index=False):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
        names = sorted(near)
        degree = {x: math.fsum(near[x].values()) for x in names}
        total, label, volume = math.fsum(degree.values()) or 1.0, {x: x for x in names}, dict(degree)
        for _ in range(passes):
            moved = False
            for x in names:
                volume[label[x]] -= degree[x]
                links = {label[x]: 0.0}
                for y, w in near[x].items():
                    links[label[y]] = links.get(label[y], 0.0) + w
                gain = {k: w - degree[x] * volume[k] / total for k, w in links.items()}
                best = label[x]
                for k in sorted(gain):
                    if gain[k] > gain[best] + 1e-9:
                        best = k
                moved |= best != label[x]
                label[x] = best
                volume[best] += degree[x]
            if not moved:
                break
        least: dict = {}
        for x in names:
            least.setdefault(label[x], x)
        return pd.DataFrame({"node": names, "community": [least[label[x]] for x in names]})

    kind = both.schema["a"].dataType.simpleString()
    return both.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(move, f"node {kind}, community {kind}")
