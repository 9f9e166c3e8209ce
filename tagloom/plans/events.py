"""Queries of event clusters, threads over time, stories and picks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import events as E
from tagloom.operators import search as S
from tagloom.plans.graphs import GRAPH_SQL, graph
from tagloom.streaming import threads as LIVE
from tagloom.sources.tables import STREAM_SQL, baskets, stream, table

ST = f"WITH {STREAM_SQL}"
EQUAL, TOGETHER = 0.28, 0.31
SETS_SQL = f"{GRAPH_SQL}, e AS (SELECT a, b FROM graph WHERE shared > {EQUAL} * na), tg AS (SELECT a, b FROM graph WHERE shared >= {TOGETHER} * least(na, nb)), reach(root, node) AS (SELECT a, b FROM e UNION SELECT root, b FROM reach JOIN e ON e.a = reach.node), cl AS (SELECT root, node FROM reach WHERE root <> node)"


def homes_sql(sets):
    """Tags of ``sets`` (owner, tag) outside their owner's home group, as recursive SQL."""
    return f"""{sets}, lk AS (SELECT x.owner, x.tag AS a, y.tag AS b FROM sets x JOIN sets y ON x.owner = y.owner JOIN tg ON tg.a = x.tag AND tg.b = y.tag),
gr(owner, tag, node) AS (SELECT owner, tag, tag FROM sets UNION SELECT gr.owner, gr.tag, lk.b FROM gr JOIN lk ON lk.owner = gr.owner AND lk.a = gr.node),
gs AS (SELECT owner, tag, min(node) AS grp FROM gr GROUP BY ALL),
we AS (SELECT gs.owner, grp, sum(coalesce(shared, 0)) AS weight FROM gs LEFT JOIN graph ON graph.a = gs.owner AND graph.b = gs.tag GROUP BY ALL),
ho AS (SELECT owner, grp FROM we QUALIFY row_number() OVER (PARTITION BY owner ORDER BY weight DESC, grp) > 1)"""


def sets(spark, sf_dir):
    g = E.settle(graph(spark, sf_dir))
    return g, g.where(F.col("shared") > EQUAL * F.col("na")).select("a", "b"), g.where(F.col("shared") >= TOGETHER * F.least("na", "nb")).select("a", "b")


@query("g05_alias_tags", f"WITH {GRAPH_SQL} SELECT a AS tag, max_by(b, (length(b), b)) AS canonical FROM graph WHERE contains(a, b) AND length(b) < length(a) AND shared >= 0.1 * na GROUP BY a")
def alias_tags(spark, sf_dir):
    return E.alias_tags(graph(spark, sf_dir), 0.1)


@query("g06_hubs", f"WITH RECURSIVE {SETS_SQL}, callers AS (SELECT node AS owner, root AS tag FROM cl), " + homes_sql("sets AS (SELECT * FROM callers WHERE owner IN (SELECT owner FROM callers GROUP BY owner HAVING count(*) > 1))") + " SELECT gs.tag AS root, gs.owner AS node FROM gs JOIN ho ON ho.owner = gs.owner AND ho.grp = gs.grp")
def hubs(spark, sf_dir):
    return E.hub_blocks(*sets(spark, sf_dir))


@query("g07_bridge_cut", f"WITH RECURSIVE {SETS_SQL}, " + homes_sql("sets AS (SELECT a AS owner, b AS tag FROM e)") + " SELECT gs.owner AS root, gs.tag AS node FROM gs JOIN ho ON ho.owner = gs.owner AND ho.grp = gs.grp")
def bridge_cut(spark, sf_dir):
    return E.bridge_cuts(*sets(spark, sf_dir))


CLUSTER_SQL = f"{SETS_SQL}, un AS (SELECT root AS a, node AS b FROM cl UNION SELECT node, root FROM cl), co(id, node) AS (SELECT a, a FROM un UNION SELECT id, b FROM co JOIN un ON un.a = co.node)"


@query("g09_merged_clusters", f"WITH RECURSIVE {CLUSTER_SQL} SELECT id AS tag, min(node) AS event FROM co GROUP BY id")
def merged_clusters(spark, sf_dir):
    """Seeds with what they reach, merged until no two clusters share a tag."""
    _, equal, _ = sets(spark, sf_dir)
    c = E.components(E.closures(equal).select(F.col("root").alias("a"), F.col("node").alias("b")))
    return c.select(F.col("id").alias("tag"), F.col("component").alias("event"))


def window_tags(spark, sf_dir):
    return baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-01", "1998-01-11")).select("article_id", "tag")


@query("g10_duplicate_events")
def duplicate_events(spark, sf_dir):
    """Events given by each tag and its equals, without those that mostly repeat others. The order of tests has no plain SQL form."""
    g, equal, _ = sets(spark, sf_dir)
    seeds = equal.select(F.col("a").alias("event"), F.col("b").alias("tag")).union(equal.select("a", "a")).distinct()
    members = E.event_members(window_tags(spark, sf_dir), seeds)
    scores = g.groupBy(F.col("a").alias("event")).agg(F.max("na").cast("double").alias("score"))
    return E.drop_duplicates(members, scores)


@query("g11_event_clusters")
def event_clusters(spark, sf_dir):
    """The whole chain: aliases folded, hubs and bridges cut, clusters, their articles, duplicates dropped; rank by the largest tag."""
    tags = window_tags(spark, sf_dir)
    g = E.settle(graph(spark, sf_dir))
    alias = E.alias_tags(g, 0.1)
    tags = E.settle(tags.join(alias, "tag", "left").select("article_id", F.coalesce("canonical", "tag").alias("tag")).distinct())
    g = E.settle(E_graph(tags))
    events = E.settle(E.clusters(g, EQUAL, TOGETHER))
    members = E.settle(E.event_members(tags, events))
    sizes = g.select(F.col("a").alias("tag"), F.col("na").alias("n")).distinct().join(events, "tag")
    scores = sizes.groupBy("event").agg(F.max("n").cast("double").alias("score"), F.count(F.lit(1)).alias("tags"))
    kept = E.drop_duplicates(members, scores.select("event", "score"))
    count = members.groupBy("event").agg(F.count(F.lit(1)).alias("articles"))
    told = kept.join(scores, "event").join(count, "event")
    return told.select("event", "score", "tags", "articles", F.row_number().over(Window.orderBy(F.desc("score"), "event")).cast("long").alias("rank"))


def E_graph(tags):
    from tagloom.operators.graphs import tag_graph

    return tag_graph(tags)


NEAR_SQL = "np AS (SELECT o.o_orderkey AS a, q.o_orderkey AS b, o.o_orderdate AS ta, q.o_orderdate AS tb, round(1 / (1 + abs(date_diff('day', o.o_orderdate, q.o_orderdate)))::DOUBLE, 6) AS score FROM orders o JOIN orders q ON o.o_custkey = q.o_custkey AND o.o_orderkey < q.o_orderkey AND abs(date_diff('day', o.o_orderdate, q.o_orderdate)) <= 30)"


def near_pairs(spark, sf_dir):
    """Orders of one customer within 30 days, closer ones scoring higher; joined by bands of 31 days."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("band", F.floor(F.unix_date(F.to_date("o_orderdate")) / 31))
    x = o.toDF("who", "x", "tx", "band").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    y = o.toDF("who", "y", "ty", "band")
    gap = F.abs(F.datediff("tx", "ty"))
    p = x.join(y, ["who", "band"]).where((F.col("x") != F.col("y")) & (gap <= 30))
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(1 / (1 + gap), 6).alias("score")).distinct()


@query("g13_stories", f"WITH RECURSIVE {NEAR_SQL}, u AS (SELECT a, b, score FROM np UNION ALL SELECT b, a, score FROM np), t(id, node) AS (SELECT a, a FROM u UNION SELECT id, b FROM t JOIN u ON u.a = t.node), c AS (SELECT id, min(node) AS comp FROM t GROUP BY id), m AS (SELECT id, comp, o_orderdate AS published FROM c JOIN orders ON o_orderkey = id), l AS (SELECT comp, first(id ORDER BY published, id) AS lead, min(published) AS led FROM m GROUP BY comp) SELECT lead, m.id AS follower, bool_or(u.b = lead) AS direct, coalesce(max(score) FILTER (u.b = lead), max(score)) AS score, round((epoch(any_value(published)) - epoch(any_value(led))) / 60)::BIGINT AS gap_minutes FROM m JOIN l USING (comp) JOIN u ON u.a = m.id WHERE m.id <> lead GROUP BY lead, m.id")
def stories(spark, sf_dir):
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return E.stories(near_pairs(spark, sf_dir), at)


REPORTS_SQL = "r AS (SELECT p_name || ' ' || p_type AS grp, p_partkey AS id, p_brand AS media, p_size AS t FROM part), g AS (SELECT grp, first(id ORDER BY t, id) AS lead, first(media ORDER BY t, id) AS media, max(t) AS newest FROM r GROUP BY grp), n AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY newest DESC, lead DESC) AS turn FROM g), b AS (SELECT * FROM n ORDER BY turn > 3, least(turn, 2), newest DESC, lead DESC LIMIT 40)"


@query("g14_folded_reports", f"WITH {REPORTS_SQL} SELECT b.lead, coalesce((SELECT string_agg(DISTINCT id, ',' ORDER BY id) FROM r WHERE r.grp = b.grp AND r.id <> b.lead AND r.media <> b.media), '') AS copies, row_number() OVER (ORDER BY least(turn, 2), newest DESC, lead DESC) AS place FROM b")
def folded_reports(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("media"), F.col("p_size").alias("at"))
    return E.fold_reports(r, 40, 3).withColumn("copies", F.array_join(F.transform("copies", lambda x: x.cast("string")), ","))


@query("g15_communities")
def communities(spark, sf_dir):
    """Outlets by who writes about the same parts; moves depend on each other and have no SQL form."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).cast("int").alias("a"), (F.col("l_partkey") % 40).cast("int").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return E.communities(e.where("n >= 45 or (a div 8) = (b div 8)"))


@query("g23_thread_lineage", f"{ST}, s AS (SELECT section, tag, min(published_at) AS t FROM stream GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY t, tag) AS i FROM s) SELECT section, tag, lag(tag) OVER w AS previous, lead(tag) OVER w AS next, count(*) OVER (PARTITION BY section) - 1 - (lag(tag) OVER w IS NOT NULL)::INT - (lead(tag) OVER w IS NOT NULL)::INT AS others FROM o WINDOW w AS (PARTITION BY section ORDER BY i)")
def thread_lineage(spark, sf_dir):
    """Each thread's neighbours in the line of its section, and how many others there are."""
    s = stream(spark, sf_dir).groupBy("section", "tag").agg(F.min("published_at").alias("t"))
    line = Window.partitionBy("section").orderBy("t", "tag")
    at = s.select("section", "tag", F.lag("tag").over(line).alias("previous"), F.lead("tag").over(line).alias("next"), F.count(F.lit(1)).over(Window.partitionBy("section")).alias("n"))
    return at.select("section", "tag", "previous", "next", (F.col("n") - 1 - F.col("previous").isNotNull().cast("int") - F.col("next").isNotNull().cast("int")).alias("others"))


@query("r07_rounds_with_ends", "WITH o AS (SELECT o_custkey AS who, o_orderkey AS id, o_orderdate AS t, o_orderdate + to_days((o_orderkey % 40)::INT) AS e FROM orders), p AS (SELECT *, max(e) OVER (PARTITION BY who ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o), r AS (SELECT *, sum(CASE WHEN before IS NULL OR t > before + INTERVAL 90 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS round FROM p) SELECT who, round::BIGINT AS round, count(*) AS items, min(t) AS since, max(e) AS until FROM r GROUP BY who, round")
def rounds_with_ends(spark, sf_dir):
    """Rounds that end when nothing starts within 90 days of the last end; an item reaches to the end of its story."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"), (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 40).cast("int"))).alias("e"))
    order = Window.partitionBy("who").orderBy("t", "id")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("t") > before + F.expr("INTERVAL 90 DAYS")), 1).otherwise(0)
    r = o.withColumn("fresh", fresh).withColumn("round", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("who", "round").agg(F.count(F.lit(1)).alias("items"), F.min("t").alias("since"), F.max("e").alias("until"))


def threads(spark, sf_dir):
    """Threads of readers: id, first_at, last_at and up to five major tags of each reader and day."""
    t = stream(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    n = t.groupBy("user_id", "day", "section").agg(F.count(F.lit(1)).alias("n"))
    major = S.capped(n, ["user_id", "day"], [F.desc("n"), F.col("section")], 5, "k").groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "section"))), lambda x: x["section"]).alias("majors"))
    span = t.groupBy("user_id", "day").agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    ident = F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string"))
    return span.join(major, ["user_id", "day"]).select(ident.alias("id"), "day", "first_at", "last_at", "majors")


THREADS_SQL = f"{ST}, n AS (SELECT user_id, published_at::DATE AS day, section, count(*) AS n FROM stream GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, section) AS k FROM n), mj AS (SELECT user_id, day, list(section ORDER BY k) AS majors FROM k WHERE k <= 5 GROUP BY ALL), sp AS (SELECT user_id, published_at::DATE AS day, min(published_at) AS first_at, max(published_at) AS last_at FROM stream GROUP BY ALL), th AS (SELECT user_id || '-' || day AS id, day, first_at, last_at, majors FROM sp JOIN mj USING (user_id, day))"


@query("r09_thread_links", f"{THREADS_SQL}, f AS (SELECT * FROM th WHERE last_at < TIMESTAMP '2024-01-15' - INTERVAL 7 HOUR AND last_at >= TIMESTAMP '2024-01-12'), x AS (SELECT *, unnest(majors) AS major FROM f), y AS (SELECT *, unnest(majors) AS major FROM f WHERE first_at >= TIMESTAMP '2024-01-12') SELECT x.id AS earlier, y.id AS later, count(DISTINCT x.major) AS hits FROM x JOIN y ON x.major = y.major AND y.first_at > x.first_at AND y.first_at <= x.last_at + INTERVAL 1 DAY GROUP BY x.id, y.id, len(x.majors) HAVING count(DISTINCT x.major) >= 3 OR count(DISTINCT x.major) = len(x.majors)")
def thread_links(spark, sf_dir):
    """Threads that go on in later ones, seven hours to three days after they ended."""
    return E.merge_links(threads(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz"))


WEIGHT_SQL = f"{ST}, h AS (SELECT user_id AS id, date_trunc('hour', published_at) AS hour, max(value) AS score FROM stream GROUP BY ALL), w AS (SELECT id, round(sum(score), 6) AS weight, count(*) AS hours FROM h GROUP BY id)"


@query("w15_period_picks", f"WITH RECURSIVE {WEIGHT_SQL[5:]}, o AS (SELECT id, weight, hours, row_number() OVER (ORDER BY weight DESC, id) AS i FROM w), p(i, id, weight, hours, taken) AS (SELECT i, id, weight, hours, [id % 12] FROM o WHERE i = 1 UNION ALL SELECT o.i, o.id, o.weight, o.hours, CASE WHEN list_contains(taken, o.id % 12) THEN taken ELSE list_append(taken, o.id % 12) END FROM p JOIN o ON o.i = p.i + 1), q AS (SELECT *, len(taken) AS k FROM p) SELECT id, weight, hours FROM q WHERE i = 1 OR k > (SELECT q2.k FROM q q2 WHERE q2.i = q.i - 1)")
def period_picks(spark, sf_dir):
    """The heaviest threads of a period (each hour counts its best score), without those of a story that a heavier pick tells."""
    h = stream(spark, sf_dir).groupBy(F.col("user_id").alias("id"), F.date_trunc("hour", "published_at").alias("hour")).agg(F.max("value").alias("score"))
    w = E.settle(h.groupBy("id").agg(F.round(F.sum("score"), 6).alias("weight"), F.count(F.lit(1)).alias("hours")))
    x = w.select("id", "weight", (F.col("id") % 12).alias("story"))
    y = x.select(F.col("id").alias("before"), F.col("weight").alias("heavier"), "story")
    earlier = (F.col("heavier") > F.col("weight")) | ((F.col("heavier") == F.col("weight")) & (F.col("before") < F.col("id")))
    # all but the first of a story conflict with the first: a star for each story, not all pairs
    head = x.groupBy("story").agg(F.max_by(F.struct("id", "weight"), F.struct("weight", -F.col("id"))).alias("h")).select("story", F.col("h.id").alias("before"), F.col("h.weight").alias("heavier"))
    return w.join(E.first_picks(w, x.join(head, "story").where(earlier).select("id", "before")), "id", "left_semi")


@query("w16_day_folding")
def day_folding(spark, sf_dir):
    """A day's threads by weight, duplicates folded into the heaviest earlier thread of the story; greedy, so without SQL."""
    t = threads(spark, sf_dir)
    weight = F.size("majors").cast("long") * 1000 + F.pmod(F.xxhash64("id"), F.lit(1000))
    return E.fold_day(t.select(F.col("day"), "id", weight.alias("weight"), F.slice("majors", 1, 2).alias("majors")))


@query("r08_thread_state", f"{ST}, h AS (SELECT user_id, section, date_trunc('hour', published_at) AS hour, max(value) AS score FROM stream GROUP BY ALL), n AS (SELECT user_id, hour, dense_rank() OVER (PARTITION BY user_id ORDER BY hour DESC) AS age, section, score FROM h), a AS (SELECT user_id, section, min(age) AS age FROM n WHERE age <= 24 GROUP BY ALL), al AS (SELECT user_id, string_agg(section, ',' ORDER BY age, section) AS all_tags FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY age, section) <= 4) GROUP BY 1), c AS (SELECT user_id, section, count(*) AS k FROM h GROUP BY ALL), mj AS (SELECT user_id, string_agg(section, ',' ORDER BY k DESC, section) AS major_tags FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, section) <= 5) GROUP BY 1) SELECT h.user_id, count(DISTINCT hour) AS hours, max(score) AS max_score, first(section ORDER BY score DESC, hour, section) AS max_tag, any_value(all_tags) AS all_tags, any_value(major_tags) AS major_tags FROM h JOIN al USING (user_id) JOIN mj USING (user_id) GROUP BY h.user_id")
def thread_state(spark, sf_dir):
    """What a thread holds after its hours: the tags of its newest 24 hours (four at most), its best score and its most frequent tags."""
    h = stream(spark, sf_dir).groupBy("user_id", "section", F.date_trunc("hour", "published_at").alias("hour")).agg(F.max("value").alias("score"))
    age = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("hour")))
    join = lambda rows, name: rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), ",").alias(name))
    newest = h.withColumn("age", age).where("age <= 24").groupBy("user_id", "section").agg(F.min("age").alias("age"))
    often = h.groupBy("user_id", "section").agg(F.count(F.lit(1)).alias("k"))
    best = h.groupBy("user_id").agg(F.count_distinct("hour").alias("hours"), F.max("score").alias("max_score"), F.min_by("section", F.struct(-F.col("score"), "hour", "section")).alias("max_tag"))
    return best.join(join(S.capped(newest, ["user_id"], [F.col("age"), F.col("section")], 4), "all_tags"), "user_id").join(join(S.capped(often, ["user_id"], [F.desc("k"), F.col("section")], 5), "major_tags"), "user_id")


def hourly_events(spark, sf_dir):
    """category, hour, rank, tags, scores: of each section and hour the twelve tags that most outlets had within a day, four to an event."""
    hour = F.date_trunc("hour", "published_at").cast("timestamp_ntz")
    hours = F.explode(F.sequence(hour, hour + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR")))
    had = stream(spark, sf_dir).select("section", "media", "tag", hours.alias("hour"))
    counts = had.groupBy("section", "hour", "tag").agg(F.count_distinct("media").alias("n"))
    place = F.row_number().over(Window.partitionBy("section", "hour").orderBy(F.desc("n"), "tag")) - 1
    top = counts.withColumn("place", place).where("place < 12")
    groups = top.groupBy(F.col("section").alias("category"), "hour", F.expr("place div 4").cast("int").alias("rank")).agg(F.array_sort(F.collect_list(F.struct("place", "tag", F.col("n").cast("double").alias("score")))).alias("x"))
    return groups.select("category", "hour", "rank", F.col("x.tag").alias("tags"), F.col("x.score").alias("scores"))


@query("r08_live_threads")
def live_threads(spark, sf_dir):
    """What each thread holds after each of its events, as a stream with timers tells it."""
    return LIVE.run_live_threads(hourly_events(spark, sf_dir)).where("kind IN ('start', 'event')").drop("other")


@query("r09_live_links")
def live_links(spark, sf_dir):
    """Threads that go on in others, and threads that are forgotten, from the same stream."""
    return LIVE.run_live_threads(hourly_events(spark, sf_dir)).where("kind IN ('link', 'end')").select("category", "kind", "hour", "thread", "other", "hours")


@query("x19_related_threads", f"{THREADS_SQL}, x AS (SELECT id, day, unnest(majors[1:3]) AS major FROM th), p AS (SELECT a.id AS a, b.id AS b, count(*) AS hits FROM x a JOIN x b ON a.major = b.major AND b.day = a.day + 1 WHERE hash_bucket GROUP BY ALL), s AS (SELECT *, max(hits) OVER (PARTITION BY a) AS strongest FROM p) SELECT a, b, hits FROM s WHERE hits >= 2 OR hits >= 0.75 * strongest QUALIFY row_number() OVER (PARTITION BY a ORDER BY hits DESC, b) <= 3".replace("WHERE hash_bucket ", ""))
def related_threads(spark, sf_dir):
    """For each thread the three of the next day that share the most of its tags."""
    return E.related_threads(threads(spark, sf_dir).select("id", "day", F.slice("majors", 1, 3).alias("majors")))
