"""What the service's endpoints answer, composed of the operators: charts with their signals, searches, event and thread pages, boards and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import coverage as C
from tagloom.operators import graphs as G
from tagloom.operators import ranking as R
from tagloom.operators import related as RELATED
from tagloom.operators import search as S
from tagloom.operators import series as H
from tagloom.plans import extraction, headlines, ranking
from tagloom.plans.events import hourly_events
from tagloom.plans.graphs import pairs, tree
from tagloom.plans.headlines import REPORTS_SQL
from tagloom.plans.similarity import near
from tagloom.plans.ranking import AS_OF, CHARTS_SQL, POOL_SQL, SINCE
from tagloom.sources.sinks import settle
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, TEXTS_SQL, articles, baskets, stream, table, texts
from tagloom.streaming import threads as LIVE

A, B, ST, TX = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, TEXTS_SQL))
W = f"published_at >= TIMESTAMP '{SINCE}' AND published_at < TIMESTAMP '{AS_OF}'"


def listed(name, value, order):
    """The values of a group in the order of a column, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), ",").alias(name)


@query("q01_ranking", f"{CHARTS_SQL}, has AS (SELECT count(*) > 0 AS known FROM charts WHERE lag = 24) SELECT c.tag, c.rank, c.count, round(c.norm, 6) AS norm, round(bursts.burst, 6) AS burst, p.rank AS rank_before, p.rank IS NULL AS is_new, CASE WHEN known THEN c.count - coalesce(p.count, 0) END AS growth, row_number() OVER (ORDER BY round(bursts.burst, 6) DESC NULLS LAST, round(c.norm, 6) DESC, c.tag) AS place FROM charts c JOIN bursts USING (tag) CROSS JOIN has LEFT JOIN charts p ON p.tag = c.tag AND p.lag = 24 WHERE c.lag = 0")
def ranking_page(spark, sf_dir):
    """The chart of an hour with bursts, what it was a day before, and its order."""
    c = ranking.charts(spark, sf_dir)
    now, before = c.where("lag = 0"), c.where("lag = 24").select("tag", F.col("rank").alias("rank_before"), F.col("count").alias("was"))
    known = before.agg((F.count(F.lit(1)) > 0).alias("known"))
    page = now.select("tag", "rank", "count", F.round("norm", 6).alias("norm")).join(R.burst(c).select("tag", F.round("burst", 6).alias("burst")), "tag").join(before, "tag", "left").crossJoin(F.broadcast(known))  # one row
    order = Window.orderBy(F.desc_nulls_last("burst"), F.desc("norm"), "tag")
    return page.select("tag", "rank", "count", "norm", "burst", "rank_before", F.col("rank_before").isNull().alias("is_new"), F.when(F.col("known"), F.col("count") - F.coalesce("was", F.lit(0))).alias("growth"), F.row_number().over(order).cast("long").alias("place"))


@query("q02_ranking_pool", f"{POOL_SQL}, e AS (SELECT count(*) AS eligible FROM pool) SELECT tag, tag_id, score, count, outlets, rank, eligible, rank >= eligible AS last FROM pool, e WHERE rank > 5 AND rank <= 15")
def ranking_pool(spark, sf_dir):
    """The second page of a window's pool, with its total."""
    pool = R.pool(ranking.window(spark, sf_dir), R.broad_gate())
    total = pool.agg(F.count(F.lit(1)).alias("eligible"))
    return pool.crossJoin(F.broadcast(total)).where("rank > 5 AND rank <= 15").withColumn("last", F.col("rank") >= F.col("eligible"))  # one row


@query("q03_article_search", f"{B}, t AS (SELECT article_id, media, published_at, camp, string_agg(tag, ',' ORDER BY tag) AS tags FROM baskets WHERE {W} GROUP BY ALL), h AS (SELECT * FROM t WHERE camp <> 'other' AND list_has_any(string_split(tags, ','), ['Brand#11', 'Brand#12', 'Brand#13'])), f AS (SELECT media, count(*) AS in_media FROM h GROUP BY media), p AS (SELECT * FROM h WHERE (published_at, article_id) < (TIMESTAMP '1998-01-25', 0) ORDER BY published_at DESC, article_id DESC LIMIT 21) SELECT article_id, p.media, published_at, tags, in_media FROM p JOIN f USING (media) QUALIFY row_number() OVER (ORDER BY published_at DESC, article_id DESC) <= 20")
def article_search(spark, sf_dir):
    """A page of the articles of two camps with any of three tags, with the facet counts of their outlets."""
    rows = baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), SINCE, AS_OF) & (F.col("camp") != "other"))
    hits = rows.where(F.col("tag").isin("Brand#11", "Brand#12", "Brand#13")).select("article_id").distinct()
    found = rows.join(hits, "article_id", "left_semi")
    facet = found.groupBy("media").agg(F.count_distinct("article_id").alias("in_media"))
    each = found.groupBy("article_id", "media", "published_at").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    page = S.keyset_page(each, ("1998-01-25", 0), 20)
    return page.join(facet, "media").select("article_id", "media", "published_at", "tags", "in_media")


@query("q04_tag_page", f"{B}, w AS (SELECT * FROM baskets WHERE {W}), n AS (SELECT count(*) AS n FROM w WHERE tag = 'Brand#11'), d AS (SELECT published_at::DATE AS day, count(*) AS articles, count(DISTINCT media) AS outlets FROM w WHERE tag = 'Brand#11' GROUP BY 1), o AS (SELECT w.published_at::DATE AS day, w.tag, count(*) AS k FROM w JOIN (SELECT article_id FROM w WHERE tag = 'Brand#11') USING (article_id) WHERE w.tag <> 'Brand#11' GROUP BY ALL), b AS (SELECT day, tag, k FROM o QUALIFY row_number() OVER (PARTITION BY day ORDER BY k DESC, tag) <= 3) SELECT d.day, articles, outlets, round(articles / n.n::DOUBLE, 6) AS share, (SELECT string_agg(tag, ',' ORDER BY k DESC, tag) FROM b WHERE b.day = d.day) AS with_tags FROM d, n")
def tag_page(spark, sf_dir):
    """A tag's days: articles, outlets, share of all, and the tags most often beside it."""
    w = ranking.window(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    own = w.where("tag = 'Brand#11'")
    total = own.agg(F.count(F.lit(1)).alias("n"))
    d = own.groupBy("day").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("media").alias("outlets"))
    o = w.where("tag <> 'Brand#11'").join(own.select("article_id"), "article_id", "left_semi").groupBy("day", "tag").agg(F.count(F.lit(1)).alias("k"))
    beside = S.capped(o, ["day"], [F.desc("k"), F.col("tag")], 3).groupBy("day").agg(listed("with_tags", "tag", "place"))
    return d.crossJoin(F.broadcast(total)).join(beside, "day", "left").select("day", "articles", "outlets", F.round(F.col("articles") / F.col("n"), 6).alias("share"), "with_tags")  # one row


@query("q05_suggest", f"{B}, v AS (SELECT tag, count(*) AS n FROM baskets WHERE {W} GROUP BY tag HAVING count(*) >= 2) SELECT tag, n, row_number() OVER (ORDER BY starts_with(tag, 'Brand#1') DESC, n DESC, length(tag), tag) AS place FROM v WHERE contains(tag, '1') ORDER BY place LIMIT 10")
def suggest(spark, sf_dir):
    """Suggestions for a typed text: those that begin with it, then the most frequent, then the shorter."""
    v = ranking.window(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 2 AND contains(tag, '1')")
    order = [F.desc(F.startswith("tag", F.lit("Brand#1"))), F.desc("n"), F.length("tag"), F.col("tag")]
    return v.orderBy(*order).limit(10).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("q06_new_keywords", f"{ST}, d AS (SELECT tag, published_at::DATE AS day, count(*) AS n FROM stream GROUP BY ALL), h AS (SELECT tag, sum(n)::BIGINT AS articles, max(n) AS peak_count, first(day ORDER BY n DESC, day) AS peak_day FROM d GROUP BY tag), f AS (SELECT tag, min(published_at) AS first_at FROM stream GROUP BY tag) SELECT tag, first_at, articles, peak_day, peak_count, row_number() OVER (ORDER BY articles DESC, tag) AS place FROM h JOIN f USING (tag) WHERE first_at >= TIMESTAMP '2024-01-01 06:00:00' AND articles >= 3")
def new_keywords(spark, sf_dir):
    """Tags first seen since an instant, with their peak days, most articles first."""
    rows = stream(spark, sf_dir)
    d = rows.groupBy("tag", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("t"))
    h = d.groupBy("tag").agg(F.min("t").alias("first_at"), F.sum("n").alias("articles"), F.min_by("day", F.struct(-F.col("n"), "day")).alias("peak_day"), F.max("n").alias("peak_count"))
    new = h.where((F.col("first_at") >= F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")) & (F.col("articles") >= 3))
    return new.withColumn("place", F.row_number().over(Window.orderBy(F.desc("articles"), "tag")).cast("long"))


EVENT_SQL = f"{B}, w AS (SELECT * FROM baskets WHERE {W}), m AS (SELECT DISTINCT section AS event, article_id, media, camp, published_at FROM w), c AS (SELECT event, count(*) AS articles, count(DISTINCT media) AS outlets, count(DISTINCT media) FILTER (camp = 'blue') AS blue, count(DISTINCT media) FILTER (camp = 'green') AS green, min(published_at) AS first_at, max(published_at) AS last_at FROM m GROUP BY event), t AS (SELECT section AS event, tag, count(DISTINCT article_id) AS n FROM w GROUP BY ALL), mj AS (SELECT event, string_agg(tag, ',' ORDER BY n DESC, tag) AS majors FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY event ORDER BY n DESC, tag) <= 3) GROUP BY event)"


@query("q07_events", f"{EVENT_SQL} SELECT event, articles, outlets, round(log2((blue + 1) / (green + 1)::DOUBLE), 6) AS lean, blue = 0 OR green = 0 AS blindspot, majors, row_number() OVER (ORDER BY articles DESC, event) AS rank FROM c JOIN mj USING (event)")
def events(spark, sf_dir):
    """The events of a window: articles, outlets, lean of the camps, major tags, rank."""
    w = ranking.window(spark, sf_dir)
    m = w.select(F.col("section").alias("event"), "article_id", "media", "camp").distinct()
    side = lambda c: F.count_distinct(F.when(F.col("camp") == c, F.col("media"))).alias(c)
    c = m.groupBy("event").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("media").alias("outlets"), side("blue"), side("green"))
    t = w.groupBy(F.col("section").alias("event"), "tag").agg(F.count_distinct("article_id").alias("n"))
    majors = S.capped(t, ["event"], [F.desc("n"), F.col("tag")], 3).groupBy("event").agg(listed("majors", "tag", "place"))
    told = c.join(majors, "event")
    return told.select("event", "articles", "outlets", F.round(C.lean(F.col("blue"), F.col("green")), 6).alias("lean"), ((F.col("blue") == 0) | (F.col("green") == 0)).alias("blindspot"), "majors", F.row_number().over(Window.orderBy(F.desc("articles"), "event")).cast("long").alias("rank"))


def live(spark, sf_dir):
    """The rows of live threads over the hourly events of the stream, with hours as times."""
    return settle(LIVE.run_live_threads(hourly_events(spark, sf_dir)).withColumn("hour", F.timestamp_seconds("hour").cast("timestamp_ntz")))


@query("q07_live_events")
def live_events(spark, sf_dir):
    """The events of the last completed hour by rank: their thread and how long it has run, and the articles of the day that have one of their tags (an article of the stream has one), with outlets, lean and blindspot."""
    told = live(spark, sf_dir).where("kind IN ('start', 'event')")
    last = told.agg(F.max("hour").alias("last"))
    now = told.join(F.broadcast(last), F.col("hour") == F.col("last")).select("category", "hour", "rank", "thread", "hours", "max_tag", "major_tags")  # one row
    events = now.join(hourly_events(spark, sf_dir).select("category", "hour", "rank", "tags"), ["category", "hour", "rank"])
    asked = events.select("category", "rank", "hour", F.explode("tags").alias("tag"))
    rows = stream(spark, sf_dir).select(F.col("section").alias("category"), "article_id", "media", "published_at", "tag")
    had = rows.join(F.broadcast(asked), ["category", "tag"]).where((F.col("published_at") < F.col("hour") + F.expr("INTERVAL 1 HOUR")) & (F.col("published_at") >= F.col("hour") - F.expr("INTERVAL 23 HOURS")))
    camp = F.when(F.col("media") % 3 == 0, "blue").when(F.col("media") % 3 == 1, "green").otherwise("other")
    side = lambda c: F.count_distinct(F.when(camp == c, F.col("media"))).alias(c)
    cover = had.groupBy("category", "rank").agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("media").alias("outlets"), side("blue"), side("green"))
    lean = F.round(C.lean(F.col("blue"), F.col("green")), 6)
    return events.join(cover, ["category", "rank"]).select("category", "hour", "rank", F.array_join("tags", ",").alias("tags"), "thread", "hours", "max_tag", "articles", "outlets", lean.alias("lean"), ((F.col("blue") == 0) | (F.col("green") == 0)).alias("blindspot"))


@query("q08_live_thread_days")
def live_thread_days(spark, sf_dir):
    """Each local day's five heaviest threads of a category: hours, best rank and its first hour, weight (each hour's best rank, the first counting most), their frequent tags, and the thread they go on from."""
    rows = live(spark, sf_dir)
    at = F.col("hour") + F.expr("INTERVAL 8 HOURS")
    hours = rows.where("kind IN ('start', 'event')").groupBy("category", "thread", at.alias("at")).agg(F.min("rank").alias("rank"), F.max_by("major_tags", F.struct("hours", "rank")).alias("tags"))
    days = hours.groupBy("category", "thread", F.to_date("at").alias("day")).agg(
        F.count(F.lit(1)).alias("hours"), F.min("rank").alias("best_rank"), F.min_by(F.hour("at"), F.struct("rank", "at")).alias("best_hour"), F.round(F.sum(1 / (F.col("rank") + 1)), 6).alias("weight"), F.array_join(F.max_by("tags", "at"), ",").alias("tags")
    )
    before = rows.where("kind = 'link'").groupBy("category", F.col("other").alias("thread")).agg(F.min("thread").alias("goes_on_from"))
    top = S.capped(days, ["category", "day"], [F.desc("weight"), F.col("best_rank"), F.col("thread")], 5)
    return top.join(before, ["category", "thread"], "left")


@query("q08_thread_days", f"{ST}, h AS (SELECT section, tag, date_trunc('hour', published_at) AS hour, count(*) AS n, round(sum(value), 6) AS score FROM stream GROUP BY ALL), b AS (SELECT section AS thread, hour + INTERVAL 8 HOUR AS local_hour, max(score) AS score, sum(n)::BIGINT AS n FROM h GROUP BY ALL) SELECT thread, local_hour::DATE AS day, round(sum(score), 6) AS weight, sum(n)::BIGINT AS articles, count(*) AS hours, first(hour(local_hour) ORDER BY score DESC, local_hour)::INT AS best_hour FROM b GROUP BY thread, local_hour::DATE QUALIFY row_number() OVER (PARTITION BY local_hour::DATE ORDER BY round(sum(score), 6) DESC, thread) <= 3".replace("QUALIFY row_number() OVER (PARTITION BY local_hour::DATE ORDER BY round(sum(score), 6) DESC, thread) <= 3", "QUALIFY row_number() OVER (PARTITION BY day ORDER BY weight DESC, thread) <= 3"))
def thread_days(spark, sf_dir):
    """Each local day's three heaviest threads: an hour weighs by its best score."""
    h = stream(spark, sf_dir).groupBy("section", "tag", H.hour(F.col("published_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("score"))
    b = h.groupBy(F.col("section").alias("thread"), (F.col("hour") + F.expr("INTERVAL 8 HOURS")).alias("at")).agg(F.max("score").alias("score"), F.sum("n").alias("n"))
    d = b.groupBy("thread", F.to_date("at").alias("day")).agg(F.round(F.sum("score"), 6).alias("weight"), F.sum("n").alias("articles"), F.count(F.lit(1)).alias("hours"), F.min_by(F.hour("at"), F.struct(-F.col("score"), "at")).alias("best_hour"))
    return S.capped(d, ["day"], [F.desc("weight"), F.col("thread")], 3).drop("place")


@query("q09_topics", f"{B}, w AS (SELECT * FROM baskets WHERE {W}), t AS (SELECT tag AS topic, count(DISTINCT media) AS outlets, count(*) AS items, min(published_at) AS first_at FROM w GROUP BY tag HAVING count(*) >= 2), s AS (SELECT tag AS topic, article_id, published_at, row_number() OVER (PARTITION BY tag ORDER BY published_at DESC, article_id DESC) AS k FROM w) SELECT topic, outlets, items, first_at, string_agg(article_id::VARCHAR, ',' ORDER BY k) AS stories FROM t JOIN s USING (topic) WHERE k <= 5 GROUP BY ALL")
def topics(spark, sf_dir):
    """Topics with their outlets and newest stories."""
    w = ranking.window(spark, sf_dir).withColumnRenamed("tag", "topic")
    t = w.groupBy("topic").agg(F.count_distinct("media").alias("outlets"), F.count(F.lit(1)).alias("items"), F.min("published_at").alias("first_at")).where("items >= 2")
    s = S.capped(w.select("topic", "article_id", "published_at"), ["topic"], [F.desc("published_at"), F.desc("article_id")], 5)
    return t.join(s.groupBy("topic").agg(listed("stories", "article_id", "place")), "topic")


@query("q10_media_page", f"{B}, w AS (SELECT * FROM baskets WHERE {W}), a AS (SELECT DISTINCT media, article_id, published_at FROM w), n AS (SELECT media, count(*) AS articles, count(*) FILTER (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS recent, max(published_at) AS last_at FROM a GROUP BY media), t AS (SELECT media, tag, count(*) AS k FROM w GROUP BY ALL), p AS (SELECT tag, sum(k) AS all_k FROM t GROUP BY tag), z AS (SELECT sum(k) AS z FROM t), o AS (SELECT media, sum(k) AS own FROM t GROUP BY media), d AS (SELECT t.media, tag, k FROM t JOIN p USING (tag) JOIN o USING (media), z WHERE k >= 3 AND k / own::DOUBLE >= 1.5 * (all_k - k) / (z - own)::DOUBLE) SELECT n.media, articles, recent, last_at, CASE WHEN last_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY THEN 'stale' ELSE 'ok' END AS status, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM d WHERE d.media = n.media), '') AS distinctive FROM n")
def media_page(spark, sf_dir):
    """Outlets with volumes, health and the tags they use half as often again as others."""
    w = ranking.window(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    n = w.select("media", "article_id", "published_at").distinct().groupBy("media").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("published_at") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("recent"), F.max("published_at").alias("last_at"))
    t = w.groupBy("media", "tag").agg(F.count(F.lit(1)).alias("k"))
    everyone, own = t.groupBy("tag").agg(F.sum("k").alias("all_k")), t.groupBy("media").agg(F.sum("k").alias("own"))
    total = t.agg(F.sum("k").alias("z"))
    d = t.join(everyone, "tag").join(own, "media").crossJoin(F.broadcast(total)).where((F.col("k") >= 3) & (F.col("k") / F.col("own") >= 1.5 * (F.col("all_k") - F.col("k")) / (F.col("z") - F.col("own"))))  # one row
    words = d.groupBy("media").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("distinctive"))
    status = F.when(F.col("last_at") < as_of - F.expr("INTERVAL 3 DAYS"), "stale").otherwise("ok")
    return n.join(words, "media", "left").select("media", "articles", "recent", "last_at", status.alias("status"), F.coalesce("distinctive", F.lit("")).alias("distinctive"))


@query("q11_traffic", f"{A}, m AS (SELECT media, date_trunc('month', published_at) AS month, count(*) AS articles, sum(round(size * 100)::BIGINT)::BIGINT AS visits FROM articles GROUP BY ALL), l AS (SELECT *, lag(visits) OVER (PARTITION BY media ORDER BY month) AS before FROM m) SELECT media, month, articles, visits // articles AS per_article, round(visits / before::DOUBLE, 6) AS change, rank() OVER (PARTITION BY month ORDER BY visits DESC) AS place FROM l WHERE month >= TIMESTAMP '2001-01-01'")
def traffic(spark, sf_dir):
    """Monthly visits (in hundredths) by outlet: for an article, against the month before, and the rank."""
    m = articles(spark, sf_dir).groupBy("media", F.date_trunc("month", "published_at").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("articles"), F.sum(F.round(F.col("size") * 100).cast("long")).alias("visits"))
    m = m.withColumn("before", F.lag("visits").over(Window.partitionBy("media").orderBy("month"))).where(F.col("month") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    place = F.rank().over(Window.partitionBy("month").orderBy(F.desc("visits"))).cast("long")
    return m.select("media", "month", "articles", F.expr("visits div articles").alias("per_article"), F.round(F.col("visits") / F.col("before"), 6).alias("change"), place.alias("place"))


PAIR_SQL = "p AS (SELECT o.o_orderkey AS a, q.o_orderkey AS b, o.o_orderdate AS ta, q.o_orderdate AS tb FROM orders o JOIN orders q ON o.o_custkey = q.o_custkey AND o.o_orderkey < q.o_orderkey WHERE o.o_orderdate >= TIMESTAMP '2000-01-01' AND q.o_orderdate >= TIMESTAMP '2000-01-01')"


@query("q12_similarity_graph", f"WITH {PAIR_SQL}, e AS (SELECT CASE WHEN tb >= ta THEN a % 20 ELSE b % 20 END AS source, CASE WHEN tb >= ta THEN b % 20 ELSE a % 20 END AS target, CASE WHEN a % 5 = b % 5 THEN 'attributed' WHEN a % 3 = b % 3 THEN 'same-byline' ELSE 'unattributed' END AS relation, a, b FROM p), g AS (SELECT source, target, relation, count(*) AS pairs, count(DISTINCT a) AS articles FROM e WHERE source <> target GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY pairs DESC, target, relation) AS place FROM g QUALIFY place <= 10")
def similarity_graph(spark, sf_dir):
    """Outlets' strongest connections by relation, from the earlier text to the later."""
    first = F.col("tb") >= F.col("ta")
    e = pairs(spark, sf_dir).select(F.when(first, F.col("a") % 20).otherwise(F.col("b") % 20).alias("source"), F.when(first, F.col("b") % 20).otherwise(F.col("a") % 20).alias("target"), G.relation_kind(F.col("a") % 5 == F.col("b") % 5, F.col("a") % 3 == F.col("b") % 3).alias("relation"), "a")
    g = e.where("source <> target").groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("articles"))
    return S.capped(g, ["source"], [F.desc("pairs"), F.col("target"), F.col("relation")], 10)


@query("q12_near_graph")
def near_graph(spark, sf_dir):
    """Outlets' connections by near-duplicate texts: from the earlier text to the later, or from the cited one; by relation, with identical pairs and the mean and best Dice."""
    rows = texts(spark, sf_dir).select("article_id", "media", "published_at")
    found = near(spark, sf_dir)
    cited = headlines.planted_citations(spark, sf_dir).select(F.col("id").alias("c"), F.col("source").alias("cited"))
    both = found.join(rows.toDF("a", "ma", "ta"), "a").join(rows.toDF("b", "mb", "tb"), "b").where("ma <> mb")
    both = both.join(cited.toDF("a", "mb").withColumn("a_cites", F.lit(True)), ["a", "mb"], "left").join(cited.toDF("b", "ma").withColumn("b_cites", F.lit(True)), ["b", "ma"], "left")
    attributed = F.col("a_cites").isNotNull() | F.col("b_cites").isNotNull()
    relation = G.relation_kind(attributed, F.lit(False))
    order = G.publication_order(F.col("ta"), F.col("tb"), F.lit(False))
    from_a = F.when(attributed, F.col("b_cites").isNotNull()).otherwise(order == "first")
    known = attributed | order.isin("first", "second")
    edge = both.select(F.when(from_a, F.col("ma")).otherwise(F.col("mb")).alias("source"), F.when(from_a, F.col("mb")).otherwise(F.col("ma")).alias("target"), relation.alias("relation"), known.alias("directed"), "dice", "kind", "a", "b")
    edge = edge.withColumns({"source": F.when(F.col("directed"), F.col("source")).otherwise(F.least("source", "target")), "target": F.when(F.col("directed"), F.col("target")).otherwise(F.greatest("source", "target"))})
    return edge.groupBy("source", "target", "relation", "directed").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("articles"), F.count_if(F.col("kind") == "identical").alias("identical"), F.round(F.avg("dice"), 6).alias("mean_dice"), F.max("dice").alias("best_dice"))


@query("q13_related_article", f"{B}, w AS (SELECT * FROM baskets WHERE {W}), df AS (SELECT tag, count(*) AS df FROM w GROUP BY tag), n AS (SELECT count(DISTINCT article_id) AS n FROM w), q AS (SELECT * FROM w WHERE article_id % 50 = 0), s AS (SELECT q.article_id AS a, w.article_id AS b, w.media, round(sum(ln((n + 1) / (df + 1)::DOUBLE)), 6) AS score FROM q JOIN w ON w.tag = q.tag AND w.article_id <> q.article_id JOIN df ON df.tag = q.tag CROSS JOIN n GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a, media ORDER BY score DESC, b) <= 1) SELECT a, b, media, score FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5")
def related_article(spark, sf_dir):
    """For the stated articles five others that share the rarest tags, one of each outlet."""
    return RELATED.related(ranking.window(spark, sf_dir), "article_id % 50 = 0", each=True).select("a", "b", "media", "score")


@query("q14_journalists", f"{A}, r AS (SELECT media AS person, article_id, section, published_at FROM articles), c AS (SELECT person, count(*) AS articles, count(DISTINCT section) AS sections, max(published_at) AS last_at FROM r GROUP BY person), f AS (SELECT person, first(section ORDER BY n DESC, section) AS beat FROM (SELECT person, section, count(*) AS n FROM r GROUP BY ALL) GROUP BY person) SELECT person, articles, sections, last_at, beat, round(articles / (sum(articles) OVER ())::DOUBLE, 6) AS share FROM c JOIN f USING (person) WHERE person NOT IN (3, 4)")
def journalists(spark, sf_dir):
    """Persons with what they wrote, their beat and share, without those on the exclusion list."""
    r = articles(spark, sf_dir).withColumnRenamed("media", "person").where("person NOT IN (3, 4)")
    c = r.groupBy("person").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("section").alias("sections"), F.max("published_at").alias("last_at"))
    f = r.groupBy("person", "section").agg(F.count(F.lit(1)).alias("n")).groupBy("person").agg(F.min_by("section", F.struct(-F.col("n"), "section")).alias("beat"))
    total = c.agg(F.sum("articles").alias("z"))
    return c.join(f, "person").crossJoin(F.broadcast(total)).select("person", "articles", "sections", "last_at", "beat", F.round(F.col("articles") / F.col("z"), 6).alias("share"))  # one row


@query("q15_writing", f"{TX}, t AS (SELECT article_id, media, section, published_at::DATE AS day, length(body) AS chars FROM texts) SELECT section, day, count(*) AS articles, count(DISTINCT media) AS outlets, round(avg(chars), 4) AS mean_chars, count(*) FILTER (chars < 200) AS short FROM t GROUP BY ALL")
def writing(spark, sf_dir):
    """What was written by language and day, and how long it is."""
    t = texts(spark, sf_dir).select("media", "section", F.to_date("published_at").alias("day"), F.length("body").alias("chars"))
    return t.groupBy("section", "day").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("media").alias("outlets"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.count_if(F.col("chars") < 200).alias("short"))


@query("q16_tag_groups", "WITH RECURSIVE tree(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), t(root, node, depth) AS (SELECT child, child, 0 FROM tree WHERE parent <> 'world' AND child LIKE 'n%' UNION ALL SELECT root, child, depth + 1 FROM t JOIN tree ON parent = node WHERE depth < 8), c AS (SELECT 'c' || o_custkey AS node, count(*) AS n FROM orders GROUP BY 1) SELECT root AS grp, count(DISTINCT t.node) - 1 AS members, coalesce(sum(n), 0)::BIGINT AS articles, rank() OVER (ORDER BY coalesce(sum(n), 0) DESC) AS place FROM t LEFT JOIN c ON c.node = t.node GROUP BY root")
def tag_groups(spark, sf_dir):
    """Groups of the tree with all members below them and their articles."""
    tree(spark, sf_dir).where("child LIKE 'n%'").select(F.col("child").alias("root")).createOrReplaceTempView("tagloom_group_roots")
    t = G.descendants(spark, "tagloom_tree", "tagloom_group_roots")
    c = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    g = t.join(c, "node", "left").groupBy(F.col("root").alias("grp")).agg((F.count_distinct("node") - 1).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("articles"))).cast("long"))


@query("q17_live_board", f"{ST}, b AS (SELECT section AS scene, time_bucket(INTERVAL 5 MINUTE, published_at) AS bucket, count(*) AS n, count(DISTINCT media) AS outlets FROM stream WHERE published_at >= TIMESTAMP '2024-01-15' AND published_at < TIMESTAMP '2024-01-16' GROUP BY ALL), h AS (SELECT scene, sum(n)::BIGINT AS day, (sum(n) FILTER (bucket >= TIMESTAMP '2024-01-15 23:00:00'))::BIGINT AS last_hour, (sum(n) FILTER (bucket >= TIMESTAMP '2024-01-15 22:00:00' AND bucket < TIMESTAMP '2024-01-15 23:00:00'))::BIGINT AS hour_before, max(n) AS peak FROM b GROUP BY scene) SELECT scene, day, coalesce(last_hour, 0) AS last_hour, coalesce(hour_before, 0) AS hour_before, peak, coalesce(last_hour, 0) > coalesce(hour_before, 0) AS rising FROM h")
def live_board(spark, sf_dir):
    """Scenes of a day: all, the last hour and the one before, the busiest five minutes."""
    day = stream(spark, sf_dir).where(S.half_open(F.col("published_at"), "2024-01-15", "2024-01-16"))
    b = day.groupBy(F.col("section").alias("scene"), F.window("published_at", "5 minutes")["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    at = lambda since, until: F.coalesce(F.sum(F.when(S.half_open(F.col("bucket"), since, until), F.col("n"))), F.lit(0))
    h = b.groupBy("scene").agg(F.sum("n").alias("day"), at("2024-01-15 23:00:00", "2024-01-16").alias("last_hour"), at("2024-01-15 22:00:00", "2024-01-15 23:00:00").alias("hour_before"), F.max("n").alias("peak"))
    return h.withColumn("rising", F.col("last_hour") > F.col("hour_before"))


@query("q18_site_observation", f"{ST}, d AS (SELECT published_at::DATE AS day, section AS metric, count(*) AS views, count(DISTINCT user_id) AS users, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM stream GROUP BY ALL) SELECT day, metric, views, users, v // views AS mean_value, round(views / (sum(views) OVER (PARTITION BY day))::DOUBLE, 6) AS share FROM d")
def site_observation(spark, sf_dir):
    """Daily metrics with users, means (in hundredths) and shares of the day."""
    d = stream(spark, sf_dir).groupBy(F.to_date("published_at").alias("day"), F.col("section").alias("metric")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("users"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    share = F.col("views") / F.sum("views").over(Window.partitionBy("day"))
    return d.select("day", "metric", "views", "users", F.expr("v div views").alias("mean_value"), F.round(share, 6).alias("share"))


@query("q19_vocabulary_changes", f"{B}, o AS (SELECT tag, count(*) AS n, max(published_at) AS last_at FROM baskets WHERE published_at < TIMESTAMP '1998-01-16' AND published_at >= TIMESTAMP '1998-01-01' GROUP BY tag), w AS (SELECT tag, count(*) AS n, max(published_at) AS last_at FROM baskets WHERE {W} GROUP BY tag), c AS (SELECT coalesce(o.tag, w.tag) AS tag, CASE WHEN w.tag IS NULL THEN 'absent' ELSE 'upsert' END AS change, w.n FROM o FULL JOIN w ON o.tag = w.tag WHERE o.n IS DISTINCT FROM w.n) SELECT tag, change, n, (row_number() OVER (ORDER BY tag) - 1) // 10 AS page FROM c")
def vocabulary_changes(spark, sf_dir):
    """The changes between two snapshots of the vocabulary, in pages of ten."""
    old = baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), SINCE, "1998-01-16")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    new = ranking.window(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return S.numbered(S.changes(old, new, "tag", "n"), "tag", name="place").select("tag", "change", "n", F.floor((F.col("place") - 1) / 10).cast("long").alias("page"))


@query("q20_archives", f"WITH {extraction.PACKAGES_SQL} SELECT package, lower, upper, n, first_at, last_at FROM pk WHERE first_at < TIMESTAMP '1998-01-01' AND upper > 2500 ORDER BY package")
def archives(spark, sf_dir):
    """The packages that may hold articles of a time and a key range."""
    pk = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 1000").alias("package")).agg((F.min("o_orderkey") - 1).alias("lower"), F.max("o_orderkey").alias("upper"), F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))
    return pk.where((F.col("first_at") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("upper") > 2500))


@query("q21_reader_feed", f"{ST}, r AS (SELECT user_id, media % 3 AS side, count(*) AS n FROM stream GROUP BY ALL), s AS (SELECT user_id, side, n, sum(n) OVER (PARTITION BY user_id) AS reads FROM r), t AS (SELECT user_id, tag, count(*) AS n FROM stream GROUP BY ALL), f AS (SELECT user_id, string_agg(tag, ',' ORDER BY n DESC, tag) AS follows FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) <= 3) GROUP BY user_id) SELECT user_id, reads::BIGINT AS reads, max(n) AS most, reads >= 5 AND max(n) >= 0.4 * reads AS one_sided, follows FROM s JOIN f USING (user_id) GROUP BY user_id, reads, follows")
def reader_feed(spark, sf_dir):
    """Readers with what they follow most and whether they read one side."""
    rows = stream(spark, sf_dir)
    r = rows.groupBy("user_id", (F.col("media") % 3).alias("side")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("n").alias("reads"), F.max("n").alias("most"))
    t = rows.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    follows = S.capped(t, ["user_id"], [F.desc("n"), F.col("tag")], 3).groupBy("user_id").agg(listed("follows", "tag", "place"))
    return r.withColumn("one_sided", (F.col("reads") >= 5) & (F.col("most") >= 0.4 * F.col("reads"))).join(follows, "user_id")


@query("q22_feeds", f"{A}, i AS (SELECT section, article_id, published_at FROM articles QUALIFY row_number() OVER (PARTITION BY section ORDER BY published_at DESC, article_id DESC) <= 3) SELECT section, '<channel><title>' || section || '</title>' || string_agg('<item><guid>' || article_id || '</guid></item>', '' ORDER BY published_at DESC, article_id DESC) || '</channel>' AS xml FROM i GROUP BY section")
def feeds(spark, sf_dir):
    """A feed of each section's newest articles."""
    i = S.capped(articles(spark, sf_dir).select("section", "article_id", "published_at"), ["section"], [F.desc("published_at"), F.desc("article_id")], 3)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "article_id"))), lambda x: F.concat(F.lit("<item><guid>"), x["article_id"].cast("string"), F.lit("</guid></item>"))), "")
    return i.groupBy("section").agg(items.alias("items")).select("section", F.concat(F.lit("<channel><title>"), "section", F.lit("</title>"), "items", F.lit("</channel>")).alias("xml"))


@query("q23_headline_columns", f"WITH {REPORTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY event, camp, media ORDER BY hits DESC, hour DESC, id) AS k FROM hl), c AS (SELECT event, camp, id, title, row_number() OVER (PARTITION BY event, camp ORDER BY hits DESC, hour DESC, id) AS place FROM o WHERE k = 1) SELECT event, camp, id, title, place FROM c WHERE place <= 3")
def headline_columns(spark, sf_dir):
    """Columns of an event's headlines by camp, one of each outlet."""
    order = [F.desc("hits"), F.desc("hour"), F.col("id")]
    one = S.capped(headlines.reports(spark, sf_dir), ["event", "camp", "media"], order, 1, "k")
    return S.capped(one, ["event", "camp"], order, 3).select("event", "camp", "id", "title", "place")


@query("q24_user_activity", f"{ST}, c AS (SELECT user_id, section AS metric, count(*) AS n, max(published_at) AS last_at FROM stream GROUP BY ALL UNION ALL SELECT user_id, 'late', count(*), max(collected_at) FROM stream WHERE collected_at > published_at GROUP BY user_id) SELECT user_id, sum(n)::BIGINT AS total, count(*) AS metrics, max(last_at) AS last_at, first(metric ORDER BY n DESC, metric) AS favourite FROM c GROUP BY user_id")
def user_activity(spark, sf_dir):
    """Users by all logs: totals, kinds, the last time and what they do most."""
    rows = stream(spark, sf_dir)
    logs = rows.select("user_id", F.col("section").alias("metric"), F.col("published_at").alias("at")).unionByName(rows.where("collected_at > published_at").select("user_id", F.lit("late").alias("metric"), F.col("collected_at").alias("at")))
    c = logs.groupBy("user_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
    return c.groupBy("user_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("metrics"), F.max("last_at").alias("last_at"), F.min_by("metric", F.struct(-F.col("n"), "metric")).alias("favourite"))
