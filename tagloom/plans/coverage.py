"""Queries of aggregates over outlets, camps, events and readers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import coverage as C
from tagloom.operators import search as S
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, TEXTS_SQL, articles, baskets, stream, table, texts

A, B, ST, TX = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, TEXTS_SQL))
W = "published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-02-01'"


def month(rows):
    return rows.where(S.half_open(F.col("published_at"), "1998-01-01", "1998-02-01"))


@query("a08_conditional_counts", f"{A} SELECT media, count(*) AS total, count(*) FILTER (size > 200000) AS large, count(*) FILTER (section = '1-URGENT') AS urgent, max(CASE WHEN size > 200000 THEN published_at END) AS last_large FROM articles GROUP BY media")
def conditional_counts(spark, sf_dir):
    big = F.col("size") > 200000
    return articles(spark, sf_dir).groupBy("media").agg(F.count(F.lit(1)).alias("total"), F.count_if(big).alias("large"), F.count_if(F.col("section") == "1-URGENT").alias("urgent"), F.max(F.when(big, F.col("published_at"))).alias("last_large"))


@query("a09_conditional_max_fallback", f"{A} SELECT media, coalesce(max(CASE WHEN size > 450000 THEN article_id END), max(article_id)) AS example FROM articles GROUP BY media")
def conditional_max(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("media").agg(F.coalesce(F.max(F.when(F.col("size") > 450000, F.col("article_id"))), F.max("article_id")).alias("example"))


@query("a10_distinct_list", f"{A} SELECT media, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM articles GROUP BY media")
def distinct_list(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("media").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


@query("a11_latest_label", f"{A} SELECT media, arg_max(section, article_id) FILTER (section <> '3-MEDIUM') AS label FROM articles GROUP BY media")
def latest_label(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("media").agg(F.max_by("section", F.when(F.col("section") != "3-MEDIUM", F.col("article_id"))).alias("label"))


@query("a14_facets", f"{A} SELECT camp, media, count(*) AS n FROM articles WHERE {W} GROUP BY ROLLUP (camp, media)")
def facets(spark, sf_dir):
    return month(articles(spark, sf_dir)).rollup("camp", "media").agg(F.count(F.lit(1)).alias("n"))


@query("a15_camp_coverage", f"{B}, c AS (SELECT tag, camp, count(DISTINCT media) AS outlets, count(DISTINCT article_id) AS articles FROM baskets WHERE {W} GROUP BY ALL), s AS (SELECT *, 100 * outlets / (sum(outlets) OVER (PARTITION BY tag))::DOUBLE AS p FROM c) SELECT tag, camp, outlets, articles, round(p, 4) AS share, p < 30 AS blindspot FROM s")
def camp_coverage(spark, sf_dir):
    return C.camp_shares(month(baskets(spark, sf_dir)), "tag")


@query("a16_event_lean", f"{B}, g AS (SELECT tag, count(DISTINCT CASE WHEN camp = 'blue' THEN media END) AS blue, count(DISTINCT CASE WHEN camp = 'green' THEN media END) AS green, count(DISTINCT media) AS outlets FROM baskets WHERE {W} GROUP BY tag) SELECT tag, outlets, round(log2((blue + 1) / (green + 1)::DOUBLE), 6) AS lean, blue = 0 OR green = 0 AS blindspot FROM g")
def event_lean(spark, sf_dir):
    g = month(baskets(spark, sf_dir)).groupBy("tag").agg(F.count_distinct(F.when(F.col("camp") == "blue", F.col("media"))).alias("blue"), F.count_distinct(F.when(F.col("camp") == "green", F.col("media"))).alias("green"), F.count_distinct("media").alias("outlets"))
    return g.select("tag", "outlets", F.round(C.lean(F.col("blue"), F.col("green")), 6).alias("lean"), ((F.col("blue") == 0) | (F.col("green") == 0)).alias("blindspot"))


@query("a17_camp_baseline", f"{A} SELECT camp, count(*) AS articles, count(DISTINCT media) AS outlets FROM articles WHERE camp <> 'other' OR section IN ('1-URGENT', '2-HIGH') GROUP BY camp")
def camp_baseline(spark, sf_dir):
    kept = articles(spark, sf_dir).where((F.col("camp") != "other") | F.col("section").isin("1-URGENT", "2-HIGH"))
    return kept.groupBy("camp").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("media").alias("outlets"))


@query("a28_byline_aggregate", "SELECT l_suppkey AS author, count(DISTINCT l_orderkey) AS articles, count(DISTINCT o_custkey % 25) AS outlets, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles, max(o_orderdate) AS latest FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey")
def byline_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_suppkey").alias("author")).agg(F.count_distinct("l_orderkey").alias("articles"), F.count_distinct(F.col("o_custkey") % 25).alias("outlets"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("roles"), F.max("o_orderdate").alias("latest"))


@query("a29_journalist_summary", "SELECT l_suppkey AS author, count(DISTINCT l_orderkey) AS articles, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_orderkey END) AS with_body, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS cited, count(DISTINCT l_orderkey) - count(DISTINCT CASE WHEN l_returnflag = 'R' OR l_quantity > 25 THEN l_orderkey END) AS unmatched FROM lineitem GROUP BY l_suppkey")
def journalist_summary(spark, sf_dir):
    order, body, cited = F.col("l_orderkey"), F.col("l_quantity") > 25, F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("author")).agg(F.count_distinct(order).alias("articles"), F.count_distinct(F.when(body, order)).alias("with_body"), F.count_distinct(F.when(cited, order)).alias("cited"), (F.count_distinct(order) - F.count_distinct(F.when(cited | body, order))).alias("unmatched"))


@query("a33_coverage_table", f"{A} SELECT camp, count(*) AS total, count(*) FILTER (article_id % 2 = 0) AS fetched, count(*) FILTER (article_id % 2 = 0 AND size > 100000) AS usable, count(*) FILTER (article_id % 6 = 0 AND size > 100000) AS indexed, count(*) FILTER (article_id % 2 <> 0) AS pending FROM articles GROUP BY camp")
def coverage_table(spark, sf_dir):
    fetched, usable = F.col("article_id") % 2 == 0, F.col("size") > 100000
    return articles(spark, sf_dir).groupBy("camp").agg(F.count(F.lit(1)).alias("total"), F.count_if(fetched).alias("fetched"), F.count_if(fetched & usable).alias("usable"), F.count_if((F.col("article_id") % 6 == 0) & usable).alias("indexed"), F.count_if(~fetched).alias("pending"))


@query("a34_writing_overview", f"{ST} SELECT media, CAST(published_at AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS posters FROM stream GROUP BY GROUPING SETS ((), (media), (CAST(published_at AS DATE)))")
def writing_overview(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    return rows.groupingSets([[], ["media"], ["day"]], "media", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("posters"))


@query("a35_topic_tag_summary", f"{B} SELECT tag, count(DISTINCT media) AS outlets, count(DISTINCT article_id) FILTER (section = '1-URGENT') AS topics, count(DISTINCT article_id) FILTER (section <> '1-URGENT') AS features FROM baskets WHERE {W} GROUP BY tag HAVING count(DISTINCT article_id) >= 2 ORDER BY outlets DESC, tag LIMIT 40")
def topic_tag_summary(spark, sf_dir):
    urgent = F.col("section") == "1-URGENT"
    g = month(baskets(spark, sf_dir)).groupBy("tag").agg(F.count_distinct("media").alias("outlets"), F.count_distinct(F.when(urgent, F.col("article_id"))).alias("topics"), F.count_distinct(F.when(~urgent, F.col("article_id"))).alias("features"), F.count_distinct("article_id").alias("k"))
    return g.where("k >= 2").orderBy(F.desc("outlets"), "tag").limit(40).drop("k")


@query("a36_topic_counts", f"{A} SELECT media, count(*) FILTER (section = '1-URGENT') AS urgent, count(*) FILTER (section = '5-LOW') AS low, min(published_at) AS first_run FROM articles GROUP BY media")
def topic_counts(spark, sf_dir):
    first = articles(spark, sf_dir).groupBy("media").agg(F.min("published_at").alias("first_run"))
    kinds = articles(spark, sf_dir).groupBy("media").pivot("section", ["1-URGENT", "5-LOW"]).count().select("media", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))
    return kinds.join(first, "media")


@query("a38_section_vote", f"{B}, n AS (SELECT tag, media, section, count(*) AS n FROM baskets GROUP BY ALL), v AS (SELECT tag, section, media, n / (sum(n) OVER (PARTITION BY tag, media))::DOUBLE AS vote FROM n), s AS (SELECT tag, section, round(sum(vote), 6) AS votes, count(DISTINCT media) AS outlets FROM v GROUP BY ALL), t AS (SELECT *, votes / sum(votes) OVER (PARTITION BY tag) AS share FROM s) SELECT tag, section, votes FROM t WHERE outlets >= 3 AND votes >= 2 AND share >= 0.18 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY votes DESC, section) <= 2")
def section_vote(spark, sf_dir):
    """Each outlet has one vote for a tag, split over sections."""
    n = baskets(spark, sf_dir).groupBy("tag", "media", "section").agg(F.count(F.lit(1)).alias("n"))
    v = n.withColumn("vote", F.col("n") / F.sum("n").over(Window.partitionBy("tag", "media")))
    s = v.groupBy("tag", "section").agg(F.round(F.sum("vote"), 6).alias("votes"), F.count_distinct("media").alias("outlets"))
    t = s.withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("tag"))).where("outlets >= 3 AND votes >= 2 AND share >= 0.18")
    return S.capped(t, ["tag"], [F.desc("votes"), F.col("section")], 2).select("tag", "section", "votes")


@query("a39_crawl_health", f"{B}, t AS (SELECT article_id, count(*) AS tags FROM baskets GROUP BY 1), a AS (SELECT media, count(*) AS items, count(*) FILTER (size < 50000) AS failures, round(avg(CASE WHEN tags >= 3 THEN 1.0 ELSE 0 END), 6) AS tag_rate FROM articles LEFT JOIN t USING (article_id) GROUP BY media) SELECT * FROM a")
def crawl_health(spark, sf_dir):
    tags = baskets(spark, sf_dir).groupBy("article_id").agg(F.count(F.lit(1)).alias("tags"))
    rows = articles(spark, sf_dir).join(tags, "article_id", "left")
    return rows.groupBy("media").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("size") < 50000).alias("failures"), F.round(F.avg(F.when(F.col("tags") >= 3, 1.0).otherwise(0.0)), 6).alias("tag_rate"))


@query("a46_suggest_vocabulary", f"{B} SELECT tag, count(*) AS n FROM baskets WHERE published_at >= TIMESTAMP '1998-01-17' AND published_at < TIMESTAMP '1998-01-31' GROUP BY tag HAVING count(*) >= 2")
def suggest_vocabulary(spark, sf_dir):
    return baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-17", "1998-01-31")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("a48_vote_tally", "WITH v AS (SELECT l_partkey % 50 AS subject, l_suppkey % 5 AS choice, count(*) AS votes FROM lineitem GROUP BY ALL) SELECT subject, choice AS leader, votes FROM v QUALIFY row_number() OVER (PARTITION BY subject ORDER BY votes DESC, choice) = 1")
def vote_tally(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("subject"), (F.col("l_suppkey") % 5).alias("choice")).agg(F.count(F.lit(1)).alias("votes"))
    return v.groupBy("subject").agg(F.max_by("choice", F.struct("votes", -F.col("choice"))).alias("leader"), F.max("votes").alias("votes"))


@query("a49_mention_majority", "WITH m AS (SELECT l_orderkey AS who, l_returnflag AS role, count(*) AS hits FROM lineitem GROUP BY ALL), s AS (SELECT *, hits / (sum(hits) OVER (PARTITION BY who))::DOUBLE AS share FROM m) SELECT who, role, hits FROM s WHERE hits >= 3 AND share >= 0.5")
def mention_majority(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("who"), F.col("l_returnflag").alias("role")).agg(F.count(F.lit(1)).alias("hits"))
    return m.withColumn("share", F.col("hits") / F.sum("hits").over(Window.partitionBy("who"))).where("hits >= 3 AND share >= 0.5").select("who", "role", "hits")


@query("a50_camp_buckets", f"{ST} SELECT time_bucket(INTERVAL 1 HOUR, published_at) AS start, count(*) FILTER (media % 3 = 0) AS blue, count(*) FILTER (media % 3 = 1) AS green, count(*) FILTER (media % 3 = 2) AS other, count(DISTINCT media) AS active FROM stream GROUP BY 1")
def camp_buckets(spark, sf_dir):
    camp = F.col("media") % 3
    w = stream(spark, sf_dir).groupBy(F.window("published_at", "1 hour").alias("w")).agg(F.count_if(camp == 0).alias("blue"), F.count_if(camp == 1).alias("green"), F.count_if(camp == 2).alias("other"), F.count_distinct("media").alias("active"))
    return w.select(F.col("w.start").alias("start"), "blue", "green", "other", "active")


@query("a51_scene_counts", f"{ST}, s AS (SELECT section, published_at AS t FROM stream WHERE published_at >= TIMESTAMP '2024-01-14' AND published_at < TIMESTAMP '2024-01-15' AND collected_at < TIMESTAMP '2024-01-15') SELECT section, count(*) AS day, count(*) FILTER (t > TIMESTAMP '2024-01-14 22:00:00') AS recent, count(*) FILTER (t <= TIMESTAMP '2024-01-14 22:00:00' AND t > TIMESTAMP '2024-01-14 20:00:00') AS before FROM s GROUP BY section")
def scene_counts(spark, sf_dir):
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    rows = stream(spark, sf_dir).where(S.half_open(F.col("published_at"), "2024-01-14", "2024-01-15") & (F.col("collected_at") < now))
    age = now - F.col("published_at")
    hours = lambda h: age < F.expr(f"INTERVAL {h} HOURS")
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("day"), F.count_if(hours(2)).alias("recent"), F.count_if(~hours(2) & hours(4)).alias("before"))


@query("a53_first_collection", f"{ST} SELECT section, tag, min(published_at) AS first_published, min(collected_at) AS first_collected, min(published_at) >= TIMESTAMP '2024-01-02' AND min(collected_at) >= TIMESTAMP '2024-01-02' AS recent FROM stream GROUP BY ALL")
def first_collection(spark, sf_dir):
    day = F.lit("2024-01-02").cast("timestamp_ntz")
    return stream(spark, sf_dir).groupBy("section", "tag").agg(F.min("published_at").alias("first_published"), F.min("collected_at").alias("first_collected"), ((F.min("published_at") >= day) & (F.min("collected_at") >= day)).alias("recent"))


@query("a54_whole_percentages", f"{A}, c AS (SELECT media, section, count(*) AS n FROM articles GROUP BY ALL), e AS (SELECT *, 100 * n / (sum(n) OVER (PARTITION BY media))::DOUBLE AS x FROM c), f AS (SELECT *, floor(x)::BIGINT AS f FROM e), g AS (SELECT *, 100 - sum(f) OVER (PARTITION BY media) AS missing, row_number() OVER (PARTITION BY media ORDER BY round(x - f, 9) DESC, section) AS p FROM f) SELECT media, section, n, f + (p <= missing)::BIGINT AS percent FROM g")
def whole_percentages(spark, sf_dir):
    return C.whole_percentages(articles(spark, sf_dir).groupBy("media", "section").agg(F.count(F.lit(1)).alias("n")), "media", "section", "n")


@query("a55_share_by_subtraction", f"{A}, c AS (SELECT section, count(*) AS n, count(*) FILTER (camp = 'blue') AS blue, count(*) FILTER (camp = 'green') AS green FROM articles GROUP BY section) SELECT section, CASE WHEN blue + green <= n AND n > 0 THEN n - blue - green END AS other FROM c")
def share_by_subtraction(spark, sf_dir):
    c = articles(spark, sf_dir).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("camp") == "blue").alias("blue"), F.count_if(F.col("camp") == "green").alias("green"))
    known = F.col("blue") + F.col("green")
    return c.select("section", F.when((known <= F.col("n")) & (F.col("n") > 0), F.col("n") - known).alias("other"))


@query("a56_thread_tag_stats", f"{ST}, h AS (SELECT tag, date_trunc('hour', published_at) AS hour, sum(value) AS v FROM stream GROUP BY ALL) SELECT tag, round(max(v), 6) AS peak, first(hour ORDER BY v DESC, hour) AS peak_at, count(*) AS hours, bool_or(v > 300) AS major FROM h GROUP BY tag")
def thread_tag_stats(spark, sf_dir):
    h = stream(spark, sf_dir).groupBy("tag", F.date_trunc("hour", "published_at").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("v"))
    best = F.struct("v", -F.unix_seconds(F.col("hour").cast("timestamp")))
    return h.groupBy("tag").agg(F.round(F.max("v"), 6).alias("peak"), F.max_by("hour", best).alias("peak_at"), F.count(F.lit(1)).alias("hours"), F.bool_or(F.col("v") > 300).alias("major"))


@query("a58_first_reports", f"{B} SELECT tag, camp, min(published_at) AS first_at, max(published_at) AS last_at, first(media ORDER BY published_at, article_id) AS first_media, first(media ORDER BY published_at DESC, article_id DESC) AS last_media FROM baskets WHERE {W} GROUP BY ALL")
def first_reports(spark, sf_dir):
    at = F.struct("published_at", "article_id")
    return month(baskets(spark, sf_dir)).groupBy("tag", "camp").agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.min_by("media", at).alias("first_media"), F.max_by("media", at).alias("last_media"))


@query("a59_race_rounds", f"{A}, g AS (SELECT media, published_at, CASE WHEN published_at - lag(published_at) OVER (PARTITION BY media, section ORDER BY published_at) <= INTERVAL 20 DAY THEN 0 ELSE 1 END AS fresh, section FROM articles), r AS (SELECT media, section, published_at, sum(fresh) OVER (PARTITION BY media, section ORDER BY published_at) AS round FROM g) SELECT media, section, round::BIGINT AS round, min(published_at) AS first_at, max(published_at) AS last_at, count(*) AS n FROM r GROUP BY ALL")
def race_rounds(spark, sf_dir):
    r = C.sessions(articles(spark, sf_dir).select("media", "section", "published_at"), ["media", "section"], "published_at", "20 DAYS")
    return r.groupBy("media", "section", "round").agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query("a60_partner_counts", "SELECT l_suppkey AS source, count(DISTINCT l_partkey) AS partners, count(*) AS links FROM lineitem GROUP BY 1")
def partner_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count_distinct("l_partkey").alias("partners"), F.count(F.lit(1)).alias("links"))


@query("w11_diverse_picks", f"{B}, t AS (SELECT *, least(row_number() OVER (PARTITION BY tag, media ORDER BY published_at DESC, article_id DESC), 2) AS turn FROM baskets WHERE {W}), p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY turn, published_at DESC, article_id DESC) AS place FROM t) SELECT tag, article_id, media, place FROM p WHERE place <= 6")
def diverse_picks(spark, sf_dir):
    return C.diverse_pick(month(baskets(spark, sf_dir)), ["tag"], "media", [F.desc("published_at"), F.desc("article_id")], 6).select("tag", "article_id", "media", "place")


@query("w12_outlet_cap", f"{A} SELECT article_id, media FROM articles WHERE {W} QUALIFY row_number() OVER (PARTITION BY media ORDER BY published_at DESC, article_id) <= 3")
def outlet_cap(spark, sf_dir):
    return S.capped(month(articles(spark, sf_dir)), ["media"], [F.desc("published_at"), F.col("article_id")], 3).select("article_id", "media")


@query("w14_day_runs", f"{ST}, h AS (SELECT tag, date_trunc('hour', published_at) AS hour, max(value) AS best, count(*) AS n FROM stream GROUP BY ALL) SELECT tag, CAST(hour AS DATE) AS day, round(sum(best), 6) AS weight, max(n) AS busiest FROM h GROUP BY ALL")
def day_runs(spark, sf_dir):
    h = stream(spark, sf_dir).groupBy("tag", F.date_trunc("hour", "published_at").alias("hour")).agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))
    return h.groupBy("tag", F.to_date("hour").alias("day")).agg(F.round(F.sum("best"), 6).alias("weight"), F.max("n").alias("busiest"))


@query("w17_keep_first", f"{TX} SELECT article_id FROM texts QUALIFY row_number() OVER (PARTITION BY media, regexp_replace(title, '\\s', '', 'g') ORDER BY article_id) = 1")
def keep_first(spark, sf_dir):
    return texts(spark, sf_dir).groupBy("media", F.regexp_replace("title", r"\s", "")).agg(F.min("article_id").alias("article_id")).select("article_id")


@query("w19_story_representative", f"{A}, m AS (SELECT media, section, min(published_at) AS first_at FROM articles GROUP BY ALL) SELECT a.media, a.section, any_value(first_at) AS first_at, min(article_id) AS lead, count(*) AS ties FROM articles a JOIN m ON a.media = m.media AND a.section = m.section AND a.published_at = m.first_at GROUP BY a.media, a.section")
def story_representative(spark, sf_dir):
    ties = articles(spark, sf_dir).groupBy("media", "section", "published_at").agg(F.min("article_id").alias("lead"), F.count(F.lit(1)).alias("ties"))
    return ties.groupBy("media", "section").agg(F.min_by(F.struct(F.col("published_at").alias("first_at"), "lead", "ties"), "published_at").alias("s")).select("media", "section", "s.*")


@query("w24_share_of_total", f"{B}, n AS (SELECT media, tag, count(*) AS n FROM baskets GROUP BY ALL) SELECT media, tag, round(n / (sum(n) OVER (PARTITION BY media))::DOUBLE, 9) AS share FROM n")
def share_of_total(spark, sf_dir):
    n = baskets(spark, sf_dir).groupBy("media", "tag").agg(F.count(F.lit(1)).alias("n"))
    return n.select("media", "tag", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("media")), 9).alias("share"))


@query("a44_activity_matrix", "WITH u AS (SELECT user_id, event_type AS metric, ts FROM events UNION ALL SELECT o_custkey, 'order', o_orderdate FROM orders) SELECT user_id, count(*) FILTER (metric = 'click') AS clicks, count(*) FILTER (metric = 'order') AS orders, max(ts) AS last_at FROM u GROUP BY user_id")
def activity_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("metric"), "ts")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("order").alias("metric"), F.col("o_orderdate").alias("ts"))
    return e.unionByName(o).groupBy("user_id").agg(F.count_if(F.col("metric") == "click").alias("clicks"), F.count_if(F.col("metric") == "order").alias("orders"), F.max("ts").alias("last_at"))


@query("a45_reading_report", f"{ST} SELECT media, section, count(*) AS n FROM stream GROUP BY GROUPING SETS ((media), (section), ())")
def reading_report(spark, sf_dir):
    return stream(spark, sf_dir).groupingSets([["media"], ["section"], []], "media", "section").agg(F.count(F.lit(1)).alias("n"))



@query("a45_reading_report_whole", f"{ST} SELECT media, section, count(*) AS n FROM stream GROUP BY GROUPING SETS ((media), (section), ())")
def reading_report_whole(spark, sf_dir):
    """The same over all rows."""
    return stream(spark, sf_dir).groupingSets([["media"], ["section"], []], "media", "section").agg(F.count(F.lit(1)).alias("n"))