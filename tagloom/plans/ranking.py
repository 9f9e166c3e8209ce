"""Queries of the ranking family: charts, bursts, gates, pools, ranks and their orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import ranking as R
from tagloom.operators import search as S
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, articles, baskets

AS_OF, SINCE = "1998-01-31", "1998-01-01"
WINDOW = f"published_at >= TIMESTAMP '{SINCE}' AND published_at < TIMESTAMP '{AS_OF}'"
MEDIA_SQL = f"WITH {BASKETS_SQL}, w AS (SELECT * FROM baskets WHERE {WINDOW}), m AS (SELECT tag, media, count(*) AS n FROM w GROUP BY 1, 2)"
SCORE_SQL = "round(sum(2 * (1 - power(0.5, n))), 6)"
TOP = 15


def window(spark, sf_dir):
    return baskets(spark, sf_dir).where((F.col("published_at") >= SINCE) & (F.col("published_at") < AS_OF))


def charts(spark, sf_dir):
    return R.charts_at_lags(baskets(spark, sf_dir), AS_OF, 30, TOP)


CHARTS_SQL = f"""WITH {BASKETS_SQL}, lags(lag) AS (VALUES (0), (3), (6), (12), (24), (48)),
d AS (SELECT lag, baskets.* FROM baskets JOIN lags ON published_at >= TIMESTAMP '{AS_OF}' - to_days(lag + 30) AND published_at < TIMESTAMP '{AS_OF}' - to_days(lag)),
wt AS (SELECT lag, count(DISTINCT media) AS weight FROM d GROUP BY lag),
m AS (SELECT lag, tag, media, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT lag, tag, sum(2 * (1 - power(0.5, n))) AS score, sum(n)::BIGINT AS count FROM m GROUP BY ALL),
r AS (SELECT s.*, weight, row_number() OVER (PARTITION BY lag ORDER BY score DESC, tag) AS rank, count(*) OVER (PARTITION BY lag) AS tags FROM s JOIN wt USING (lag)),
charts AS (SELECT lag, tag, score / weight * 50 AS norm, count, rank, weight, tags > {TOP} AS "full" FROM r WHERE rank <= {TOP}),
fl AS (SELECT lag, CASE WHEN bool_or("full") THEN min(norm) ELSE 0 END AS floor FROM charts WHERE lag > 0 GROUP BY lag),
wh(lag, w) AS (VALUES (3, 0.92::DOUBLE), (6, 0.84::DOUBLE), (12, 0.7::DOUBLE), (24, 0.5::DOUBLE), (48, 0.25::DOUBLE)),
st AS (SELECT c.tag, c.norm, w * (c.norm - coalesce(p.norm, floor)) AS step FROM charts c CROSS JOIN wh LEFT JOIN fl ON fl.lag = wh.lag LEFT JOIN charts p ON p.lag = wh.lag AND p.tag = c.tag WHERE c.lag = 0),
bursts AS (SELECT tag, norm, CASE WHEN count(step) = 5 THEN norm + sum(step) END AS burst FROM st GROUP BY 1, 2)"""


@query("a01_tag_ranking", f"{MEDIA_SQL}, s AS (SELECT tag, {SCORE_SQL} AS score, sum(n)::BIGINT AS count, count(*) AS outlets FROM m GROUP BY 1) SELECT *, row_number() OVER (ORDER BY score DESC, tag) AS rank FROM s ORDER BY rank LIMIT 500")
def tag_ranking(spark, sf_dir):
    return R.rank_tags(window(spark, sf_dir))


@query("a02_chart_header", f"{MEDIA_SQL} SELECT count(DISTINCT media) AS outlets, count(DISTINCT article_id) AS articles, count(DISTINCT tag) > {TOP} AS truncated FROM w")
def chart_header(spark, sf_dir):
    return window(spark, sf_dir).agg(F.count_distinct("media").alias("outlets"), F.count_distinct("article_id").alias("articles"), (F.count_distinct("tag") > TOP).alias("truncated"))


@query("a03_normalised_score", f"{CHARTS_SQL} SELECT tag, round(norm, 6) AS norm, rank FROM charts WHERE lag = 0")
def normalised_score(spark, sf_dir):
    return charts(spark, sf_dir).where("lag = 0").select("tag", F.round("norm", 6).alias("norm"), "rank")


@query("a04_burst", f"{CHARTS_SQL} SELECT tag, round(norm, 6) AS norm, round(burst, 6) AS burst FROM bursts")
def burst(spark, sf_dir):
    return R.burst(charts(spark, sf_dir)).select("tag", F.round("norm", 6).alias("norm"), F.round("burst", 6).alias("burst"))


@query("a05_basis_reprojection", f"{MEDIA_SQL}, s AS (SELECT tag, {SCORE_SQL} AS score, sum(n)::BIGINT AS count FROM m WHERE media < 12 GROUP BY 1) SELECT *, row_number() OVER (ORDER BY score DESC, tag) AS rank FROM s")
def basis_reprojection(spark, sf_dir):
    """A stored chart (tag with its map of outlet counts) seen by a smaller roster of outlets."""
    stored = R.media_counts(window(spark, sf_dir)).groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("media", "n"))).alias("outlets"))
    seen = stored.withColumn("outlets", F.map_filter("outlets", lambda media, n: media < 12)).where(F.size("outlets") > 0)
    score = F.aggregate(F.array_sort(F.map_values("outlets")), F.lit(0.0), lambda total, n: total + R.media_score(n))
    count = F.aggregate(F.map_values("outlets"), F.lit(0).cast("long"), lambda total, n: total + n)
    out = seen.select("tag", F.round(score, 6).alias("score"), count.alias("count"))
    return S.numbered(out, F.desc("score"), "tag", name="rank")


POOL_SQL = f"{MEDIA_SQL}, s AS (SELECT tag, {SCORE_SQL} AS score, sum(n)::BIGINT AS count, count(*) AS outlets FROM m GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (n >= 2) >= 2 AND max(n) >= 3), pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, tag) AS rank, sha256(tag) AS tag_id FROM s)"


@query("a06_window_pool", f"{POOL_SQL} SELECT * FROM pool WHERE rank <= 100")
def window_pool(spark, sf_dir):
    return R.pool(window(spark, sf_dir), R.broad_gate())


@query("a07_pool_manifest", f"{POOL_SQL}, e AS (SELECT count(*) AS eligible, sha256(coalesce(string_agg(rank || ':' || tag_id, ',' ORDER BY rank), '')) AS checksum FROM pool) SELECT min(published_at) AS first_at, max(published_at) AS last_at, count(DISTINCT tag) AS candidates, any_value(eligible) AS eligible, any_value(checksum) AS checksum FROM w, e")
def pool_manifest(spark, sf_dir):
    """The pool's outline; the checksum is over at most 100 entries in rank order."""
    rows = window(spark, sf_dir)
    entries = F.array_sort(F.collect_list(F.struct("rank", "tag_id")))
    line = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["rank"].cast("string"), e["tag_id"])), ",")
    sums = R.pool(rows, R.broad_gate()).agg(F.count(F.lit(1)).alias("eligible"), F.sha2(line, 256).alias("checksum"))
    head = rows.agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count_distinct("tag").alias("candidates"))
    return head.crossJoin(sums)


@query("f15_early_and_broad_gates", f"{MEDIA_SQL} SELECT tag, count(*) FILTER (n >= 2) >= 2 AS early, count(*) >= 3 AND count(*) FILTER (n >= 2) >= 2 AND max(n) >= 3 AS broad FROM m GROUP BY tag")
def gates(spark, sf_dir):
    return R.media_counts(window(spark, sf_dir)).groupBy("tag").agg(R.early_gate().alias("early"), R.broad_gate().alias("broad"))


@query("f16_level_gates", f"WITH {BASKETS_SQL}, m AS (SELECT section, tag, media, count(*) AS n FROM baskets WHERE {WINDOW} GROUP BY ALL) SELECT section, tag, count(*) >= 2 AND sum(n) >= 3 AS level2, CASE WHEN section LIKE '1-%' THEN count(*) >= 3 AND sum(n) >= 5 ELSE count(*) >= 2 AND sum(n) >= 4 END AS level3 FROM m GROUP BY section, tag")
def level_gates(spark, sf_dir):
    outlets, total = F.count(F.lit(1)), F.sum("n")
    level3 = F.when(F.col("section").startswith("1-"), (outlets >= 3) & (total >= 5)).otherwise((outlets >= 2) & (total >= 4))
    return R.media_counts(window(spark, sf_dir), "section").groupBy("section", "tag").agg(((outlets >= 2) & (total >= 3)).alias("level2"), level3.alias("level3"))


@query("w01_row_number_rank", f"{MEDIA_SQL}, s AS (SELECT tag, sum(n)::BIGINT AS count FROM m GROUP BY 1) SELECT *, row_number() OVER (ORDER BY count DESC, tag) AS rank FROM s")
def row_number_rank(spark, sf_dir):
    return S.numbered(window(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("count")), F.desc("count"), "tag", name="rank")


@query("w02_competition_rank", f"{MEDIA_SQL}, s AS (SELECT media, count(DISTINCT article_id) AS articles FROM w GROUP BY 1) SELECT *, rank() OVER (ORDER BY articles DESC) AS place FROM s")
def competition_rank(spark, sf_dir):
    return window(spark, sf_dir).groupBy("media").agg(F.count_distinct("article_id").alias("articles")).withColumn("place", F.rank().over(Window.orderBy(F.desc("articles"))).cast("long"))


@query("w03_nth_article_decay", f"{MEDIA_SQL}, o AS (SELECT tag, power(0.5, row_number() OVER (PARTITION BY tag, media ORDER BY published_at, article_id) - 1) AS part FROM w) SELECT tag, round(sum(part), 6) AS score FROM o GROUP BY tag")
def nth_article_decay(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("tag", "media").orderBy("published_at", "article_id"))
    return window(spark, sf_dir).withColumn("part", F.pow(F.lit(0.5), nth - 1)).groupBy("tag").agg(F.round(F.sum("part"), 6).alias("score"))


@query("w06_lag_differences", f"{CHARTS_SQL} SELECT c.tag, p.lag, round(c.norm - p.norm, 6) AS step FROM charts c JOIN charts p ON p.tag = c.tag AND p.lag > 0 WHERE c.lag = 0")
def lag_differences(spark, sf_dir):
    c = charts(spark, sf_dir)
    return c.where("lag = 0").select("tag", "norm").join(c.where("lag > 0").select("tag", "lag", F.col("norm").alias("was")), "tag").select("tag", F.col("lag").cast("int").alias("lag"), F.round(F.col("norm") - F.col("was"), 6).alias("step"))


@query("w07_rank_before_and_new", f"{CHARTS_SQL} SELECT c.tag, c.rank, p.rank AS rank_before, p.rank IS NULL AS is_new FROM charts c LEFT JOIN charts p ON p.tag = c.tag AND p.lag = 24 WHERE c.lag = 0")
def rank_before(spark, sf_dir):
    c = charts(spark, sf_dir)
    return c.where("lag = 0").select("tag", "rank").join(c.where("lag = 24").select("tag", F.col("rank").alias("rank_before")), "tag", "left").withColumn("is_new", F.col("rank_before").isNull())


@query("w08_growth_signals", f"{CHARTS_SQL}, has AS (SELECT count(*) > 0 AS known FROM charts WHERE lag = 24) SELECT c.tag, CASE WHEN known THEN c.count - coalesce(p.count, 0) END AS growth, CASE WHEN known THEN c.count >= 8 AND coalesce(p.count, 0) < 8 END AS jumped FROM charts c CROSS JOIN has LEFT JOIN charts p ON p.tag = c.tag AND p.lag = 24 WHERE c.lag = 0")
def growth_signals(spark, sf_dir):
    c = charts(spark, sf_dir)
    old = c.where("lag = 24").select("tag", F.col("count").alias("was"))
    known = old.agg((F.count(F.lit(1)) > 0).alias("known"))
    out = c.where("lag = 0").select("tag", "count").join(old, "tag", "left").crossJoin(F.broadcast(known))  # one row
    was = F.coalesce("was", F.lit(0))
    return out.select("tag", F.when(F.col("known"), F.col("count") - was).alias("growth"), F.when(F.col("known"), (F.col("count") >= 8) & (was < 8)).alias("jumped"))


@query("w09_rank_trails", f"WITH {BASKETS_SQL}, e(i) AS (SELECT unnest(range(0, 8))), d AS (SELECT i, baskets.* FROM baskets JOIN e ON published_at >= TIMESTAMP '{AS_OF}' - to_days((i * 7 + 30)::INT) AND published_at < TIMESTAMP '{AS_OF}' - to_days((i * 7)::INT)), m AS (SELECT i, tag, media, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT i, tag, round(sum(2 * (1 - power(0.5, n))), 6) AS score FROM m GROUP BY ALL), r AS (SELECT i, tag, row_number() OVER (PARTITION BY i ORDER BY score DESC, tag) AS rank FROM s) SELECT tag, string_agg(i || '=' || rank, ',' ORDER BY i) AS trail FROM r WHERE rank <= {TOP} GROUP BY tag")
def rank_trails(spark, sf_dir):
    """A tag's ranks in eight weekly charts, as one line."""
    age = F.lit(AS_OF).cast("timestamp_ntz") - F.col("published_at")
    weeks = F.array_compact(F.array(*[F.when((age > F.expr(f"INTERVAL '{i * 7}' DAY")) & (age <= F.expr(f"INTERVAL '{i * 7 + 30}' DAY")), F.lit(i)) for i in range(8)]))
    scored = R.tag_scores(baskets(spark, sf_dir).withColumn("i", F.explode(weeks)), "i").withColumn("score", F.round("score", 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "tag"))).where(F.col("rank") <= TOP)
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: F.concat_ws("=", x["i"].cast("string"), x["rank"].cast("string"))), ",")
    return ranked.groupBy("tag").agg(trail.alias("trail"))


@query("t01_burst_order", f"{CHARTS_SQL} SELECT tag, row_number() OVER (ORDER BY round(burst, 6) DESC NULLS LAST, round(norm, 6) DESC, tag) AS place FROM bursts")
def burst_order(spark, sf_dir):
    order = Window.orderBy(F.desc_nulls_last(F.round("burst", 6)), F.desc(F.round("norm", 6)), "tag")
    return R.burst(charts(spark, sf_dir)).select("tag", F.row_number().over(order).cast("long").alias("place"))


@query("t03_filter_then_top", f"{CHARTS_SQL} SELECT tag, count FROM charts WHERE lag = 0 AND count >= 5 ORDER BY count DESC, tag LIMIT 5")
def filter_then_top(spark, sf_dir):
    return charts(spark, sf_dir).where("lag = 0 AND count >= 5").orderBy(F.desc("count"), "tag").select("tag", "count").limit(5)


@query("j13_as_of_snapshot", f"WITH {ARTICLES_SQL}, s AS (SELECT section, date_trunc('day', published_at) AS day, count(*) AS n FROM articles GROUP BY ALL) SELECT section, max(day) AS day, max_by(n, day) AS n FROM s WHERE day <= TIMESTAMP '{AS_OF}' GROUP BY section")
def as_of_snapshot(spark, sf_dir):
    """The newest daily snapshot of each section at or before an instant."""
    daily = articles(spark, sf_dir).groupBy("section", F.date_trunc("day", "published_at").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.where(F.col("day") <= AS_OF).groupBy("section").agg(F.max("day").alias("day"), F.max_by("n", "day").alias("n"))


@query("j14_lagged_lookup", f"WITH {ARTICLES_SQL}, s AS (SELECT date_trunc('day', published_at) AS day, count(*) AS n FROM articles GROUP BY ALL), l(lag) AS (VALUES (3), (6), (12), (24), (48)) SELECT s.day, lag, p.n AS was FROM s CROSS JOIN l JOIN s p ON p.day = s.day - to_days(lag) WHERE s.day >= TIMESTAMP '{SINCE}' AND s.day < TIMESTAMP '{AS_OF}'")
def lagged_lookup(spark, sf_dir):
    daily = articles(spark, sf_dir).groupBy(F.date_trunc("day", "published_at").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    now = daily.where((F.col("day") >= SINCE) & (F.col("day") < AS_OF)).select("day", F.explode(F.array(*[F.lit(x) for x in (3, 6, 12, 24, 48)])).alias("lag"))
    now = now.withColumn("past", F.col("day") - F.make_dt_interval(days=F.col("lag")))
    return now.join(daily.select(F.col("day").alias("past"), F.col("n").alias("was")), "past").select("day", "lag", "was")
