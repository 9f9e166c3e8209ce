"""Queries of traffic, site metrics, vectors and smaller operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import graphs as G
from tagloom.operators import search as S
from tagloom.sources.tables import ARTICLES_SQL, STREAM_SQL, articles, stream, table

A, ST = (f"WITH {x}" for x in (ARTICLES_SQL, STREAM_SQL))


@query("a40_weighted_share", "SELECT c_nationkey AS place, round(sum(CASE WHEN c_acctbal > 5000 THEN c_custkey % 1000 ELSE 0 END) / nullif(sum(c_custkey % 1000), 0)::DOUBLE, 9) AS share FROM customer GROUP BY 1")
def weighted_share(spark, sf_dir):
    w = F.col("c_custkey") % 1000
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("place")).agg(F.round(F.try_divide(F.sum(F.when(F.col("c_acctbal") > 5000, w).otherwise(0)), F.sum(w)), 9).alias("share"))


@query("a41_monthly_counts", f"{A}, m AS (SELECT DISTINCT media FROM articles), s AS (SELECT unnest(['199801', '199802', '199803', '200112']) AS month), c AS (SELECT media, strftime(published_at + INTERVAL 8 HOUR, '%Y%m') AS month, count(*) AS n, count(DISTINCT section) AS sections FROM articles GROUP BY ALL) SELECT m.media, s.month, coalesce(n, 0) AS n, coalesce(sections, 0) AS sections FROM m CROSS JOIN s LEFT JOIN c ON c.media = m.media AND c.month = s.month")
def monthly_counts(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("month", F.date_format(F.col("published_at") + F.expr("INTERVAL 8 HOURS"), "yyyyMM"))
    c = rows.groupBy("media", "month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("section").alias("sections"))
    spine = rows.select("media").distinct().withColumn("month", F.explode(F.array(*[F.lit(x) for x in ("199801", "199802", "199803", "200112")])))
    return spine.join(c, ["media", "month"], "left").fillna(0)


@query("a42_metric_series", f"{ST}, d AS (SELECT CAST(published_at AS DATE) AS day, section, value FROM stream) SELECT day, round(sum(value) FILTER (section = 'click'), 6) AS click, round(sum(value) FILTER (section = 'view'), 6) AS view, round(sum(value * (1 + length(section))) / sum(value), 9) AS position FROM d GROUP BY day")
def metric_series(spark, sf_dir):
    d = stream(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    wide = d.groupBy("day").pivot("section", ["click", "view"]).agg(F.round(F.sum("value"), 6))
    mean = d.groupBy("day").agg(F.round(F.sum(F.col("value") * (1 + F.length("section"))) / F.sum("value"), 9).alias("position"))
    return wide.join(mean, "day")


@query("a43_page_rows", f"{ST}, p AS (SELECT CAST(published_at AS DATE) AS day, tag, section, count(*) AS views, count(DISTINCT user_id) AS users FROM stream GROUP BY ALL) SELECT day, tag, sum(views)::BIGINT AS views, max(users) AS users, first(section ORDER BY views DESC, section) AS title FROM p GROUP BY day, tag")
def page_rows(spark, sf_dir):
    p = stream(spark, sf_dir).groupBy(F.to_date("published_at").alias("day"), "tag", "section").agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("users"))
    best = F.array_min(F.collect_list(F.struct((-F.col("views")).alias("v"), "section")))
    return p.groupBy("day", "tag").agg(F.sum("views").alias("views"), F.max("users").alias("users"), best["section"].alias("title"))


@query("a47_title_vocabulary", "SELECT p_type AS tag, count(DISTINCT p_partkey) AS n, lower(left(p_type, 2)) AS key FROM part GROUP BY p_type HAVING count(DISTINCT p_partkey) >= CASE WHEN length(p_type) <= 5 THEN 3 ELSE 2 END")
def title_vocabulary(spark, sf_dir):
    v = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count_distinct("p_partkey").alias("n"))
    return v.where(F.col("n") >= F.when(F.length("tag") <= 5, 3).otherwise(2)).withColumn("key", F.lower(F.left("tag", F.lit(2))))


@query("a61_host_output", "WITH h AS (SELECT page_id, split_part(regexp_replace(url, '^[a-zA-Z]+://', ''), '/', 1) AS host FROM pages), d AS (SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h) SELECT domain, count(*) AS pages, count(DISTINCT host) AS hosts, round(count(*) FILTER (host LIKE 'm.%') / count(*)::DOUBLE, 9) AS mobile FROM d GROUP BY domain")
def host_output(spark, sf_dir):
    host = F.substring_index(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "/", 1)
    d = table(spark, sf_dir, "pages").select(host.alias("host"), F.substring_index(host, ".", -2).alias("domain"))
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"), F.round(F.count_if(F.col("host").startswith("m.")) / F.count(F.lit(1)), 9).alias("mobile"))


@query("a62_sitemap_days", f"{A}, d AS (SELECT DISTINCT published_at::DATE AS day, media, section FROM articles), c AS (SELECT day, count(*) AS n FROM d GROUP BY day), o AS (SELECT published_at::DATE AS day, count(*) AS n FROM articles WHERE article_id % 2 = 0 GROUP BY 1) SELECT c.day, greatest(c.n, coalesce(o.n, 0)) AS n, c.n >= 5 AS capped FROM c LEFT JOIN o USING (day)")
def sitemap_days(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    c = rows.select("day", "media", "section").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    o = rows.where("article_id % 2 = 0").groupBy("day").agg(F.count(F.lit(1)).alias("m"))
    return c.join(o, "day", "left").select("day", F.greatest("n", F.coalesce("m", F.lit(0))).alias("n"), (F.col("n") >= 5).alias("capped"))


@query("a63_visits_per_article", f"{A}, m AS (SELECT media, date_trunc('month', published_at) AS month, count(*) AS n, sum(size) AS visits FROM articles GROUP BY ALL) SELECT media, month::DATE AS month, round(visits * 0.7 / (n / day(last_day(month))::DOUBLE) / day(last_day(month)), 6) AS per_article FROM m")
def visits_per_article(spark, sf_dir):
    m = articles(spark, sf_dir).groupBy("media", F.trunc("published_at", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("visits"))
    days = F.dayofmonth(F.last_day("month"))
    return m.select("media", "month", F.round(F.col("visits") * 0.7 / (F.col("n") / days) / days, 6).alias("per_article"))


@query("y01_vector_cosine", "WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0) SELECT q.vec_id AS a, e.vec_id AS b, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2])) / (q.norm * e.norm), 6) AS cosine FROM q JOIN e ON q.vec_id <> e.vec_id WHERE list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2])) / (q.norm * e.norm) >= 0.35")
def vector_cosine(spark, sf_dir):
    """The stated queries (ids divisible by 50) against all vectors, by products of blocks."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return G.cosine_pairs(e.where("vec_id % 50 = 0"), e, 0.35).withColumn("cosine", F.round("cosine", 6))


@query("y03_clamped_score", "SELECT l_orderkey, l_linenumber, round((0.5 * greatest(0, least(1, l_quantity / 40)) + 0.3 * greatest(0, least(1, l_discount * 12)) + 0.2 * greatest(0, least(1, l_tax * 10 - 0.1))) * CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1 END, 6)::DOUBLE AS score FROM lineitem")
def clamped_score(spark, sf_dir):
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = 0.5 * clamp(F.col("l_quantity") / 40) + 0.3 * clamp(F.col("l_discount") * 12) + 0.2 * clamp(F.col("l_tax") * 10 - 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(parts * F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0), 6).alias("score"))


@query("y03_clamped_score_whole")
def clamped_score_whole(spark, sf_dir):
    """The same over all rows."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = 0.5 * clamp(F.col("l_quantity") / 40) + 0.3 * clamp(F.col("l_discount") * 12) + 0.2 * clamp(F.col("l_tax") * 10 - 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(parts * F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0), 6).alias("score"))


@query("y05_first_crawl_totals", f"{A} SELECT media, min(collected_at) AS first_at, count(*) AS n FROM articles WHERE media NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY media")
def first_crawl_totals(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("media"))
    return articles(spark, sf_dir).join(known, "media", "left_anti").groupBy("media").agg(F.min("collected_at").alias("first_at"), F.count(F.lit(1)).alias("n"))


@query("y06_adjacent_hours", f"{ST}, h AS (SELECT DISTINCT section, date_trunc('hour', published_at) AS hour FROM stream) SELECT section, hour, lag(hour) OVER (PARTITION BY section ORDER BY hour) AS previous, lead(hour) OVER (PARTITION BY section ORDER BY hour) AS next FROM h")
def adjacent_hours(spark, sf_dir):
    h = stream(spark, sf_dir).select("section", F.date_trunc("hour", "published_at").cast("timestamp_ntz").alias("hour")).distinct()
    w = Window.partitionBy("section").orderBy("hour")
    return h.select("section", "hour", F.lag("hour").over(w).alias("previous"), F.lead("hour").over(w).alias("next"))


@query("y07_hour_stats", f"{ST}, h AS (SELECT date_trunc('hour', published_at) AS hour, count(*) AS n, max(value) AS top FROM stream GROUP BY 1), s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 1 HOUR)) AS hour) SELECT s.hour, coalesce(n, 0) AS n, top FROM s LEFT JOIN h ON h.hour = s.hour")
def hour_stats(spark, sf_dir):
    from tagloom.operators.series import spine

    h = stream(spark, sf_dir).groupBy(F.date_trunc("hour", "published_at").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return spine(spark, "2024-01-10", "2024-01-12 01:00:00", "1 HOUR").join(h, "hour", "left").fillna(0, ["n"])


@query("y09_tolerance_match", "WITH a AS (SELECT l_suppkey AS k, l_linenumber AS m, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS k, l_linenumber AS m, sum(l_quantity) + any_value((l_suppkey % 7 = l_linenumber)::INT) * 40 AS y FROM lineitem GROUP BY ALL) SELECT k, bool_and(abs(x - y) <= greatest(6, 0.01 * y)) AS agrees, count(*) AS months FROM a JOIN b USING (k, m) GROUP BY k")
def tolerance_match(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("m")).agg(F.sum("l_quantity").alias("x"))
    y = x.select("k", "m", (F.col("x") + F.when(F.col("k") % 7 == F.col("m"), 40).otherwise(0)).alias("y"))
    return x.join(y, ["k", "m"]).groupBy("k").agg(F.bool_and(F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(6.0), 0.01 * F.col("y"))).alias("agrees"), F.count(F.lit(1)).alias("months"))


@query("y10_budget", "SELECT s_suppkey, least(5, greatest(0, 20 - s_suppkey % 23), greatest(0, 30 - s_nationkey)) AS budget FROM supplier")
def budget(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.least(F.lit(5), F.greatest(F.lit(0), 20 - F.col("s_suppkey") % 23), F.greatest(F.lit(0), 30 - F.col("s_nationkey"))).alias("budget"))


@query("y12_reconcile", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 4 <> 0) SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS action, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1")
def reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("va"), F.lit(True).alias("ina"))
    b = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("vb"), F.lit(True).alias("inb"))
    action = F.when(F.col("inb").isNull(), "missing").when(F.col("ina").isNull(), "extra").when(F.col("va") == F.col("vb"), "same").otherwise("changed")
    return a.join(b, "k", "full_outer").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("y13_interval_archive", "WITH p AS (SELECT o_custkey % 25 AS media, o_orderkey // 1000 AS pack, min(o_orderkey) - 1 AS lower, max(o_orderkey) AS upper, count(*) AS n FROM orders GROUP BY ALL) SELECT media, pack, n FROM p WHERE media IN (3, 7) AND lower < 5500 AND upper >= 5500")
def interval_archive(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("media"), F.floor(F.col("o_orderkey") / 1000).alias("pack")).agg((F.min("o_orderkey") - 1).alias("lower"), F.max("o_orderkey").alias("upper"), F.count(F.lit(1)).alias("n"))
    return p.where("media IN (3, 7) AND lower < 5500 AND upper >= 5500").select("media", "pack", "n")


@query("y16_list_direction", f"{A}, d AS (SELECT media, sign(epoch(lag(published_at) OVER w) - epoch(published_at)) AS s FROM articles WINDOW w AS (PARTITION BY media ORDER BY article_id)) SELECT media, sum(s)::BIGINT AS vote FROM d GROUP BY media")
def list_direction(spark, sf_dir):
    t = F.unix_micros(F.col("published_at").cast("timestamp"))
    w = Window.partitionBy("media").orderBy("article_id")
    return articles(spark, sf_dir).withColumn("s", F.signum(F.lag(t).over(w) - t)).groupBy("media").agg(F.sum("s").cast("long").alias("vote"))


@query("y17_history_dates", f"{A}, h AS (SELECT media, section, min(published_at) AS known FROM articles WHERE article_id % 3 = 0 GROUP BY ALL) SELECT article_id, coalesce(CASE WHEN article_id % 4 = 0 THEN published_at END, known) AS day FROM articles LEFT JOIN h USING (media, section)")
def history_dates(spark, sf_dir):
    rows = articles(spark, sf_dir)
    known = rows.where("article_id % 3 = 0").groupBy("media", "section").agg(F.min("published_at").alias("known"))
    return rows.join(known, ["media", "section"], "left").select("article_id", F.coalesce(F.when(F.col("article_id") % 4 == 0, F.col("published_at")), "known").alias("day"))


@query("y18_joined_update", f"{A}, e AS (SELECT l_orderkey AS article_id, min(l_shipdate) AS earliest FROM lineitem GROUP BY 1) SELECT article_id, CASE WHEN article_id % 5 = 0 AND earliest IS NOT NULL THEN earliest ELSE published_at END AS published_at FROM articles LEFT JOIN e USING (article_id)")
def joined_update(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.min("l_shipdate").alias("earliest"))
    return articles(spark, sf_dir).join(e, "article_id", "left").select("article_id", F.when((F.col("article_id") % 5 == 0) & F.col("earliest").isNotNull(), F.col("earliest")).otherwise(F.col("published_at")).alias("published_at"))


@query("y20_edition_twins", "WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$|/$|\\.html$', '') AS k FROM pages) SELECT b.page_id, min(a.page_id) AS twin_of FROM u a JOIN u b ON a.k = b.k AND a.page_id < b.page_id GROUP BY b.page_id")
def edition_twins(spark, sf_dir):
    """Pages of one path, whatever scheme, host, ending and query: the first stays, the others name it."""
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), r"[?#].*$|/$|\.html$", "").alias("k"))
    first = u.groupBy("k").agg(F.min("page_id").alias("twin_of"))
    return u.join(first, "k").where("page_id <> twin_of").select("page_id", "twin_of")


@query("y21_starter_suggestions", "WITH t AS (SELECT p_brand AS tag, l_suppkey % 25 AS media, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), top AS (SELECT tag FROM t GROUP BY tag ORDER BY sum(n) DESC, tag LIMIT 10) SELECT media, sum(n)::BIGINT AS volume FROM t WHERE tag IN (SELECT tag FROM top) GROUP BY media ORDER BY volume DESC, media LIMIT 12")
def starter_suggestions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("tag"), (F.col("l_suppkey") % 25).alias("media")).agg(F.count(F.lit(1)).alias("n"))
    top = t.groupBy("tag").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "tag").limit(10).select("tag")
    return t.join(top, "tag", "left_semi").groupBy("media").agg(F.sum("n").alias("volume")).orderBy(F.desc("volume"), "media").limit(12)


@query("y22_one_sidedness", f"{ST}, r AS (SELECT user_id, media % 3 AS camp, count(*) AS n FROM stream GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM r) SELECT user_id, camp, n FROM s WHERE total >= 5 AND n / total::DOUBLE >= 0.75")
def one_sidedness(spark, sf_dir):
    r = stream(spark, sf_dir).groupBy("user_id", (F.col("media") % 3).alias("camp")).agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("user_id")))
    return r.where((F.col("total") >= 5) & (F.col("n") / F.col("total") >= 0.75)).select("user_id", "camp", "n")


@query("y23_table_metrics", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 10000, 6) END AS share FROM supplier WHERE coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END, -1) BETWEEN -1 AND 0.5")
def table_metrics(spark, sf_dir):
    share = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10000)
    return table(spark, sf_dir, "supplier").where(F.coalesce(share, F.lit(-1.0)).between(-1, 0.5)).select("s_suppkey", F.round(share, 6).alias("share"))


@query("y26_series_runs", f"{ST}, h AS (SELECT date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream WHERE section = 'error' GROUP BY 1), s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08', INTERVAL 1 HOUR)) AS hour), d AS (SELECT s.hour, n FROM s LEFT JOIN h ON h.hour = s.hour), i AS (SELECT *, sum((n IS NULL)::INT) OVER (ORDER BY hour) AS island FROM d) SELECT island::BIGINT AS island, min(hour) AS first_hour, count(*) AS length, max(n) AS peak FROM i WHERE n IS NOT NULL GROUP BY island")
def series_runs(spark, sf_dir):
    from tagloom.operators.series import spine

    h = stream(spark, sf_dir).where("section = 'error'").groupBy(F.date_trunc("hour", "published_at").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    d = spine(spark, "2024-01-05", "2024-01-08 01:00:00", "1 HOUR").join(h, "hour", "left")
    i = d.withColumn("island", F.sum(F.col("n").isNull().cast("long")).over(Window.orderBy("hour")))
    return i.where("n IS NOT NULL").groupBy("island").agg(F.min("hour").alias("first_hour"), F.count(F.lit(1)).alias("length"), F.max("n").alias("peak"))
