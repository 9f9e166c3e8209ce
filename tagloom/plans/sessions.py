"""Queries of sessions, feeds, sources and sinks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import search as S
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, articles, baskets, stream, table

A, B, ST = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, STREAM_SQL))


@query("r06_inactivity_sessions", f"{ST}, g AS (SELECT user_id, published_at, CASE WHEN published_at - lag(published_at) OVER (PARTITION BY user_id ORDER BY published_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM stream), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY published_at) AS k FROM g) SELECT user_id, min(published_at) AS start, max(published_at) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def inactivity_sessions(spark, sf_dir):
    s = stream(spark, sf_dir).groupBy(F.session_window("published_at", "6 hours").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


@query("s11_csv_listing", "SELECT p_partkey AS id, p_name AS title, p_size AS size FROM part")
def csv_listing(spark, sf_dir):
    """Lines of CSV text parsed with a schema."""
    line = F.to_csv(F.struct("p_partkey", "p_name", "p_size"))
    return table(spark, sf_dir, "part").select(F.from_csv(line, "id long, title string, size int").alias("r")).select("r.*")


@query("s12_json_listing", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_listing(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("s14_json_lines", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 10 <> 0 AS valid FROM events WHERE length(props) <= 100")
def json_lines(spark, sf_dir):
    """Lines of JSON of bounded length; broken ones give nulls."""
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    got = table(spark, sf_dir, "events").where(F.octet_length("props") <= 100).select("event_id", F.from_json(line, "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return got.select("event_id", F.col("r.k").alias("k"), F.col("r._bad").isNull().alias("valid"))


@query("s06_feed_items", "SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, o_orderdate AS published_at FROM orders")
def feed_items(spark, sf_dir):
    """Items of RSS text: one XML element for each, parsed with XPath; zone-less times are UTC+8."""
    local = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss")
    item = F.concat(F.lit("<item><guid>"), F.col("o_orderkey").cast("string"), F.lit("</guid><title>Order "), F.col("o_orderkey").cast("string"), F.lit("</title><pubDate>"), local, F.lit("</pubDate></item>"))
    x = table(spark, sf_dir, "orders").select(item.alias("x"))
    at = F.try_to_timestamp(F.xpath_string("x", F.lit("item/pubDate")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - F.expr("INTERVAL 8 HOURS")
    return x.select(F.xpath_long("x", F.lit("item/guid")).alias("id"), F.xpath_string("x", F.lit("item/title")).alias("title"), at.alias("published_at"))


@query("s06_feed_items_whole", "SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, o_orderdate AS published_at FROM orders")
def feed_items_whole(spark, sf_dir):
    """The same over all rows."""
    local = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss")
    item = F.concat(F.lit("<item><guid>"), F.col("o_orderkey").cast("string"), F.lit("</guid><title>Order "), F.col("o_orderkey").cast("string"), F.lit("</title><pubDate>"), local, F.lit("</pubDate></item>"))
    x = table(spark, sf_dir, "orders").select(item.alias("x"))
    at = F.try_to_timestamp(F.xpath_string("x", F.lit("item/pubDate")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - F.expr("INTERVAL 8 HOURS")
    return x.select(F.xpath_long("x", F.lit("item/guid")).alias("id"), F.xpath_string("x", F.lit("item/title")).alias("title"), at.alias("published_at"))


@query("s07_link_discovery", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l WHERE length(href) >= 4 GROUP BY ALL")
def link_discovery(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)).alias("href"))
    return links.where(F.length("href") >= 4).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("s08_article_fields", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, coalesce(nullif(regexp_extract(html, '<meta name=\"keywords\" content=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '')) AS head FROM pages")
def article_fields(spark, sf_dir):
    """A cascade of places for each field of a page."""
    get = lambda p: F.regexp_extract("html", p, 1)
    found = lambda p: F.when(get(p) != "", get(p))
    return table(spark, sf_dir, "pages").select("page_id", get("<title>([^<]*)</title>").alias("title"), get('<html lang="([a-z]+)"').alias("lang"), F.coalesce(found('<meta name="keywords" content="([^"]*)"'), found("<h1>([^<]*)</h1>")).alias("head"))


@query("s21_feed_sink", f"{A}, n AS (SELECT article_id, media, published_at FROM articles ORDER BY published_at DESC, article_id DESC LIMIT 50) SELECT article_id, '<item><guid>' || article_id || '</guid><source>' || media || '</source><pubDate>' || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') || '</pubDate></item>' AS item FROM n")
def feed_sink(spark, sf_dir):
    n = articles(spark, sf_dir).orderBy(F.desc("published_at"), F.desc("article_id")).limit(50)
    parts = [F.lit("<item><guid>"), F.col("article_id").cast("string"), F.lit("</guid><source>"), F.col("media").cast("string"), F.lit("</source><pubDate>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>")]
    return n.select("article_id", F.concat(*parts).alias("item"))


@query("s22_sitemap_sink", f"{B}, t AS (SELECT tag, count(*) AS n FROM baskets GROUP BY tag), d AS (SELECT media, count(DISTINCT published_at::DATE) AS days FROM baskets GROUP BY media) SELECT '/tag/' || tag AS path FROM t WHERE n >= 100 UNION ALL SELECT '/outlet/' || media FROM d WHERE days >= 2")
def sitemap_sink(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    tags = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 100").select(F.concat(F.lit("/tag/"), "tag").alias("path"))
    outlets = rows.groupBy("media").agg(F.count_distinct(F.to_date("published_at")).alias("days")).where("days >= 2").select(F.concat(F.lit("/outlet/"), F.col("media").cast("string")).alias("path"))
    return tags.unionByName(outlets)


@query("s23_vocabulary_pages", f"{B}, t AS (SELECT tag, count(*) AS n FROM baskets GROUP BY tag), r AS (SELECT tag, n, (row_number() OVER (ORDER BY tag) - 1) // 10 AS page FROM t) SELECT page, count(*) AS terms, sha256(string_agg(tag || ':' || n, ',' ORDER BY tag)) AS digest FROM r GROUP BY page")
def vocabulary_pages(spark, sf_dir):
    """Pages of ten terms with a digest of each."""
    t = baskets(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    r = S.numbered(t, "tag", name="place").withColumn("page", F.floor((F.col("place") - 1) / 10)).drop("place")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", "n"))), lambda x: F.concat_ws(":", x["tag"], x["n"].cast("string"))), ",")
    return r.groupBy("page").agg(F.count(F.lit(1)).alias("terms"), F.sha2(line, 256).alias("digest"))
