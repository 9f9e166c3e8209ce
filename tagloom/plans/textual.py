"""Queries of text, URL, date, array and map functions, and of text similarity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.functions import text as X
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, TEXTS_SQL, articles, baskets, table, texts

A, B, TX = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, TEXTS_SQL))
LEGACY_SQL = f"{B}, l AS (SELECT article_id, string_agg('[' || tag || ']', '' ORDER BY tag) || '[x][]' AS legacy FROM baskets GROUP BY article_id)"


def legacy(spark, sf_dir):
    """Baskets with their tags in the old '[a][b]' form, with a tag that is too short and an empty one."""
    tags = baskets(spark, sf_dir).groupBy("article_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return tags.select("article_id", F.concat(X.join_legacy_tags(F.col("tags")), F.lit("[x][]")).alias("legacy"))


@query("k01_split_legacy_tags", f"{LEGACY_SQL}, s AS (SELECT article_id, unnest(string_split(replace(legacy, '[', ''), ']')) AS tag FROM l) SELECT article_id, tag FROM s WHERE strlen(tag) > 1")
def split_legacy_tags(spark, sf_dir):
    return legacy(spark, sf_dir).select("article_id", F.explode(X.split_legacy_tags(F.col("legacy"))).alias("tag"))


@query("k02_join_legacy_tags", f"{LEGACY_SQL} SELECT article_id, legacy FROM l")
def join_legacy_tags(spark, sf_dir):
    return legacy(spark, sf_dir)


@query("k05_strip_tags", "SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.strip_tags(F.col("html")), 256).alias("digest"))


@query("k06_between", "WITH p AS (SELECT page_id, strpos(html, '<h1>') AS a, substr(html, strpos(html, '<h1>') + 4) AS rest FROM pages) SELECT page_id, CASE WHEN a > 0 AND strpos(rest, '</h1>') > 0 THEN substr(rest, 1, strpos(rest, '</h1>') - 1) END AS head FROM p")
def between(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.between(F.col("html"), "<h1>", "</h1>").alias("head"))


TRACKERS_SQL = "utm_[a-z0-9_]+|fbclid|gclid|dclid|yclid|igshid|mc_cid|mc_eid|_ga|spm|rec"
STRIP_SQL = f"""b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, split_part(u, '?', 1) AS base, list_filter(string_split(substr(u, length(split_part(u, '?', 1)) + 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:{TRACKERS_SQL})(?:=|$)')) AS kept FROM b),
s AS (SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM q)"""


@query(
    "k08_url_key",
    f"""WITH {STRIP_SQL}, u AS (SELECT page_id, regexp_replace(url, '^[a-zA-Z]+://', '') AS u FROM s), h AS (SELECT page_id, regexp_extract(u, '^[^/?]*') AS host, u FROM u)
SELECT page_id, left(regexp_replace(lower(host), ':(?:80|443)$', '') || rtrim(split_part(substr(u, length(host) + 1), '?', 1), '/') || CASE WHEN contains(u, '?') THEN '?' || split_part(u, '?', 2) ELSE '' END, 512) AS key FROM h""",
)
def url_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_key(F.col("url")).alias("key"))


@query("k09_strip_tracking", f"WITH {STRIP_SQL} SELECT page_id, url FROM s")
def strip_tracking(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tracking(F.col("url")).alias("url"))


@query("k10_strip_title_suffix", "SELECT p_partkey, regexp_replace(p_name || ' - ' || p_brand, '\\s*[|–-]\\s*[^|–-]{1,20}$', '') AS title FROM part")
def strip_title_suffix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_title_suffix(F.concat_ws(" - ", "p_name", "p_brand")).alias("title"))


@query("k12_on_host", "SELECT page_id, lower(split_part(regexp_replace(url, '^[a-zA-Z]+://', ''), '/', 1)) LIKE '%.example.com' AS on_host FROM pages")
def on_host(spark, sf_dir):
    at = X.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", ((at == "example.com") | F.endswith(at, F.lit(".example.com"))).alias("on_host"))


@query("k13_domain_validation", "WITH h AS (SELECT page_id, lower(split_part(regexp_replace(url, '^[a-zA-Z]+://', ''), '/', 1)) AS host FROM pages) SELECT page_id, host, regexp_matches(host, '^([a-z0-9-]+\\.)+[a-z]{2,}$') AND NOT regexp_matches(host, '^m\\.') AS valid FROM h")
def domain_validation(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"))
    return h.withColumn("valid", F.col("host").rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$") & ~F.col("host").rlike(r"^m\."))


@query("k14_local_day", f"{A} SELECT article_id, CAST(collected_at + INTERVAL 8 HOUR AS DATE) AS day FROM articles")
def local_day(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.to_date(F.col("collected_at") + F.expr("INTERVAL 8 HOURS")).alias("day"))


@query("k15_hour_start", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def hour_start(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))


@query("k17_coverage_days", "WITH d AS (SELECT min(ts) AS a, max(ts) AS z FROM events), s AS (SELECT unnest(generate_series(CAST(a + INTERVAL 8 HOUR AS DATE)::TIMESTAMP, CAST(z + INTERVAL 8 HOUR AS DATE)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d) SELECT day FROM s ORDER BY day DESC LIMIT 14")
def coverage_days(spark, sf_dir):
    ends = table(spark, sf_dir, "events").agg(*[F.to_date(f("ts") + F.expr("INTERVAL 8 HOURS")).alias(n) for f, n in ((F.min, "a"), (F.max, "z"))])
    return ends.select(F.explode(F.sequence("a", "z")).alias("day")).orderBy(F.desc("day")).limit(14)


@query("k18_month_arithmetic", f"{A} SELECT article_id, strftime(published_at + INTERVAL 8 HOUR, '%Y%m') AS month, (year(published_at) - 1995) * 12 + month(published_at) - 1 AS month_index, CAST(date_trunc('month', published_at) + INTERVAL 3 MONTH AS DATE) AS quarter_on, day(last_day(published_at)) AS days FROM articles")
def month_arithmetic(spark, sf_dir):
    at = F.col("published_at")
    return articles(spark, sf_dir).select("article_id", F.date_format(at + F.expr("INTERVAL 8 HOURS"), "yyyyMM").alias("month"), ((F.year(at) - 1995) * 12 + F.month(at) - 1).cast("long").alias("month_index"), F.add_months(F.trunc(at, "month"), 3).alias("quarter_on"), F.dayofmonth(F.last_day(at)).cast("long").alias("days"))


@query("k19_url_date", "WITH u AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/news/' || strftime(o_orderdate, '%Y/%m/%d') || '/x' WHEN 1 THEN '/n' || strftime(o_orderdate, '%Y%m%d') || '.html' WHEN 2 THEN '/a-' || strftime(o_orderdate, '%Y-%m-%d') ELSE '/2099/99/99' END AS url, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM u")
def url_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= "2000-01-01")
    kind, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    url = F.when(kind == 0, F.concat(F.lit("/news/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/x"))).when(kind == 1, F.concat(F.lit("/n"), F.date_format(at, "yyyyMMdd"), F.lit(".html"))).when(kind == 2, F.concat(F.lit("/a-"), F.date_format(at, "yyyy-MM-dd"))).otherwise("/2099/99/99")
    return o.select("o_orderkey", X.url_date(url).alias("day"))


@query("k25_media_score", "SELECT n, 2 * (1 - power(0.5, n)) AS score FROM range(1, 40) t(n)")
def media_score(spark, sf_dir):
    from tagloom.operators.ranking import media_score as score

    return spark.range(1, 40).select(F.col("id").alias("n"), score(F.col("id")).alias("score"))


@query("k26_inverse_document_frequency", f"{B}, d AS (SELECT tag, count(*) AS df FROM baskets GROUP BY tag), n AS (SELECT count(DISTINCT article_id) AS n FROM baskets) SELECT tag, round(ln((n + 1) / (df + 1)::DOUBLE), 9) AS idf FROM d, n")
def idf(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    n = rows.agg(F.count_distinct("article_id").alias("n"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("tag", F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)), 9).alias("idf"))  # one row


@query("k28_log_edge_width", "WITH c AS (SELECT l_suppkey % 20 AS a, l_partkey % 20 AS b, count(*) AS c FROM lineitem GROUP BY ALL) SELECT a, b, round(1 + 7 * ln(c) / ln(max(c) OVER ()), 9) AS width FROM c")
def log_edge_width(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 20).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return c.crossJoin(F.broadcast(c.agg(F.max("c").alias("m")))).select("a", "b", F.round(1 + 7 * F.ln("c") / F.ln("m"), 9).alias("width"))  # one row


@query("k29_round_and_micro", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS price, CAST(round(l_discount * 1e6) AS BIGINT) AS micro FROM lineitem")
def round_and_micro(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("price"), F.round(F.col("l_discount") * 1e6).cast("long").alias("micro"))


@query("k29_round_and_micro_whole")
def round_and_micro_whole(spark, sf_dir):
    """The same over all rows."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("price"), F.round(F.col("l_discount") * 1e6).cast("long").alias("micro"))


@query("k30_sha256_ids", "SELECT p_partkey, sha256(p_brand || ':' || p_type) AS id FROM part")
def sha256_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws(":", "p_brand", "p_type"), 256).alias("id"))


@query("k31_sortable_ids", "SELECT o_orderkey, lpad((o_orderkey::HUGEINT * 1000000007)::VARCHAR, 20, '0') AS key FROM orders")
def sortable_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1000000007).cast("decimal(10,0)")).cast("decimal(20,0)").cast("string"), 20, "0").alias("key"))


@query("k32_array_functions", f"{B}, t AS (SELECT article_id, list(tag ORDER BY tag) AS tags FROM baskets GROUP BY 1) SELECT article_id, array_to_string(list_filter(tags, lambda x: x <> 'Brand#11')[1:3], '|') AS tags, len(tags) AS n FROM t")
def array_functions(spark, sf_dir):
    t = baskets(spark, sf_dir).groupBy("article_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return t.select("article_id", F.array_join(F.slice(F.filter("tags", lambda x: x != "Brand#11"), 1, 3), "|").alias("tags"), F.size("tags").cast("long").alias("n"))


@query("k33_map_functions", f"{B}, c AS (SELECT tag, media, count(*) AS n FROM baskets GROUP BY ALL) SELECT tag, sum(n)::BIGINT AS total, count(*) FILTER (n >= 20) AS strong FROM c GROUP BY tag")
def map_functions(spark, sf_dir):
    c = baskets(spark, sf_dir).groupBy("tag", "media").agg(F.count(F.lit(1)).alias("n")).groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("media", "n"))).alias("m"))
    return c.select("tag", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.map_filter("m", lambda k, v: v >= 20)).cast("long").alias("strong"))


@query("k35_clip_headline", f"{TX} SELECT article_id, CASE WHEN length(title) > 40 THEN left(title, 39) || '…' ELSE title END AS headline FROM texts")
def clip_headline(spark, sf_dir):
    return texts(spark, sf_dir).select("article_id", X.clip(F.col("title"), 40).alias("headline"))


@query("k36_reading_paragraphs", f"{TX}, p AS (SELECT article_id, unnest(string_split(body, chr(10))) AS p FROM texts) SELECT article_id, count(*) FILTER (length(p) >= 60) AS paragraphs, max(length(p)) AS longest FROM p GROUP BY article_id")
def reading_paragraphs(spark, sf_dir):
    parts = F.split("body", "\n")
    return texts(spark, sf_dir).select("article_id", F.size(F.filter(parts, lambda p: F.length(p) >= 60)).cast("long").alias("paragraphs"), F.array_max(F.transform(parts, F.length)).cast("long").alias("longest"))


@query("k38_cursor_codec", f"{A}, c AS (SELECT article_id, strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '_' || article_id AS cursor FROM articles) SELECT article_id, cursor, split_part(cursor, '_', 2)::BIGINT AS back FROM c")
def cursor_codec(spark, sf_dir):
    c = articles(spark, sf_dir).select("article_id", F.concat_ws("_", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("article_id").cast("string")).alias("cursor"))
    return c.withColumn("back", F.regexp_extract("cursor", "_(\\d+)$", 1).cast("long"))


@query("k40_share_bounds", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.8 WHEN p_size IS NOT NULL AND p_size >= 5 THEN p_size / 100.0::DOUBLE END AS share, p_partkey % 5 <> 0 AND p_size < 5 AS below FROM part")
def share_bounds(spark, sf_dir):
    given = F.col("p_partkey") % 5 == 0
    return table(spark, sf_dir, "part").select("p_partkey", F.when(given, F.lit(0.8)).when(F.col("p_size") >= 5, F.col("p_size") / 100.0).alias("share"), (~given & (F.col("p_size") < 5)).alias("below"))


@query("c06_json_table", "SELECT event_id, key AS name, value::INT AS k FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events)")
def json_table(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("name", "k"))


@query("c09_string_functions", "SELECT c_custkey, length(c_name) AS n, trim(c_mktsegment) AS segment, left(c_name, 4) AS head FROM customer")
def string_functions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.char_length("c_name").cast("long").alias("n"), F.trim("c_mktsegment").alias("segment"), F.left("c_name", F.lit(4)).alias("head"))


@query("c10_substring_index", "SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host, split_part(split_part(url, '//', 2), '/', 2) AS section FROM pages")
def substring_index(spark, sf_dir):
    rest = F.substring_index("url", "//", -1)
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index(rest, "/", 1).alias("host"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("section"))


@query("c12_time_differences", "SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS seconds, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 300 AS bucket FROM events")
def time_differences(spark, sf_dir):
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', date_trunc('second', ts))")
    return table(spark, sf_dir, "events").select("event_id", s.alias("seconds"), F.floor(s / 300).alias("bucket"))


@query("x01_body_normalisation", "SELECT doc_id, sha256(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS digest FROM documents")
def body_normalisation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalised(F.col("text")), 256).alias("digest"))


@query("x01_body_normalisation_whole")
def body_normalisation_whole(spark, sf_dir):
    """The same over all rows."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalised(F.col("text")), 256).alias("digest"))


SHINGLES_SQL = "n AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM documents), s AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 3)) AS i FROM n WHERE length(t) >= 5))"


@query("x02_shingle_counts", f"WITH {SHINGLES_SQL}, c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1) SELECT doc_id, coalesce(k, 0) AS shingles FROM n LEFT JOIN c USING (doc_id)")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.shingles(X.normalised(F.col("text")))).cast("long").alias("shingles"))


@query("x02_shingle_counts_whole")
def shingle_counts_whole(spark, sf_dir):
    """The same over all rows."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.shingles(X.normalised(F.col("text")))).cast("long").alias("shingles"))


@query("x03_eligibility", f"WITH {SHINGLES_SQL}, c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1) SELECT doc_id FROM n JOIN c USING (doc_id) WHERE length(t) >= 200 AND k >= 100")
def eligibility(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.normalised(F.col("text")).alias("t")).where(F.length("t") >= 200)
    return t.where(F.size(X.shingles(F.col("t"))) >= 100).select("doc_id")


@query("x03_eligibility_whole")
def eligibility_whole(spark, sf_dir):
    """The same over all rows."""
    t = table(spark, sf_dir, "documents").select("doc_id", X.normalised(F.col("text")).alias("t")).where(F.length("t") >= 200)
    return t.where(F.size(X.shingles(F.col("t"))) >= 100).select("doc_id")


@query("x16_title_dice", f"{B.replace('WITH ', 'WITH ')}, p AS (SELECT DISTINCT p_type FROM part), g AS (SELECT DISTINCT p_type, substr(lower(p_type), i, 2) AS b FROM (SELECT p_type, unnest(range(1, length(p_type))) AS i FROM p)), c AS (SELECT p_type, count(*) AS n FROM g GROUP BY 1) SELECT x.p_type AS a, y.p_type AS b, round(2 * count(*) / any_value(cx.n + cy.n)::DOUBLE, 6) AS dice FROM g x JOIN g y ON x.b = y.b AND x.p_type < y.p_type JOIN c cx ON cx.p_type = x.p_type JOIN c cy ON cy.p_type = y.p_type GROUP BY x.p_type, y.p_type")
def title_dice(spark, sf_dir):
    """Dice of the bigram sets of titles, through the bigrams they share."""
    t = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("s", X.shingles(F.lower("p_type"), 2))
    g = t.select("p_type", F.size("s").alias("n"), F.explode("s").alias("g"))
    x, y = (g.select(F.col("p_type").alias(c), F.col("n").alias(f"n{c}"), "g") for c in "ab")
    both = x.join(y, "g").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    return both.select("a", "b", F.round(2 * F.col("k") / (F.col("na") + F.col("nb")), 6).alias("dice"))


@query("x17_multiset_dice", "WITH p AS (SELECT DISTINCT p_type FROM part), g AS (SELECT p_type, substr(lower(p_type), i, 2) AS b, count(*) AS n FROM (SELECT p_type, unnest(range(1, length(p_type))) AS i FROM p) GROUP BY ALL), c AS (SELECT p_type, sum(n) AS n FROM g GROUP BY 1) SELECT x.p_type AS a, y.p_type AS b, round(2 * sum(least(x.n, y.n)) / any_value(cx.n + cy.n)::DOUBLE, 6) AS dice FROM g x JOIN g y ON x.b = y.b AND x.p_type < y.p_type JOIN c cx ON cx.p_type = x.p_type JOIN c cy ON cy.p_type = y.p_type GROUP BY x.p_type, y.p_type")
def multiset_dice(spark, sf_dir):
    low = F.lower("p_type")
    t = table(spark, sf_dir, "part").select("p_type").distinct()
    g = t.select("p_type", (F.length("p_type") - 1).alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.length("p_type") - 1), lambda i: F.substring(low, i, F.lit(2)))).alias("g")).groupBy("p_type", "size", "g").agg(F.count(F.lit(1)).alias("n"))
    x, y = (g.select(F.col("p_type").alias(c), F.col("size").alias(f"s{c}"), F.col("n").alias(f"n{c}"), "g") for c in "ab")
    both = x.join(y, "g").where("a < b").groupBy("a", "b", "sa", "sb").agg(F.sum(F.least("na", "nb")).alias("k"))
    return both.select("a", "b", F.round(2 * F.col("k") / (F.col("sa") + F.col("sb")), 6).alias("dice"))


@query("x27_wording_tags", f"{TX} SELECT article_id, contains(lower(title), 'the') AS a, regexp_matches(title, '!!') AS loud, regexp_matches(title, '[0-9]') AS digits FROM texts")
def wording_tags(spark, sf_dir):
    return texts(spark, sf_dir).select("article_id", F.contains(F.lower("title"), F.lit("the")).alias("a"), F.col("title").rlike("!!").alias("loud"), F.col("title").rlike("[0-9]").alias("digits"))


@query("x28_role_by_suffix", "WITH s(suffix, role) AS (VALUES ('TIN', 'metal'), ('OY TIN', 'alloy'), ('AL', 'kind'), ('STANDARD', 'grade')) SELECT p_partkey, first(role ORDER BY length(suffix) DESC) AS role FROM part JOIN s ON p_type LIKE '%' || suffix GROUP BY p_partkey")
def role_by_suffix(spark, sf_dir):
    """The longest known suffix decides: all suffixes of a name, joined by equality."""
    roles = spark.createDataFrame([("TIN", "metal"), ("OY TIN", "alloy"), ("AL", "kind"), ("STANDARD", "grade")], "suffix string, role string")
    tails = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("p_type")), lambda i: F.substring("p_type", i, F.length("p_type")))).alias("suffix"))
    return tails.join(roles, "suffix").groupBy("p_partkey").agg(F.max_by("role", F.length("suffix")).alias("role"))


@query("x32_readable_lines", f"{TX}, p AS (SELECT article_id, unnest(string_split(body, chr(10))) AS p FROM texts) SELECT article_id, count(*) AS lines FROM p WHERE length(p) >= 60 OR (length(p) >= 20 AND p LIKE '%.') GROUP BY article_id")
def readable_lines(spark, sf_dir):
    good = F.filter(F.split("body", "\n"), lambda p: (F.length(p) >= 60) | ((F.length(p) >= 20) & F.endswith(p, F.lit("."))))
    return texts(spark, sf_dir).select("article_id", F.size(good).cast("long").alias("lines")).where("lines > 0")


@query("x34_content_kind", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.html?([?#]|$)') THEN 'page' WHEN regexp_matches(url, '[?&]page=') THEN 'list' ELSE 'other' END AS kind FROM pages")
def content_kind(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").rlike(r"\.html?([?#]|$)"), "page").when(F.col("url").rlike("[?&]page="), "list").otherwise("other").alias("kind"))


@query("x37_topic_kind", f"{A}, t AS (SELECT media, section, min(published_at) AS a, max(published_at) AS z, count(*) AS n FROM articles WHERE published_at < TIMESTAMP '2001-06-01' GROUP BY ALL) SELECT media, section, CASE WHEN z < TIMESTAMP '2001-06-01' - INTERVAL 90 DAY THEN 'ended' WHEN z < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY AND z - a <= INTERVAL 21 DAY THEN 'feature' WHEN n >= 100 THEN 'growing' ELSE 'topic' END AS kind FROM t")
def topic_kind(spark, sf_dir):
    now = F.lit("2001-06-01").cast("timestamp_ntz")
    t = articles(spark, sf_dir).where(F.col("published_at") < now).groupBy("media", "section").agg(F.min("published_at").alias("a"), F.max("published_at").alias("z"), F.count(F.lit(1)).alias("n"))
    quiet = now - F.col("z")
    kind = F.when(quiet > F.expr("INTERVAL 90 DAYS"), "ended").when((quiet > F.expr("INTERVAL 30 DAYS")) & (F.col("z") - F.col("a") <= F.expr("INTERVAL 21 DAYS")), "feature").when(F.col("n") >= 100, "growing").otherwise("topic")
    return t.select("media", "section", kind.alias("kind"))


@query("s10_published_time_cascade", "SELECT o_orderkey, o_orderdate AS published_at FROM orders")
def published_time_cascade(spark, sf_dir):
    """Times written in four ways, parsed by the first format that fits; zone-less local times are UTC+8."""
    o, kind, at = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3, F.col("o_orderdate")
    local = at + F.expr("INTERVAL 8 HOURS")
    raw = F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format(local, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(local, "yyyyMMddHHmmss"))
    less = F.expr("INTERVAL 8 HOURS")
    parsed = F.coalesce(
        F.try_to_timestamp(F.regexp_extract("raw", "^(.*T.*)Z$", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"),
        F.try_to_timestamp("raw", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - less,
        F.try_to_timestamp("raw", F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz") - less,
    )
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", parsed.alias("published_at"))


@query("s15_legacy_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no-date' WHEN o_orderkey % 5 = 0 THEN 'no-tags' END AS issue, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS day FROM orders")
def legacy_rows(spark, sf_dir):
    """Old rows with a textual date and tags, and the first issue of each."""
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(key, F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("0000-00-00").alias("date"), F.when(key % 5 != 0, "[a1][b2]").otherwise("[][x]").alias("tags"))
    day = F.try_to_date("date", "yyyy-MM-dd")
    return raw.select("o_orderkey", F.when(day.isNull(), "no-date").when(F.size(X.split_legacy_tags(F.col("tags"))) == 0, "no-tags").alias("issue"), day.alias("day"))
