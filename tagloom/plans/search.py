"""Queries of scans, filters, joins, set operations, sorts and pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import search as S
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, TEXTS_SQL, articles, baskets, stream, table, texts

A, B, ST, TX = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, TEXTS_SQL))
W = "published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-01-31'"


def in_window(rows):
    return rows.where(S.half_open(F.col("published_at"), "1998-01-01", "1998-01-31"))


@query("s01_bounded_scan", f"{B} SELECT article_id, media, count(*) AS tags FROM baskets WHERE {W} AND media IN (1, 2, 3, 5, 8) GROUP BY ALL")
def bounded_scan(spark, sf_dir):
    return in_window(baskets(spark, sf_dir)).where(F.col("media").isin(1, 2, 3, 5, 8)).groupBy("article_id", "media").agg(F.count(F.lit(1)).alias("tags"))


@query("s02_exploded_tag_index", "SELECT DISTINCT o_orderkey AS article_id, left(p_type, 60) AS tag, o_orderdate AS published_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def exploded_tag_index(spark, sf_dir):
    """Articles with an array of tags, exploded to distinct, cut-off tags."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    arrays = items.groupBy(F.col("l_orderkey").alias("article_id")).agg(F.collect_list("p_type").alias("tags"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").alias("published_at"))
    return orders.join(arrays, "article_id").select("article_id", F.explode(F.array_distinct(F.transform("tags", lambda t: F.substring(t, 1, 60)))).alias("tag"), "published_at")


@query("s03_sliced_fold", f"{B} SELECT tag, count(*) AS n FROM baskets WHERE published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-01-08' GROUP BY tag")
def sliced_fold(spark, sf_dir):
    return baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-01", "1998-01-08")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("s04_snapshot_scan", f"{A} SELECT media, count(*) AS rows, min(article_id) AS low, max(article_id) AS high FROM articles GROUP BY media")
def snapshot_scan(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("media").agg(F.count(F.lit(1)).alias("rows"), F.min("article_id").alias("low"), F.max("article_id").alias("high"))


@query("s05_hydration", f"{A} SELECT article_id, published_at, size FROM articles WHERE article_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def hydration(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("article_id"))
    return articles(spark, sf_dir).join(ids, "article_id", "left_semi").select("article_id", "published_at", "size")


@query("s18_upsert_merge", f"{A}, o AS (SELECT media, min(published_at) AS a, max(published_at) AS b, max(size) AS c FROM articles WHERE published_at < TIMESTAMP '1998-01-01' GROUP BY media), n AS (SELECT media, min(published_at) AS a, max(published_at) AS b, max(size) AS c FROM articles WHERE {W} GROUP BY media), u AS (SELECT * FROM o UNION ALL SELECT * FROM n) SELECT media, min(a) AS first, max(b) AS last, max(c) AS peak FROM u GROUP BY media")
def upsert_merge(spark, sf_dir):
    rows = articles(spark, sf_dir)
    stats = lambda x: x.groupBy("media").agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.max("size").alias("peak"))
    return S.upsert(stats(rows.where(F.col("published_at") < "1998-01-01")), stats(in_window(rows)), "media")


@query("s19_insert_ignore", f"{A}, o AS (SELECT * FROM articles WHERE published_at < TIMESTAMP '1998-01-15'), n AS (SELECT * FROM articles WHERE {W}) SELECT article_id, 'old' AS origin FROM o UNION ALL SELECT article_id, 'new' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.article_id = n.article_id)")
def insert_ignore(spark, sf_dir):
    rows = articles(spark, sf_dir)
    old, new = rows.where(F.col("published_at") < "1998-01-15").select("article_id"), in_window(rows).select("article_id")
    return old.withColumn("origin", F.lit("old")).unionByName(new.join(old, "article_id", "left_anti").withColumn("origin", F.lit("new")))


@query("s26_discovery_index", f"{A}, d AS (SELECT l_orderkey AS article_id, l_suppkey % 7 AS finder FROM lineitem) SELECT d.finder, a.media, count(DISTINCT a.article_id) AS found FROM d JOIN articles a USING (article_id) WHERE d.finder <> a.media GROUP BY ALL")
def discovery_index(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), (F.col("l_suppkey") % 7).alias("finder"))
    return found.join(articles(spark, sf_dir), "article_id").where("finder <> media").groupBy("finder", "media").agg(F.count_distinct("article_id").alias("found"))


@query("f01_windows", f"{A} SELECT count(*) FILTER ({W}) AS half_open, count(*) FILTER (published_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31') AS closed FROM articles")
def windows(spark, sf_dir):
    at = F.col("published_at")
    return articles(spark, sf_dir).agg(F.count_if(S.half_open(at, "1998-01-01", "1998-01-31")).alias("half_open"), F.count_if(S.closed(at, "1998-01-01", "1998-01-31")).alias("closed"))


@query("f02_text_or_tag", "SELECT p_partkey AS article_id FROM part WHERE contains(lower(p_name), 'part 1') OR p_brand = 'Brand#11'")
def text_or_tag(spark, sf_dir):
    return table(spark, sf_dir, "part").where(S.text_or_tag([F.col("p_name")], F.array("p_brand"), "Part 1") | S.text_or_tag([], F.array("p_brand"), "Brand#11")).select(F.col("p_partkey").alias("article_id"))


@query("f03_author_like", "WITH a AS (SELECT l_orderkey AS article_id, 'Supplier ' || l_suppkey AS author FROM lineitem) SELECT DISTINCT article_id FROM a WHERE contains(author, 'er 1')")
def author_like(spark, sf_dir):
    """Articles with a credit that holds the text: credits are searched row by row where they are stored, before they are gathered."""
    credit = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").where(F.contains(credit, F.lit("er 1"))).select(F.col("l_orderkey").alias("article_id")).distinct()


ITEMS = "l_orderkey AS article_id, l_suppkey, l_returnflag, l_linestatus"


@query("f04_struct_search", "SELECT DISTINCT l_orderkey AS article_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def struct_search(spark, sf_dir):
    """Articles with a part whose fields have both values: the condition reaches the scan of the parts."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'").select(F.col("l_orderkey").alias("article_id")).distinct()


@query("f05_array_contains", f"{B} SELECT article_id FROM baskets WHERE tag = 'Brand#12'")
def array_contains(spark, sf_dir):
    """Containment on exploded tags (one row a tag), where the condition reaches the scan; ``c02_json_contains`` searches stored arrays."""
    return baskets(spark, sf_dir).where("tag = 'Brand#12'").select("article_id")


@query("f06_arrays_overlap", f"{B} SELECT DISTINCT article_id FROM baskets WHERE tag IN ('Brand#12', 'Brand#33')")
def arrays_overlap(spark, sf_dir):
    return baskets(spark, sf_dir).where("tag IN ('Brand#12', 'Brand#33')").select("article_id").distinct()


@query("f07_media_set_algebra", f"{A} SELECT media, count(*) AS n FROM articles WHERE media IN (SELECT media FROM articles WHERE camp <> 'blue') AND media IN (SELECT s_suppkey % 25 FROM supplier WHERE s_acctbal > 5000) AND media NOT IN (3, 4) GROUP BY media")
def media_set_algebra(spark, sf_dir):
    rows = articles(spark, sf_dir)
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select((F.col("s_suppkey") % 25).alias("media"))
    return rows.where(F.col("camp") != "blue").join(rich, "media", "left_semi").where(~F.col("media").isin(3, 4)).groupBy("media").agg(F.count(F.lit(1)).alias("n"))


@query("f08_pending_dates", f"{A} SELECT media, count(*) FILTER (article_id % 4 = 0 AND published_at = collected_at) AS pending, count(*) FILTER (NOT (article_id % 4 = 0 AND published_at = collected_at)) AS dated FROM articles GROUP BY media")
def pending_dates(spark, sf_dir):
    """Undated rows: never fetched and published when collected."""
    fetched = F.when(F.col("article_id") % 4 != 0, F.col("collected_at"))
    pending = fetched.isNull() & F.col("published_at").eqNullSafe(F.col("collected_at"))
    return articles(spark, sf_dir).groupBy("media").agg(F.count_if(pending).alias("pending"), F.count_if(~pending).alias("dated"))


@query("f10_own_media_tags", f"{B} SELECT media, tag, count(*) AS n FROM baskets WHERE lower(replace(tag, '#', '')) <> 'brand' || (media + 10) GROUP BY ALL")
def own_media_tags(spark, sf_dir):
    """Tags that name the outlet itself go, after normalising."""
    rows = baskets(spark, sf_dir)
    alias = rows.select("media", F.concat(F.lit("brand"), (F.col("media") + 10).cast("string")).alias("name")).distinct()
    left = rows.withColumn("name", F.lower(F.regexp_replace("tag", "#", ""))).join(alias, ["media", "name"], "left_anti")
    return left.groupBy("media", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("f11_basis_filter", f"{A} SELECT media, count(*) AS n FROM articles WHERE media IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY media")
def basis_filter(spark, sf_dir):
    roster = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("media"))
    return articles(spark, sf_dir).join(roster, "media", "left_semi").groupBy("media").agg(F.count(F.lit(1)).alias("n"))


@query("f12_site_tags", f"{ST}, g AS (SELECT tag FROM stream GROUP BY tag HAVING count(*) >= 8 AND count(DISTINCT media) = 1) SELECT tag, count(*) AS n FROM stream WHERE tag NOT IN (SELECT tag FROM g) GROUP BY tag")
def site_tags(spark, sf_dir):
    rows = stream(spark, sf_dir)
    own = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("media").alias("m")).where("n >= 8 AND m = 1")
    return rows.join(own, "tag", "left_anti").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("f13_boilerplate_tags", f"{B}, a AS (SELECT section, media, count(DISTINCT article_id) AS k FROM baskets WHERE {W} GROUP BY ALL), t AS (SELECT section, media, tag, count(*) AS n FROM baskets WHERE {W} GROUP BY ALL) SELECT section, media, tag, n FROM t JOIN a USING (section, media) WHERE NOT (k >= 2 AND n >= 0.8 * k)")
def boilerplate_tags(spark, sf_dir):
    rows = in_window(baskets(spark, sf_dir))
    size = rows.groupBy("section", "media").agg(F.count_distinct("article_id").alias("k"))
    used = rows.groupBy("section", "media", "tag").agg(F.count(F.lit(1)).alias("n"))
    worn = used.join(size, ["section", "media"]).where("k >= 2 AND n >= 0.8 * k").select("section", "media", "tag")
    return used.join(worn, ["section", "media", "tag"], "left_anti")


@query("f14_term_usability", "SELECT p_type AS term FROM part WHERE length(p_type) BETWEEN 2 AND 30 AND NOT regexp_matches(p_type, '^[0-9]+$') AND p_type NOT IN ('ECONOMY', 'PROMO') GROUP BY p_type")
def term_usability(spark, sf_dir):
    term = F.col("p_type")
    return table(spark, sf_dir, "part").where(F.length(term).between(2, 30) & ~term.rlike("^[0-9]+$") & ~term.isin("ECONOMY", "PROMO")).select(term.alias("term")).distinct()


@query("f17_pair_evidence", "SELECT l_orderkey AS a, l_partkey AS b, l_discount AS score FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag IN ('A', 'R') AND l_quantity >= 30")
def pair_evidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where((F.col("l_discount") >= 0.05) & F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") >= 30)).select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("score"))


@query("f19_all_words", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'idiot')")
def all_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(S.all_words(F.col("text"), ["The", "idiot"])).select("doc_id")


@query("f22_public_window", f"{A} SELECT article_id, CASE WHEN published_at + INTERVAL 7 DAY > TIMESTAMP '1998-01-31' THEN round(size, 2) END AS size FROM articles WHERE {W}")
def public_window(spark, sf_dir):
    return in_window(articles(spark, sf_dir)).select("article_id", F.when(F.col("published_at") + F.expr("INTERVAL 7 DAYS") > F.lit("1998-01-31").cast("timestamp_ntz"), F.round("size", 2)).alias("size"))


@query("f23_due_sources", f"{A}, l AS (SELECT media, max(published_at) AS last_run FROM articles WHERE {W} AND media % 4 <> 0 GROUP BY media), m AS (SELECT DISTINCT media FROM articles) SELECT m.media, last_run, row_number() OVER (ORDER BY last_run NULLS FIRST, m.media) AS turn FROM m LEFT JOIN l ON l.media = m.media WHERE last_run IS NULL OR last_run <= TIMESTAMP '1998-01-30'")
def due_sources(spark, sf_dir):
    rows = articles(spark, sf_dir)
    last = in_window(rows).where("media % 4 <> 0").groupBy("media").agg(F.max("published_at").alias("last_run"))
    due = rows.select("media").distinct().join(last, "media", "left").where(F.col("last_run").isNull() | (F.col("last_run") <= F.lit("1998-01-30").cast("timestamp_ntz")))
    return due.withColumn("turn", F.row_number().over(Window.orderBy(F.asc_nulls_first("last_run"), "media")).cast("long"))


@query("f24_exclusion_list", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1)")
def exclusion_list(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(out, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("f25_residue", "SELECT p_type, count(*) AS n FROM part WHERE NOT regexp_matches(p_type, '(TIN|^S)') GROUP BY p_type")
def residue(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~F.col("p_type").rlike("(TIN|^S)")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("f26_health_status", f"{A}, s AS (SELECT media, max(published_at) AS last_at, count(*) FILTER (size < 50000) AS failed, count(*) AS n FROM articles GROUP BY media) SELECT media, CASE WHEN media % 11 = 0 THEN 'disabled' WHEN failed > 0.15 * n THEN 'failing' WHEN last_at < TIMESTAMP '2001-07-30' THEN 'stale' ELSE 'ok' END AS status FROM s")
def health_status(spark, sf_dir):
    s = articles(spark, sf_dir).groupBy("media").agg(F.max("published_at").alias("last_at"), F.count_if(F.col("size") < 50000).alias("failed"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("media") % 11 == 0, "disabled").when(F.col("failed") > 0.15 * F.col("n"), "failing").when(F.col("last_at") < F.lit("2001-07-30").cast("timestamp_ntz"), "stale").otherwise("ok")
    return s.select("media", status.alias("status"))


@query("j01_tag_article_join", f"{B} SELECT tag, media, count(*) AS n FROM baskets WHERE {W} GROUP BY ALL")
def tag_article_join(spark, sf_dir):
    return in_window(baskets(spark, sf_dir)).groupBy("tag", "media").agg(F.count(F.lit(1)).alias("n"))


@query("j02_left_join", "SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def left_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


@query("j03_co_occurrence", f"{B}, w AS (SELECT * FROM baskets WHERE {W}) SELECT x.tag AS a, y.tag AS b, count(*) AS shared FROM w x JOIN w y ON x.article_id = y.article_id AND x.tag <> y.tag GROUP BY ALL")
def co_occurrence(spark, sf_dir):
    return S.co_occurrence(in_window(baskets(spark, sf_dir)))


@query("j04_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("j05_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    late, big = o.where(F.col("o_orderdate") >= "2000-01-01").select("c_custkey"), o.where("o_totalprice > 450000").select("c_custkey")
    return table(spark, sf_dir, "customer").join(late, "c_custkey", "left_anti").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("j06_left_join_is_null", "SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 WHERE l_partkey IS NULL")
def left_join_is_null(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("j07_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(spark, sf_dir):
    who = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(who, "o_custkey", "left_semi").select("o_orderkey")


@query("j08_folded_join", "WITH a AS (SELECT DISTINCT upper(event_type) AS t FROM events), b AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT a.t AS label, sum(CASE WHEN a.t = b.event_type THEN n ELSE 0 END)::BIGINT AS exact, sum(n)::BIGINT AS folded FROM a JOIN b ON lower(a.t) = lower(b.event_type) GROUP BY 1")
def folded_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.select(F.upper("event_type").alias("label")).distinct(), e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("event_type"), F.col("n")).otherwise(0)
    return a.join(b, F.lower("label") == F.lower("event_type")).groupBy("label").agg(F.sum(hit).alias("exact"), F.sum("n").alias("folded"))


@query("j09_dimension_join", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def dimension_join(spark, sf_dir):
    where = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("j10_either_end", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8) OR l_suppkey IN (1, 2, 3, 5, 8)")
def either_end(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return S.either_end(pairs, spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8)], "id long"))


@query("j11_time_band_join", f"{ST} SELECT x.article_id AS a, y.article_id AS b FROM stream x JOIN stream y ON x.user_id = y.user_id AND x.article_id < y.article_id AND x.section <> y.section AND abs(epoch(x.published_at) - epoch(y.published_at)) <= 21600")
def time_band_join(spark, sf_dir):
    """Pairs of one user within six hours of each other: an equi-join on neighbouring six-hour bands."""
    rows = stream(spark, sf_dir).select("article_id", "user_id", "section", F.unix_seconds(F.col("published_at").cast("timestamp")).alias("t"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', published_at)").alias("us"))
    width = 6 * 3600 * 1_000_000
    band = F.floor(F.col("us") / width)
    x = rows.select(F.col("article_id").alias("a"), "user_id", F.col("section").alias("sa"), F.col("us").alias("ta"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    y = rows.select(F.col("article_id").alias("b"), "user_id", F.col("section").alias("sb"), F.col("us").alias("tb"), band.alias("band"))
    return x.join(y, ["user_id", "band"]).where((F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb")) & (F.abs(F.col("ta") - F.col("tb")) <= width)).select("a", "b")


@query("j18_orient_pairs", "SELECT own, count(*) AS pairs, sum(other)::BIGINT AS others FROM (SELECT l_suppkey AS own, l_partkey % 10 AS other FROM lineitem UNION ALL SELECT l_partkey % 10, l_suppkey FROM lineitem) GROUP BY own")
def orient_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 10).alias("b"))
    sides = rows.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("p")).select("p.*")
    return sides.groupBy("own").agg(F.count(F.lit(1)).alias("pairs"), F.sum("other").alias("others"))


@query("j19_reverse_membership", f"{B} SELECT article_id, string_agg(tag, ',' ORDER BY tag) AS topics FROM baskets WHERE {W} AND tag LIKE 'Brand#1%' GROUP BY article_id")
def reverse_membership(spark, sf_dir):
    """Topics hold lists of articles; each article's topics."""
    topics = in_window(baskets(spark, sf_dir)).where(F.col("tag").startswith("Brand#1")).groupBy("tag").agg(F.collect_set("article_id").alias("stories"))
    return topics.select("tag", F.explode("stories").alias("article_id")).groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("topics"))


@query("j20_two_source_merge", "WITH a AS (SELECT o_custkey % 25 AS media, count(*) AS published FROM orders WHERE o_custkey % 25 < 20 GROUP BY 1), b AS (SELECT l_suppkey % 25 AS media, count(*) AS found FROM lineitem WHERE l_suppkey % 25 > 5 GROUP BY 1) SELECT coalesce(a.media, b.media) AS media, coalesce(published, 0) AS published, coalesce(found, 0) AS found FROM a FULL JOIN b ON a.media = b.media")
def two_source_merge(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("media")).where("media < 20").groupBy("media").agg(F.count(F.lit(1)).alias("published"))
    b = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("media")).where("media > 5").groupBy("media").agg(F.count(F.lit(1)).alias("found"))
    return a.join(b, "media", "full_outer").fillna(0)


@query("j21_all_tags", f"{B} SELECT article_id FROM baskets WHERE tag IN ('Brand#11', 'Brand#22') GROUP BY article_id HAVING count(DISTINCT tag) = 2")
def all_tags(spark, sf_dir):
    return S.holding_all(baskets(spark, sf_dir), ["Brand#11", "Brand#22"])


@query("j22_some_tags", f"{B}, g(group_id, tag) AS (VALUES (1, 'Brand#11'), (1, 'Brand#12'), (1, 'Brand#13'), (1, 'Brand#14'), (2, 'Brand#51'), (2, 'Brand#52'), (2, 'Brand#53')) SELECT group_id, article_id, count(DISTINCT tag) AS hits FROM baskets JOIN g USING (tag) GROUP BY ALL HAVING count(DISTINCT tag) >= 2")
def some_tags(spark, sf_dir):
    groups = spark.createDataFrame([(1, f"Brand#1{i}") for i in range(1, 5)] + [(2, f"Brand#5{i}") for i in range(1, 4)], "group_id int, tag string")
    return S.holding_some(baskets(spark, sf_dir), groups, 2)


@query("j24_host_argmax", "WITH h AS (SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host, page_id % 7 AS media, count(*) AS n FROM pages GROUP BY ALL) SELECT host, first(media ORDER BY n DESC, media) AS media, sum(n)::BIGINT AS pages FROM h GROUP BY host")
def host_argmax(spark, sf_dir):
    host = F.substring_index(F.regexp_replace("url", "^https?://", ""), "/", 1)
    counts = table(spark, sf_dir, "pages").groupBy(host.alias("host"), (F.col("page_id") % 7).alias("media")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("host").agg(F.max_by("media", F.struct("n", -F.col("media"))).alias("media"), F.sum("n").alias("pages"))


@query("u01_union_distinct", "SELECT l_suppkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("id")).union(table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_suppkey")).distinct()


@query("u02_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'part' FROM part) GROUP BY kind")
def union_all(spark, sf_dir):
    parts = [table(spark, sf_dir, k).select(F.lit(k).alias("kind")) for k in ("customer", "supplier", "part")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u03_intersect", "SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("u04_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1-%'")
def except_(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1-%'").select("o_custkey"))


@query("u05_snapshot_changes", f"{B}, o AS (SELECT tag, count(*) AS n FROM baskets WHERE published_at < TIMESTAMP '1995-01-03' GROUP BY tag), n AS (SELECT tag, count(*) AS n FROM baskets WHERE published_at >= TIMESTAMP '1995-01-02' AND published_at < TIMESTAMP '1995-01-04' GROUP BY tag) SELECT coalesce(o.tag, n.tag) AS tag, CASE WHEN n.tag IS NULL THEN 'absent' ELSE 'upsert' END AS change, n.n FROM o FULL JOIN n ON o.tag = n.tag WHERE o.tag IS NULL OR n.tag IS NULL OR o.n <> n.n")
def snapshot_changes(spark, sf_dir):
    count = lambda x: x.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    rows = baskets(spark, sf_dir)
    return S.changes(count(rows.where(F.col("published_at") < "1995-01-03")), count(rows.where(S.half_open(F.col("published_at"), "1995-01-02", "1995-01-04"))), "tag", "n")


@query("u06_last_writer", f"{ST} SELECT user_id, section, article_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, section ORDER BY article_id DESC) AS r FROM stream) WHERE r = 1")
def last_writer(spark, sf_dir):
    return S.last_writer(stream(spark, sf_dir).select("user_id", "section", "article_id"), ["user_id", "section"], "article_id")


@query("u07_symmetric_edges", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, sha256(least(l_suppkey, l_partkey) || '-' || greatest(l_suppkey, l_partkey)) AS key FROM lineitem WHERE l_suppkey <> l_partkey")
def symmetric_edges(spark, sf_dir):
    a, b = F.least("l_suppkey", "l_partkey"), F.greatest("l_suppkey", "l_partkey")
    return table(spark, sf_dir, "lineitem").where("l_suppkey <> l_partkey").select(a.alias("a"), b.alias("b")).distinct().withColumn("key", F.sha2(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")), 256))


@query("t02_nulls_last", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def nulls_last(spark, sf_dir):
    return nulls_last_whole(spark, sf_dir)


@query("t02_nulls_last_whole", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def nulls_last_whole(spark, sf_dir):
    """The same over all rows."""
    key = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return S.numbered(table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")), F.desc_nulls_last("key"), "o_orderkey", name="place").select("o_orderkey", "place")


@query("t04_keyset_page", f"{A}, p AS (SELECT article_id, published_at FROM articles WHERE (published_at, article_id) < (TIMESTAMP '1998-01-20', 5000) ORDER BY published_at DESC, article_id DESC LIMIT 51) SELECT *, row_number() OVER (ORDER BY published_at DESC, article_id DESC) AS place, count(*) OVER () > 50 AS more FROM p QUALIFY place <= 50")
def keyset_page(spark, sf_dir):
    return S.keyset_page(articles(spark, sf_dir).select("article_id", "published_at"), ("1998-01-20", 5000), 50)


@query("t05_id_cursor", f"{A} SELECT article_id FROM articles WHERE article_id > 700 ORDER BY article_id LIMIT 100")
def id_cursor(spark, sf_dir):
    return articles(spark, sf_dir).where("article_id > 700").orderBy("article_id").select("article_id").limit(100)


@query("t06_offset_page", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_retailprice").offset(40).limit(20)


@query("t09_suggest_order", "WITH n AS (SELECT p_name AS label, count(*) AS n FROM part WHERE contains(lower(p_name), 'a') GROUP BY 1) SELECT label, row_number() OVER (ORDER BY (strpos(lower(label), 'p') = 1) DESC, n DESC, length(label), label) AS place FROM n ORDER BY place LIMIT 50")
def suggest_order(spark, sf_dir):
    names = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("a"))).groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    keys = [F.desc(F.instr(F.lower("label"), "p") == 1), F.desc("n"), F.length("label"), F.col("label")]
    return names.orderBy(*keys).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("label", "place")


@query("t12_capped_leaders", f"{A}, r AS (SELECT article_id, media, size, row_number() OVER (PARTITION BY media ORDER BY size DESC, article_id) AS k FROM articles) SELECT article_id, media FROM r WHERE k <= 2 ORDER BY size DESC, article_id LIMIT 30")
def capped_leaders(spark, sf_dir):
    order = [F.desc("size"), F.col("article_id")]
    return S.capped(articles(spark, sf_dir), ["media"], order, 2).orderBy(*order).select("article_id", "media").limit(30)


@query("t13_newest_with_flag", f"{A}, n AS (SELECT article_id FROM articles WHERE {W} ORDER BY published_at DESC, article_id DESC LIMIT 100) SELECT article_id, (SELECT count(*) FROM articles WHERE {W}) > 100 AS capped FROM n")
def newest_with_flag(spark, sf_dir):
    rows = in_window(articles(spark, sf_dir))
    return rows.orderBy(F.desc("published_at"), F.desc("article_id")).select("article_id").limit(100).crossJoin(F.broadcast(rows.agg((F.count(F.lit(1)) > 100).alias("capped"))))  # one row


@query("t14_topics_by_outlet", f"{B}, m AS (SELECT media, tag, count(*) AS n FROM baskets WHERE {W} GROUP BY ALL) SELECT media, tag, n, sum(n) OVER (PARTITION BY media)::BIGINT AS outlet_total, row_number() OVER (PARTITION BY media ORDER BY n DESC, tag) AS place FROM m")
def topics_by_outlet(spark, sf_dir):
    m = in_window(baskets(spark, sf_dir)).groupBy("media", "tag").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("outlet_total", F.sum("n").over(Window.partitionBy("media"))).withColumn("place", F.row_number().over(Window.partitionBy("media").orderBy(F.desc("n"), "tag")).cast("long"))


@query("t15_fair_budget", f"{A}, r AS (SELECT article_id, media, row_number() OVER (PARTITION BY media ORDER BY published_at DESC, article_id DESC) AS turn FROM articles WHERE {W}) SELECT article_id, media, turn FROM r WHERE turn <= 4 ORDER BY turn, media, article_id LIMIT 60")
def fair_budget(spark, sf_dir):
    """A total budget dealt in turns: the newest of each outlet first, then the second newest."""
    rows = S.capped(in_window(articles(spark, sf_dir)), ["media"], [F.desc("published_at"), F.desc("article_id")], 4, "turn")
    return rows.orderBy("turn", "media", "article_id").select("article_id", "media", "turn").limit(60)


@query("t16_age_buckets", f"{A}, b AS (SELECT CASE WHEN published_at >= TIMESTAMP '1998-01-30' THEN 'today' WHEN published_at >= TIMESTAMP '1998-01-29' THEN 'yesterday' WHEN published_at >= TIMESTAMP '1998-01-24' THEN 'week' ELSE 'older' END AS bucket FROM articles WHERE published_at < TIMESTAMP '1998-01-31') SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def age_buckets(spark, sf_dir):
    at = F.col("published_at")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    bucket = F.when(at >= day("1998-01-30"), "today").when(at >= day("1998-01-29"), "yesterday").when(at >= day("1998-01-24"), "week").otherwise("older")
    return articles(spark, sf_dir).where(at < day("1998-01-31")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
