"""Queries of series, moving windows, histories, vocabularies and windows of time."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.operators import search as S
from tagloom.operators import series as T
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, articles, baskets, stream

A, B, ST = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, STREAM_SQL))
SINCE, UNTIL = "2024-01-13 00:00:00", "2024-01-15 00:00:00"
SPAN = f"published_at >= TIMESTAMP '{SINCE}' AND published_at < TIMESTAMP '{UNTIL}'"
SPINE_SQL = f"hours AS (SELECT unnest(generate_series(TIMESTAMP '{SINCE}', TIMESTAMP '{UNTIL}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour)"


def span(spark, sf_dir):
    return stream(spark, sf_dir).where(S.half_open(F.col("published_at"), SINCE, UNTIL)).withColumn("hour", T.hour(F.col("published_at")))


def hours(spark):
    return T.spine(spark, SINCE, UNTIL, "1 HOUR")


@query("a12_tag_media_hour_counts", f"{ST} SELECT section AS tag, media, date_trunc('hour', published_at) AS hour, count(DISTINCT article_id) AS n FROM stream WHERE {SPAN} GROUP BY ALL")
def tag_media_hour_counts(spark, sf_dir):
    return span(spark, sf_dir).groupBy(F.col("section").alias("tag"), "media", "hour").agg(F.count_distinct("article_id").alias("n"))


DENSE_SQL = f"{ST}, {SPINE_SQL}, k AS (SELECT DISTINCT section AS tag FROM stream WHERE {SPAN}), c AS (SELECT section AS tag, date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream WHERE {SPAN} GROUP BY ALL), dense AS (SELECT k.tag, h.hour, coalesce(n, 0) AS n FROM k CROSS JOIN hours h LEFT JOIN c ON c.tag = k.tag AND c.hour = h.hour)"


@query("w04_moving_average", f"{DENSE_SQL} SELECT tag, hour, round(sum(n) OVER (PARTITION BY tag ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) / 24.0, 6)::DOUBLE AS average FROM dense")
def moving_average(spark, sf_dir):
    d = T.dense(span(spark, sf_dir).withColumn("tag", F.col("section")), hours(spark), ["tag"])
    return d.select("tag", "hour", F.round(T.moving_average(d, ["tag"]), 6).alias("average"))


@query("w05_moving_score", f"{ST}, {SPINE_SQL}, k AS (SELECT DISTINCT section AS tag, media FROM stream WHERE {SPAN}), c AS (SELECT section AS tag, media, date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream WHERE {SPAN} GROUP BY ALL), d AS (SELECT k.tag, k.media, h.hour, coalesce(n, 0) AS n FROM k CROSS JOIN hours h LEFT JOIN c ON c.tag = k.tag AND c.media = k.media AND c.hour = h.hour), m AS (SELECT tag, media, hour, sum(n) OVER (PARTITION BY tag, media ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS s FROM d) SELECT tag, hour, round(sum(2 * (1 - power(0.5, s))) / 20 * 50, 6) AS score FROM m GROUP BY ALL")
def moving_score(spark, sf_dir):
    d = T.dense(span(spark, sf_dir).withColumn("tag", F.col("section")), hours(spark), ["tag", "media"])
    return T.moving_score(d, roster=20)


@query("w10_rank_trail_with_gaps", f"{DENSE_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY hour ORDER BY n DESC) AS p FROM dense WHERE n > 0) SELECT d.tag, string_agg(coalesce(p::VARCHAR, '-'), ',' ORDER BY d.hour) AS trail FROM dense d LEFT JOIN r ON r.tag = d.tag AND r.hour = d.hour GROUP BY d.tag")
def rank_trail(spark, sf_dir):
    d = T.dense(span(spark, sf_dir).withColumn("tag", F.col("section")), hours(spark), ["tag"])
    r = d.where("n > 0").withColumn("p", F.rank().over(Window.partitionBy("hour").orderBy(F.desc("n")))).select("tag", "hour", "p")
    spots = F.array_sort(F.collect_list(F.struct("hour", F.coalesce(F.col("p").cast("string"), F.lit("-")).alias("s"))))
    return d.join(r, ["tag", "hour"], "left").groupBy("tag").agg(F.array_join(F.transform(spots, lambda x: x["s"]), ",").alias("trail"))


@query("w13_hours_so_far", f"{ST}, h AS (SELECT DISTINCT section AS tag, date_trunc('hour', published_at) AS hour FROM stream WHERE {SPAN}) SELECT tag, hour, count(*) OVER (PARTITION BY tag ORDER BY hour) AS hours_so_far FROM h")
def hours_so_far(spark, sf_dir):
    h = span(spark, sf_dir).select(F.col("section").alias("tag"), "hour").distinct()
    return h.withColumn("hours_so_far", F.count(F.lit(1)).over(Window.partitionBy("tag").orderBy("hour")))


@query("w18_latest_per_group", f"{ST} SELECT user_id, max(article_id) AS article_id, arg_max(section, article_id) AS section FROM stream GROUP BY user_id")
def latest_per_group(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("user_id").agg(F.max("article_id").alias("article_id"), F.max_by("section", "article_id").alias("section"))


@query("w20_best_of_day", f"{ST}, h AS (SELECT section AS tag, date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY hour ORDER BY n DESC) AS place FROM h) SELECT tag, CAST(hour + INTERVAL 8 HOUR AS DATE) AS day, max(n) AS best, min(place) AS best_place, sum(n)::BIGINT AS total FROM r GROUP BY ALL")
def best_of_day(spark, sf_dir):
    h = stream(spark, sf_dir).groupBy(F.col("section").alias("tag"), T.hour(F.col("published_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    r = h.withColumn("place", F.rank().over(Window.partitionBy("hour").orderBy(F.desc("n"))).cast("long"))
    return r.groupBy("tag", T.local_day(F.col("hour")).alias("day")).agg(F.max("n").alias("best"), F.min("place").alias("best_place"), F.sum("n").alias("total"))


@query("w21_flow_strength", f"{ST}, h AS (SELECT tag, date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream WHERE {SPAN} GROUP BY ALL) SELECT tag, hour, round(greatest(sqrt(n / max(n) OVER ()::DOUBLE), 0.12), 6) AS strength, min(hour) OVER (PARTITION BY tag) AS first_seen FROM h")
def flow_strength(spark, sf_dir):
    h = span(spark, sf_dir).groupBy("tag", "hour").agg(F.count(F.lit(1)).alias("n"))
    peak = h.agg(F.max("n").alias("peak"))
    strength = F.greatest(F.sqrt(F.col("n") / F.col("peak")), F.lit(0.12))
    return h.crossJoin(F.broadcast(peak)).select("tag", "hour", F.round(strength, 6).alias("strength"), F.min("hour").over(Window.partitionBy("tag")).alias("first_seen"))  # one row


@query("w22_rank_strength", f"{ST}, h AS (SELECT section AS tag, date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream WHERE {SPAN} GROUP BY ALL), r AS (SELECT tag, hour, row_number() OVER (PARTITION BY hour ORDER BY n DESC, tag) AS p FROM h) SELECT tag, hour, (3 + 1 - p) / 3.0::DOUBLE AS strength FROM r WHERE p <= 3")
def rank_strength(spark, sf_dir):
    h = span(spark, sf_dir).groupBy(F.col("section").alias("tag"), "hour").agg(F.count(F.lit(1)).alias("n"))
    return S.capped(h, ["hour"], [F.desc("n"), F.col("tag")], 3, "p").select("tag", "hour", ((F.lit(3.0) + 1 - F.col("p")) / 3).alias("strength"))


@query("w23_grouping_by_hour", f"{ST} SELECT date_trunc('hour', published_at) AS hour, string_agg(article_id::VARCHAR, ',' ORDER BY published_at, article_id) AS articles FROM stream WHERE {SPAN} GROUP BY 1")
def grouping_by_hour(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("published_at", "article_id")))
    return span(spark, sf_dir).groupBy("hour").agg(F.array_join(F.transform(order, lambda x: x["article_id"].cast("string")), ",").alias("articles"))


@query("w25_merge_pages", f"{ST}, p AS (SELECT article_id, published_at FROM stream WHERE article_id BETWEEN 100 AND 300 UNION SELECT article_id, published_at FROM stream WHERE article_id BETWEEN 250 AND 400) SELECT article_id, published_at FROM p")
def merge_pages(spark, sf_dir):
    rows = stream(spark, sf_dir).select("article_id", "published_at")
    return rows.where("article_id BETWEEN 100 AND 300").union(rows.where("article_id BETWEEN 250 AND 400")).dropDuplicates(["article_id"])


@query("a13_related_share", f"{B}, w AS (SELECT * FROM baskets WHERE published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-02-01'), t AS (SELECT tag, count(*) AS n FROM w GROUP BY tag) SELECT x.tag AS a, y.tag AS b, count(*) AS shared, round(least(1.0, count(*) / any_value(t.n)::DOUBLE), 6) AS share FROM w x JOIN w y ON x.article_id = y.article_id AND x.tag <> y.tag JOIN t ON t.tag = x.tag GROUP BY x.tag, y.tag")
def related_share(spark, sf_dir):
    w = baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-01", "1998-02-01"))
    total = w.groupBy(F.col("tag").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return S.co_occurrence(w).join(total, "a").select("a", "b", "shared", F.round(F.least(F.lit(1.0), F.col("shared") / F.col("n")), 6).alias("share"))


@query("a18_keyword_cloud", f"{B}, c AS (SELECT media, tag, count(*) AS n FROM baskets GROUP BY media, tag) SELECT media, tag, n FROM c QUALIFY row_number() OVER (PARTITION BY media ORDER BY n DESC, tag) <= 5")
def keyword_cloud(spark, sf_dir):
    counts = baskets(spark, sf_dir).groupBy("media", "tag").agg(F.count(F.lit(1)).alias("n"))
    return S.capped(counts, ["media"], [F.desc("n"), F.col("tag")], 5).select("media", "tag", "n")


@query("a19_distinctive_terms", f"{B}, c AS (SELECT media, tag, count(*) AS n FROM baskets GROUP BY ALL), s AS (SELECT media, count(DISTINCT article_id) AS k FROM baskets GROUP BY media), ta AS (SELECT tag, sum(n) AS n FROM c GROUP BY tag), al AS (SELECT sum(k) AS k FROM s) SELECT media, c.tag, c.n FROM c JOIN s USING (media) JOIN ta USING (tag) CROSS JOIN al WHERE c.n >= 3 AND c.n / s.k::DOUBLE >= 1.2 * ((ta.n - c.n + 1) / (al.k - s.k + 1)::DOUBLE)")
def distinctive_terms(spark, sf_dir):
    """Terms whose share in an outlet is well above that of its peers (the factor fits this data)."""
    rows = baskets(spark, sf_dir)
    c = rows.groupBy("media", "tag").agg(F.count(F.lit(1)).alias("n"))
    s = rows.groupBy("media").agg(F.count_distinct("article_id").alias("k"))
    total, every = c.groupBy("tag").agg(F.sum("n").alias("all_n")), s.agg(F.sum("k").alias("all_k"))
    out = c.join(s, "media").join(total, "tag").crossJoin(F.broadcast(every))  # one row
    peer = (F.col("all_n") - F.col("n") + 1) / (F.col("all_k") - F.col("k") + 1)
    return out.where((F.col("n") >= 3) & (F.col("n") / F.col("k") >= 1.2 * peer)).select("media", "tag", "n")


FLOW_SQL = f"{ST}, f AS (SELECT date_trunc('hour', published_at) AS hour, tag, count(*) AS n FROM stream WHERE section = 'click' GROUP BY ALL)"


@query("a20_tag_flow", f"{FLOW_SQL} SELECT hour, tag, n FROM f WHERE n >= 2")
def tag_flow(spark, sf_dir):
    return stream(spark, sf_dir).where("section = 'click'").groupBy(T.hour(F.col("published_at")).alias("hour"), "tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("a21_day_roll_up", f"{FLOW_SQL} SELECT CAST(hour + INTERVAL 8 HOUR AS DATE) AS day, tag, sum(n)::BIGINT AS n FROM f GROUP BY ALL")
def day_roll_up(spark, sf_dir):
    f = stream(spark, sf_dir).where("section = 'click'").groupBy(T.hour(F.col("published_at")).alias("hour"), "tag").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy(T.local_day(F.col("hour")).alias("day"), "tag").agg(F.sum("n").alias("n"))


HISTORY_SQL = "d AS (SELECT tag, CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n, min(published_at) AS a, max(published_at) AS z FROM stream GROUP BY ALL), hist AS (SELECT tag, min(a) AS first_at, max(z) AS last_at, sum(n)::BIGINT AS articles, first(day ORDER BY n DESC, day) AS peak_day, max(n) AS peak_count FROM d GROUP BY tag)"


@query("a22_tag_history", f"{ST}, {HISTORY_SQL} SELECT * FROM hist")
def tag_history(spark, sf_dir):
    return T.histories(stream(spark, sf_dir))


@query("a23_refreshed_peaks", f"{ST}, o AS (SELECT tag, CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n FROM stream WHERE published_at < TIMESTAMP '2024-01-15' GROUP BY ALL), op AS (SELECT tag, first(day ORDER BY n DESC, day) AS peak_day, max(n) AS peak_count FROM o GROUP BY tag), r AS (SELECT tag, CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n FROM stream WHERE published_at >= TIMESTAMP '2024-01-14 16:00:00' GROUP BY ALL), rp AS (SELECT tag, first(day ORDER BY n DESC, day) AS d, max(n) AS c FROM r GROUP BY tag) SELECT op.tag, CASE WHEN c > peak_count THEN d ELSE peak_day END AS peak_day, greatest(peak_count, coalesce(c, 0)) AS peak_count FROM op LEFT JOIN rp USING (tag)")
def refreshed_peaks(spark, sf_dir):
    """Stored peaks, refreshed from the recent days only."""
    rows = stream(spark, sf_dir)
    old = T.histories(rows.where(F.col("published_at") < F.lit("2024-01-15").cast("timestamp_ntz"))).select("tag", "peak_day", "peak_count")
    new = T.histories(rows.where(F.col("published_at") >= F.lit("2024-01-14 16:00:00").cast("timestamp_ntz"))).select("tag", F.col("peak_day").alias("d"), F.col("peak_count").alias("c"))
    return old.join(new, "tag", "left").select("tag", F.when(F.col("c") > F.col("peak_count"), F.col("d")).otherwise(F.col("peak_day")).alias("peak_day"), F.greatest("peak_count", F.coalesce("c", F.lit(0))).alias("peak_count"))


@query("a24_new_keywords", f"{B} SELECT tag, section, count(*) AS n, count(DISTINCT media) AS outlets, string_agg(DISTINCT media::VARCHAR, ',' ORDER BY media::VARCHAR) AS media FROM baskets GROUP BY ALL HAVING min(published_at) >= TIMESTAMP '1995-01-02' AND count(*) >= 2")
def new_keywords(spark, sf_dir):
    g = baskets(spark, sf_dir).groupBy("tag", "section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("media").alias("outlets"), F.array_join(F.array_sort(F.collect_set(F.col("media").cast("string"))), ",").alias("media"), F.min("published_at").alias("first_at"))
    return g.where((F.col("first_at") >= F.lit("1995-01-02").cast("timestamp_ntz")) & (F.col("n") >= 2)).drop("first_at")


VOCABULARY_SQL = f"{B}, v AS (SELECT tag, count(*) AS n, min(published_at) AS first_at, max(published_at) AS last_at, count(*) FILTER (published_at >= TIMESTAMP '2001-01-01' - INTERVAL 30 DAY) AS r30, count(*) FILTER (published_at >= TIMESTAMP '2001-01-01' - INTERVAL 90 DAY) AS r90, count(*) FILTER (published_at >= TIMESTAMP '2001-01-01' - INTERVAL 180 DAY) AS r180 FROM baskets GROUP BY tag)"


@query("a25_vocabulary", f"{VOCABULARY_SQL} SELECT * FROM v")
def vocabulary(spark, sf_dir):
    return T.vocabulary(baskets(spark, sf_dir), "2001-01-01")


@query("a26_two_stage_aggregate", f"{A}, p AS (SELECT article_id % 16 AS page, media, count(*) AS n, sum(size) AS s FROM articles GROUP BY ALL) SELECT media, sum(n)::BIGINT AS n, round(sum(s), 2) AS size FROM p GROUP BY media")
def two_stage_aggregate(spark, sf_dir):
    """Partial sums by page and then by outlet: what Spark's own partial aggregation does, made explicit."""
    p = articles(spark, sf_dir).groupBy((F.col("article_id") % 16).alias("page"), "media").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    return p.groupBy("media").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("size"))


@query("a27_vocabulary_tiers", f"{VOCABULARY_SQL}, t(least) AS (VALUES (50), (100), (200), (500)), w AS (SELECT 'r30' AS span, tag, r30 AS n FROM v UNION ALL SELECT 'r90', tag, r90 FROM v UNION ALL SELECT 'all', tag, n FROM v) SELECT span, least, count(*) FILTER (n >= least) AS terms FROM w CROSS JOIN t GROUP BY ALL")
def vocabulary_tiers(spark, sf_dir):
    v = T.vocabulary(baskets(spark, sf_dir), "2001-01-01").select("tag", F.explode(F.create_map(F.lit("r30"), "r30", F.lit("r90"), "r90", F.lit("all"), "n")).alias("span", "n"))
    return v.withColumn("least", F.explode(F.array(*[F.lit(x) for x in (50, 100, 200, 500)]))).groupBy("span", "least").agg(F.count_if(F.col("n") >= F.col("least")).alias("terms"))


@query("r01_sliding_ranking", f"{ST}, w AS (SELECT unnest(generate_series(date_trunc('hour', published_at) - INTERVAL 23 HOUR, date_trunc('hour', published_at), INTERVAL 1 HOUR)) AS start, section, media, article_id FROM stream) SELECT start, section, count(*) AS n, count(DISTINCT media) AS outlets FROM w GROUP BY ALL")
def sliding_ranking(spark, sf_dir):
    w = stream(spark, sf_dir).groupBy(F.window("published_at", "24 hours", "1 hour").alias("w"), "section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("media").alias("outlets"))
    return w.select(F.col("w.start").alias("start"), "section", "n", "outlets")


@query("r02_hour_buckets", f"{ST} SELECT date_trunc('hour', published_at) AS start, count(*) AS n FROM stream GROUP BY 1")
def hour_buckets(spark, sf_dir):
    return stream(spark, sf_dir).groupBy(F.window("published_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("r03_five_minute_buckets", f"{ST} SELECT time_bucket(INTERVAL 5 MINUTE, published_at) AS start, count(*) AS n FROM stream GROUP BY 1")
def five_minute_buckets(spark, sf_dir):
    return stream(spark, sf_dir).groupBy(F.window("published_at", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("r04_local_days", f"{ST} SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE)::TIMESTAMP - INTERVAL 8 HOUR AS start, count(*) AS n FROM stream GROUP BY 1")
def local_days(spark, sf_dir):
    return stream(spark, sf_dir).groupBy(F.window("published_at", "1 day", "1 day", "16 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("r05_week_sliding_by_day", f"{ST}, w AS (SELECT unnest(generate_series(date_trunc('day', published_at) - INTERVAL 6 DAY, date_trunc('day', published_at), INTERVAL 1 DAY)) AS start, tag FROM stream) SELECT start, tag, count(*) AS n FROM w GROUP BY ALL")
def week_sliding(spark, sf_dir):
    w = stream(spark, sf_dir).groupBy(F.window("published_at", "7 days", "1 day").alias("w"), "tag").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "tag", "n")


@query("r10_statistics_fold", f"{ST}, h AS (SELECT tag, date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream GROUP BY ALL) SELECT tag, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours_count, max(n) AS max_count, first(hour ORDER BY n DESC, hour) AS max_hour FROM h GROUP BY tag")
def statistics_fold(spark, sf_dir):
    h = stream(spark, sf_dir).groupBy("tag", T.hour(F.col("published_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    best = F.struct("n", -F.unix_seconds(F.col("hour").cast("timestamp")))
    return h.groupBy("tag").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count(F.lit(1)).alias("hours_count"), F.max("n").alias("max_count"), F.max_by("hour", best).alias("max_hour"))


@query("r11_late_rows", f"{ST} SELECT section, count(*) FILTER (published_at < TIMESTAMP '2024-01-15' AND collected_at >= TIMESTAMP '2024-01-15') AS late, count(*) FILTER (collected_at < TIMESTAMP '2024-01-15') AS known FROM stream GROUP BY section")
def late_rows(spark, sf_dir):
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    return stream(spark, sf_dir).groupBy("section").agg(F.count_if((F.col("published_at") < at) & (F.col("collected_at") >= at)).alias("late"), F.count_if(F.col("collected_at") < at).alias("known"))


@query("r12_settled_days", f"{ST}, d AS (SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n FROM stream GROUP BY 1) SELECT day, n, day < DATE '2024-01-12' AS settled FROM d WHERE day < DATE '2024-01-15'")
def settled_days(spark, sf_dir):
    d = stream(spark, sf_dir).groupBy(T.local_day(F.col("published_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.where(F.col("day") < F.lit("2024-01-15").cast("date")).withColumn("settled", F.col("day") < F.lit("2024-01-12").cast("date"))


@query("r13_completed_hours", f"{ST} SELECT date_trunc('hour', published_at) AS hour, count(*) AS n FROM stream WHERE date_trunc('hour', published_at) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15 10:30:00' GROUP BY 1")
def completed_hours(spark, sf_dir):
    w = stream(spark, sf_dir).groupBy(F.window("published_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.where(F.col("w.end") <= F.lit("2024-01-15 10:30:00").cast("timestamp_ntz")).select(F.col("w.start").alias("hour"), "n")


@query("r15_stream_dedupe", f"{ST} SELECT media, tag, min(article_id) AS article_id FROM stream GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("media", "tag").agg(F.min("article_id").alias("article_id"))


@query("r17_version_reprocessing", f"{ST} SELECT article_id FROM stream WHERE NOT (article_id % 3 = 0 AND article_id % 2 = 0)")
def version_reprocessing(spark, sf_dir):
    """Rows that the current version of the rules hasn't seen: all but those done under version 2."""
    rows = stream(spark, sf_dir).select("article_id")
    done = rows.where("article_id % 3 = 0").withColumn("version", F.when(F.col("article_id") % 2 == 0, 2).otherwise(1))
    return rows.withColumn("version", F.lit(2)).join(done, ["article_id", "version"], "left_anti").select("article_id")


@query("r18_cursor_feed", f"{ST} SELECT article_id, section FROM stream WHERE article_id > 9000 OR collected_at > TIMESTAMP '2024-01-29'")
def cursor_feed(spark, sf_dir):
    return stream(spark, sf_dir).where((F.col("article_id") > 9000) | (F.col("collected_at") > F.lit("2024-01-29").cast("timestamp_ntz"))).select("article_id", "section")


@query("r20_active_window_expiry", f"{ST} SELECT tag, max(published_at) AS last_at FROM stream GROUP BY tag HAVING max(published_at) BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'")
def active_window_expiry(spark, sf_dir):
    last = stream(spark, sf_dir).groupBy("tag").agg(F.max("published_at").alias("last_at"))
    return last.where(S.closed(F.col("last_at"), "2024-01-01", "2024-01-30"))


@query("r22_retention", f"{ST}, r AS (SELECT article_id, published_at, value, section, row_number() OVER (PARTITION BY section ORDER BY value DESC, article_id) AS p FROM stream) SELECT article_id FROM r WHERE published_at >= TIMESTAMP '2024-01-16' OR p <= 100")
def retention(spark, sf_dir):
    p = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "article_id"))
    return stream(spark, sf_dir).withColumn("p", p).where((F.col("published_at") >= F.lit("2024-01-16").cast("timestamp_ntz")) | (F.col("p") <= 100)).select("article_id")


@query("r23_presence", f"{ST}, m AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11', INTERVAL 1 HOUR)) AS t) SELECT t AS \"at\", count(DISTINCT user_id) AS active FROM m JOIN stream ON published_at > t - INTERVAL 90 MINUTE AND published_at <= t GROUP BY t")
def presence(spark, sf_dir):
    """Users seen in the 90 minutes before each full hour: each event counts for the one or two hours it reaches."""
    ev = stream(spark, sf_dir).where((F.col("published_at") > F.lit("2024-01-09 22:30:00").cast("timestamp_ntz")) & (F.col("published_at") <= F.lit("2024-01-11").cast("timestamp_ntz")))
    top = T.hour(F.col("published_at"))
    next_hour = F.when(top == F.col("published_at"), top).otherwise(top + F.expr("INTERVAL 1 HOUR"))
    marks = ev.select("user_id", "published_at", F.explode(F.array(next_hour, next_hour + F.expr("INTERVAL 1 HOUR"))).alias("at"))
    hit = marks.where((F.col("published_at") > F.col("at") - F.expr("INTERVAL 90 MINUTES")) & F.col("at").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz")))
    return hit.groupBy("at").agg(F.count_distinct("user_id").alias("active"))


@query("r26_high_water_mark", f"{ST} SELECT article_id FROM stream WHERE article_id > 7000 - 2000 AND article_id NOT IN (SELECT article_id FROM stream WHERE article_id <= 7000 AND article_id % 5 <> 0)")
def high_water_mark(spark, sf_dir):
    """Ids from the mark less an overlap, without those already seen."""
    rows = stream(spark, sf_dir).select("article_id")
    return rows.where("article_id > 7000 - 2000").join(rows.where("article_id <= 7000 AND article_id % 5 <> 0"), "article_id", "left_anti")
