"""Queries of headlines, attributions, bylines, summaries and title tags. Labels of parts stand in for headlines of an event."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.functions import text as X
from tagloom.operators import citations as CITE
from tagloom.operators import headlines as H
from tagloom.operators import search as S
from tagloom.plans.similarity import bodies, near
from tagloom.sources.tables import BASKETS_SQL, TEXTS_SQL, baskets, table, texts

TX, B = f"WITH {TEXTS_SQL}", f"WITH {BASKETS_SQL}"
REPORTS_SQL = "hl AS (SELECT p_partkey AS id, p_brand AS event, lower(p_name || ' ' || p_type) AS title, p_partkey % 10 AS media, CASE p_partkey % 3 WHEN 0 THEN 'blue' WHEN 1 THEN 'green' ELSE 'other' END AS camp, p_size AS hour, p_partkey % 4 AS hits FROM part)"
DICE_SQL = f"{REPORTS_SQL}, gr AS (SELECT DISTINCT event, id, substr(title, i, 2) AS g FROM (SELECT event, id, title, unnest(range(1, length(title))) AS i FROM hl)), sz AS (SELECT id, count(*) AS n FROM gr GROUP BY id), sh AS (SELECT x.event, x.id AS a, y.id AS b, count(*) AS k FROM gr x JOIN gr y ON x.event = y.event AND x.g = y.g AND x.id <> y.id GROUP BY ALL), di AS (SELECT event, a, b, 2 * k / (x.n + y.n)::DOUBLE AS dice FROM sh JOIN sz x ON x.id = a JOIN sz y ON y.id = b)"


def reports(spark, sf_dir):
    p = F.col("p_partkey")
    camp = F.when(p % 3 == 0, "blue").when(p % 3 == 1, "green").otherwise("other")
    return table(spark, sf_dir, "part").select(p.alias("id"), F.col("p_brand").alias("event"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("title"), (p % 10).alias("media"), camp.alias("camp"), F.col("p_size").alias("hour"), (p % 4).alias("hits"))


@query("j25_title_pairs", f"WITH {DICE_SQL} SELECT di.event, a, b, round(dice, 9) AS dice FROM di JOIN hl x ON x.id = a JOIN hl y ON y.id = b WHERE a < b AND dice >= 0.7 AND x.title <> y.title")
def title_pairs(spark, sf_dir):
    """Nearly the same headlines within an event, through the bigrams they share; a title that repeats is compared once."""
    r = reports(spark, sf_dir)
    once = r.groupBy("event", "title").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids"))
    near = H.bigram_dice(once, ["event"], 0.7)
    ids = once.select(F.col("id"), "ids")
    both = near.join(ids.toDF("a", "xs"), "a").join(ids.toDF("b", "ys"), "b").select("event", F.explode("xs").alias("x"), "ys", "dice").select("event", "x", F.explode("ys").alias("y"), "dice")
    return both.select("event", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("dice", 9).alias("dice"))


@query("x20_comparison_pair", f"WITH {DICE_SQL}, se AS (SELECT event, min(id) AS seed FROM hl GROUP BY event), ts AS (SELECT di.event, a, dice AS s FROM di JOIN se ON se.event = di.event AND b = seed UNION ALL SELECT event, seed, 1.0 FROM se), tk AS (SELECT * FROM ts WHERE s >= 0.18), pr AS (SELECT di.event, di.a, di.b, round(dice + x.s + y.s, 6) AS score, l.hour AS h FROM di JOIN hl l ON l.id = di.a AND l.camp = 'blue' JOIN hl r ON r.id = di.b AND r.camp = 'green' JOIN tk x ON x.event = di.event AND x.a = di.a JOIN tk y ON y.event = di.event AND y.a = di.b WHERE dice >= 0.24 AND l.media <> r.media AND abs(l.hour - r.hour) <= 12) SELECT event, a AS blue, b AS green, score FROM pr QUALIFY row_number() OVER (PARTITION BY event ORDER BY score DESC, h DESC, a, b) = 1")
def comparison_pair(spark, sf_dir):
    return H.comparison_pairs(reports(spark, sf_dir))


@query("x21_headline_diff")
def headline_diff(spark, sf_dir):
    """The characters in which the two headlines of a comparison differ."""
    p = H.compared_headlines(reports(spark, sf_dir))
    return p.select("event", H.headline_diff("blue_title", "green_title").alias("d")).select("event", "d.left", "d.right")


@query("x22_token_diff")
def token_diff(spark, sf_dir):
    """Words that near-duplicate texts removed and added, for pairs with null where over 15 % of the words change."""
    t = bodies(spark, sf_dir).select("id", "body")
    both = near(spark, sf_dir).select("a", "b").join(t.toDF("a", "x"), "a").join(t.toDF("b", "y"), "b")
    return both.select("a", "b", H.token_diff("x", "y").alias("d")).select("a", "b", "d.removed", "d.added", "d.hunks")


@query("x23_distinctive_words", f"WITH {REPORTS_SQL}, w AS (SELECT event, id, media, generate_subscripts(string_split(title, ' '), 1) AS i, unnest(string_split(title, ' ')) AS word FROM hl), al AS (SELECT event, word FROM w WHERE word <> '' GROUP BY ALL HAVING count(DISTINCT media) = 1) SELECT w.event, id, string_agg(w.word, ' ' ORDER BY i) AS words FROM w JOIN al ON al.event = w.event AND al.word = w.word GROUP BY w.event, id")
def distinctive_words(spark, sf_dir):
    return H.distinctive_words(reports(spark, sf_dir))


@query("t10_camp_picks")
def camp_picks(spark, sf_dir):
    """Camps take turns with relevant, new headlines; each pick depends on those before it, so there is no SQL."""
    return H.camp_picks(reports(spark, sf_dir))


@query("t11_lead_picks")
def lead_picks(spark, sf_dir):
    return H.lead_picks(reports(spark, sf_dir))


WORDS_SQL = f"{TX}, ws AS (SELECT article_id AS id, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM texts), gm AS (SELECT id, i AS f, i + n - 1 AS l, array_to_string(w[i:i + n - 1], ' ') AS tag FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ws, (VALUES (1), (2), (3)) v(n))), vo AS (SELECT tag, count(DISTINCT id) AS freq FROM gm WHERE length(tag) >= 4 GROUP BY tag HAVING count(DISTINCT id) >= 3)"


@query("x24_longest_terms", f"{WORDS_SQL}, h AS (SELECT gm.*, freq FROM gm JOIN vo USING (tag)), k AS (SELECT DISTINCT id, tag, freq FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.id = h.id AND o.f <= h.f AND o.l >= h.l AND (o.f < h.f OR o.l > h.l))), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY freq DESC, tag) AS k FROM k) SELECT id, string_agg(tag, ',' ORDER BY k) AS tags FROM r WHERE k <= 8 GROUP BY id")
def longest_terms(spark, sf_dir):
    """Title tags by the longest terms of a vocabulary of the titles' own words and phrases, at most eight."""
    t = texts(spark, sf_dir).select(F.col("article_id").alias("id"), "title")
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    flat = t.select("id", words.alias("w")).where("size(w) > 0").select("id", F.explode(H.word_grams(F.col("w"), 3)).alias("s")).select("id", "s.tag").where("length(tag) >= 4")
    vocabulary = flat.groupBy("tag").agg(F.count_distinct("id").alias("freq")).where("freq >= 3")
    return H.vocabulary_tags(t, vocabulary)


@query("x25_topic_tags", f"{B}, w AS (SELECT * FROM baskets WHERE published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-04-01'), k AS (SELECT media, count(DISTINCT article_id) AS k FROM w GROUP BY media), t AS (SELECT tag, count(*) AS n FROM w GROUP BY tag), c AS (SELECT media, tag, count(*) AS c FROM w GROUP BY ALL) SELECT media, tag, round(c / k::DOUBLE, 6) AS share FROM c JOIN k USING (media) JOIN t USING (tag) WHERE c / k::DOUBLE > 0.28 OR (c / k::DOUBLE >= 0.22 AND c / n::DOUBLE >= 0.05)")
def topic_tags(spark, sf_dir):
    """Tags that stand for a topic: on a large share of its articles, or a somewhat smaller one if they are seldom elsewhere."""
    w = baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-01", "1998-04-01"))
    c = w.groupBy("media", "tag").agg(F.count(F.lit(1)).alias("c"))
    k = w.groupBy("media").agg(F.count_distinct("article_id").alias("k"))
    n = c.groupBy("tag").agg(F.sum("c").alias("n"))
    share, own = F.col("c") / F.col("k"), F.col("c") / F.col("n")
    return c.join(k, "media").join(n, "tag").where((share > 0.28) | ((share >= 0.22) & (own >= 0.05))).select("media", "tag", F.round(share, 6).alias("share"))


@query("x26_social_posts", "WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Mayor Lee posted on Facebook that roads open' WHEN 1 THEN 'Singer Kim wrote on Instagram: thanks' WHEN 2 THEN 'Prices fell again on Monday' WHEN 3 THEN 'In a Threads post, actor Ann said no' WHEN 4 THEN 'Facebook opens a new office' ELSE 'Minister Wu shared a video on YouTube' END AS t FROM orders) SELECT id, regexp_matches(t, '(?i)(posted|wrote|shared [a-z ]+) on (facebook|instagram|youtube)|in an? (threads|x) post') AS social, nullif(lower(regexp_extract(t, '(?i)(?:posted|wrote|shared [a-z ]+) on (facebook|instagram|youtube)|in an? (threads|x) post', 1) || regexp_extract(t, '(?i)in an? (threads|x) post', 1)), '') AS platform, nullif(regexp_extract(t, '(?:^|, )(?:Mayor|Singer|actor|Minister) ([A-Z][a-z]+)', 1), '') AS poster, nullif(lower(regexp_extract(t, '(?:^|, )(Mayor|Singer|actor|Minister) [A-Z]', 1)), '') AS role FROM p")
def social_posts(spark, sf_dir):
    """Whether a text tells of a post, where it stood, who wrote it and in which role."""
    k = F.col("o_orderkey") % 6
    said = ["Mayor Lee posted on Facebook that roads open", "Singer Kim wrote on Instagram: thanks", "Prices fell again on Monday", "In a Threads post, actor Ann said no", "Facebook opens a new office"]
    t = F.lit("Minister Wu shared a video on YouTube")
    for i in range(4, -1, -1):
        t = F.when(k == i, said[i]).otherwise(t)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t")).select("id", *X.social_post(F.col("t")))


@query("x29_byline_names", "WITH b AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'By Ann Lee and Bo Wu, Taipei' WHEN 1 THEN 'Reporter Cy Ho / News Desk' WHEN 2 THEN 'Ann Lee; Dee Fu' ELSE '' END AS credit FROM supplier), n AS (SELECT id, generate_subscripts(string_split_regex(credit, ' and |[/;,]'), 1) AS i, unnest(string_split_regex(credit, ' and |[/;,]')) AS part FROM b), c AS (SELECT id, i, trim(regexp_replace(trim(part), '^(By|Reporter) ', '')) AS name FROM n) SELECT id, string_agg(name, ',' ORDER BY i) AS names FROM c WHERE regexp_matches(name, '^[A-Z][a-z]+ [A-Z][a-z]+$') AND NOT regexp_matches(name, 'Desk$') GROUP BY id")
def byline_names(spark, sf_dir):
    """The persons of a credit line, without places and desks."""
    k = F.col("s_suppkey") % 4
    credit = F.when(k == 0, "By Ann Lee and Bo Wu, Taipei").when(k == 1, "Reporter Cy Ho / News Desk").when(k == 2, "Ann Lee; Dee Fu").otherwise("")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), X.byline_names(credit).alias("names"))
    return names.where(F.size("names") > 0).withColumn("names", F.array_join("names", ","))


@query("x31_summary", f"{TX}, s AS (SELECT article_id, title, trim(regexp_extract(replace(body, chr(10), ' '), '^(?:[^.!?]*[.!?] )?([^.!?]{{30,}}[.!?])', 1)) AS s FROM texts) SELECT article_id, CASE WHEN length(s) BETWEEN 30 AND 200 AND NOT contains(title, s) THEN s END AS summary FROM s")
def summary(spark, sf_dir):
    """The first or second sentence of at least 30 characters, if it is not too long and no part of the title."""
    s = F.trim(F.regexp_extract(F.replace("body", F.lit("\n"), F.lit(" ")), r"^(?:[^.!?]*[.!?] )?([^.!?]{30,}[.!?])", 1))
    t = texts(spark, sf_dir).select("article_id", "title", s.alias("s"))
    return t.select("article_id", F.when(F.length("s").between(30, 200) & ~F.contains("title", "s"), F.col("s")).alias("summary"))


SENTENCES_SQL = "bd AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Prices rose. According to NATION_' || (o_custkey % 25) || ' more will follow.' WHEN 1 THEN 'NATION_' || (o_custkey % 25) || ' said it would. Nobody asked NATION_3.' WHEN 2 THEN 'A day in NATION_' || (o_custkey % 25) || '. It rained.' ELSE 'Talks went on, citing NATION_' || (o_custkey % 25) || ' and others' END AS body FROM orders)"


@query("x14_attributions", f"WITH {SENTENCES_SQL}, se AS (SELECT id, trim(unnest(string_split_regex(body, '[.!?]'))) AS sentence FROM bd), m AS (SELECT id, n_name AS outlet, sentence FROM se JOIN nation ON list_contains(regexp_extract_all(sentence, '[\\w]+'), n_name) WHERE regexp_matches(sentence, '(?i)\\b(?:according to|citing) ' || n_name || '\\b') OR regexp_matches(sentence, '(?i)\\b' || n_name || ' (?:said|told|reported)\\b')) SELECT id, outlet, min(sentence) AS evidence FROM m GROUP BY ALL")
def attributions(spark, sf_dir):
    """Sentences that name an outlet as their source."""
    who, k = F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")), F.col("o_orderkey") % 4
    lit = F.lit
    body = F.when(k == 0, F.concat(lit("Prices rose. According to "), who, lit(" more will follow."))).when(k == 1, F.concat(who, lit(" said it would. Nobody asked NATION_3."))).when(k == 2, F.concat(lit("A day in "), who, lit(". It rained."))).otherwise(F.concat(lit("Talks went on, citing "), who, lit(" and others")))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.split(body, "[.!?]")).alias("s")).select("id", F.trim("s").alias("sentence"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("outlet"))
    return H.attributions(s, names)


def planted_citations(spark, sf_dir):
    """Citations of the sources of documents, planted behind the texts of documents: reports, credits, lists, namesakes, pictures."""
    t, lit = texts(spark, sf_dir), F.lit
    outlets = t.select("media").distinct().select("media", F.array(F.concat("media", lit("日報")), F.concat(lit("The "), "media", lit(" Times"))).alias("aliases"), F.array(lit("老")).alias("prefixes"))
    k = F.col("article_id") % 7
    who = F.concat(lit("src"), (F.col("article_id") % 23).cast("string"))
    said = (
        F.when(k == 0, F.concat(lit("據"), who, lit("日報報導，此事未定")))
        .when(k == 1, F.concat(lit("圖片來源：The "), who, lit(" Times")))
        .when(k == 2, F.concat(lit("（資料來源：The "), who, lit(" Times、src1日報）")))
        .when(k == 3, F.concat(lit("据"), who, lit("日報和src2日報等媒体报道，此事未定")))
        .when(k == 4, F.concat(lit("the "), who, lit(" times授權轉載")))
        .when(k == 5, F.concat(lit("據老"), who, lit("日報報導，此事未定")))
    )
    return CITE.citations(t.select(F.col("article_id").alias("id"), "media", F.concat_ws("\n", "body", said).alias("body")), outlets)


@query("x14_citations")
def citations(spark, sf_dir):
    """Which sources each document cites, and by what rule; tested by brute force."""
    return planted_citations(spark, sf_dir)


@query("x15_outlet_identity", "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), c AS (SELECT *, regexp_replace(host, '^(www|m|blog)\\.', '') AS site FROM h) SELECT site, min(host) AS outlet, count(DISTINCT host) AS hosts, count(*) AS pages FROM c GROUP BY site")
def outlet_identity(spark, sf_dir):
    """Hosts of one outlet under one identity, the least of its names."""
    h = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"))
    c = h.withColumn("site", F.regexp_replace("host", r"^(www|m|blog)\.", ""))
    return c.groupBy("site").agg(F.min("host").alias("outlet"), F.count_distinct("host").alias("hosts"), F.count(F.lit(1)).alias("pages"))
