"""Article bodies of pages: from structured data, from containers that selectors name, or from the container that scores best.

All of it works on the table of a page's elements and texts (``sources.markup``). A text meets the
containers around it by the numbers in its path, paragraphs and bodies are sums over texts, and the
choice among a page's candidates is made on one small array a page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.sources import markup as M
from tagloom.sources.sinks import settle

#: Selectors of article containers, the more telling first.
CONTAINERS = (
    "[itemprop=articleBody]", "[data-article-body]", "#article-body", "#articleBody", ".article-body", ".article__body", ".article-content", ".article_content", ".articleContent", ".story-body",
    ".story_body", "#story_body_content", ".news-content", ".news_content", "#newsContent", ".caas-body", ".entry-content", ".post-content", ".td-post-content", ".elementor-widget-theme-post-content",
    "founder-content", ".article-main", "article",
)
#: Elements and attributes that are no part of an article's text.
NO_TEXT = ("script", "style", "noscript", "template", "iframe", "nav", "aside", "footer", "button", "figure", "figcaption", "img", "video", "audio", "[hidden]", "[aria-hidden=true]", "[role=navigation]", "[role=complementary]", "[itemprop=author]", "[rel=author]")
#: Words of classes and ids of what stands beside an article, and class names that only look like it.
ASIDE_WORDS = (
    "ad", "ads", "advertisement", "advertorial-widget", "banner", "recommend", "recommended", "recommendation", "recommendations", "related", "recirculation", "promo", "social", "share", "sharing", "caption", "credit", "byline", "author",
    "paywall", "subscribe", "subscription", "newsletter", "comment", "comments", "tag", "tags", "breadcrumb", "toolbar", "outbrain", "taboola",
)
ASIDE = rf"(?i)(?:^|[\s_-])(?:{'|'.join(ASIDE_WORDS)})(?:$|[\s_-])"
NOT_ASIDE = r"(?:no|with|has)[-_]share(?:[-_]float)?|has-banner|social-(?:before|after)-title|comments-(?:on|off)"
UNSEEN = r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)"
#: Beginnings of lines of the page's own voice, and what pages say that show no article.
PAGE_TALK = r"(?i)^(?:廣告(?:[：: ]|$)|Advertisement\b|延伸閱讀[：:]?|相關(?:新聞|文章|報導)[：:]?|推薦閱讀[：:]?|更多(?:新聞|報導)[：:]?|責任編輯[：:]?|圖片來源[：:]?|訂閱(?:電子報|即可|後|會員)|登入(?:後|會員)|請(?:先)?登入|加入會員(?:即可|閱讀)|立即訂閱|subscribe\s+(?:to|now)|sign\s+in\s+to\s+(?:read|continue)|continue\s+reading\s+(?:by|with))"
BARRED = r"(?i)(?:驗證您(?:是|是否為)|確認您(?:是|是否為)|請完成驗證|檢查您的瀏覽器|verify (?:that )?you are (?:a )?human|checking your browser|just a moment|access denied|enable javascript and cookies|complete the security check|請(?:先)?登入.{0,20}(?:閱讀|全文)|訂閱.{0,20}(?:閱讀|全文)|subscribe to (?:read|continue)|sign in to (?:read|continue))"
CHALLENGES = ("#challenge-form", "#cf-challenge-running", "#challenge-running", ".cf-challenge")
#: Characters of a whole body, and the share of links at which a paragraph is a list of them.
ENOUGH, LINKED = 200, 0.6
#: Blocks that end a line where a container has no paragraphs.
BLOCKS, HEADS = ("div", "section", "blockquote", "li"), ("h1", "h2", "h3", "header")
#: Blocks that can be paragraphs for the score, and how many characters count.
SCORED, SCORED_CHARS = ("p", "pre", "td", "div", "section", "blockquote", "li"), 25

_CANDIDATE = "array<struct<place: int, source: string, body: string, chars: int, same: string>>"


def _per_page(rows: DataFrame, name: str) -> DataFrame:
    """page_id and the numbers of its rows as an array."""
    return rows.groupBy("page_id").agg(F.collect_list("node").alias(name))


def _aside(tag: Column, attributes: Column) -> Column:
    classes = F.array_join(F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: ~F.rlike(c, F.lit(f"^(?:{NOT_ASIDE})$"))), " ")
    words = F.concat_ws(" ", classes, F.coalesce(attributes["id"], F.lit("")))
    named = F.arrays_overlap(M.keys(tag, attributes), F.array(*map(F.lit, NO_TEXT)))
    hidden = F.rlike(F.coalesce(attributes["style"], F.lit("")), F.lit(UNSEEN))
    return ~tag.isin("body", "html") & (F.rlike(words, F.lit(ASIDE)) | hidden) | named


def _joined(texts: Column) -> Column:
    """The texts of an array of (place, t) in order."""
    return F.array_join(F.transform(F.array_sort(texts), lambda x: x["t"]), "")


def _said(line: Column) -> Column:
    return (line != "") & ~F.rlike(line, F.lit(PAGE_TALK)) & ~F.rlike(line, F.lit(BARRED))


def _marked(rows: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``rows`` with the number of the innermost element around each (itself included) that is beside the article (``cut``) or a headline (``head``)."""
    named = rows.where("attributes IS NOT NULL")
    beside = named.where(_aside(F.col("tag"), F.col("attributes"))).select("page_id", "node")
    cuts = _per_page(beside if extra is None else beside.unionByName(extra.select("page_id", "node")).distinct(), "cuts")
    heads = _per_page(named.where(F.col("tag").isin(*HEADS)), "heads")
    around = F.concat("path", F.array("node"))
    innermost = lambda c: F.array_max(F.array_intersect(around, F.coalesce(F.col(c), F.array().cast("array<int>"))))
    return rows.join(cuts, "page_id", "left").join(heads, "page_id", "left").withColumns({"cut": innermost("cuts"), "head": innermost("heads")}).drop("cuts", "heads")


def _bodies(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """``containers`` (page_id, node, place, source, trusted, lines) with the text of each: that of its paragraphs, or its lines where it has none or ``lines`` says so.

    A container that stands beside the article, or in what does, has none unless it is trusted. A source
    of *article* needs paragraphs.
    """
    at = rows.where("attributes IS NOT NULL").select("page_id", "node", "cut")
    open_ = containers.join(at, ["page_id", "node"]).where("trusted OR cut IS NULL").drop("cut")
    inside = rows.where((F.col("tag").isin("#text", "br")) | F.col("tag").isin(*BLOCKS, "p"))
    shown = inside.select("page_id", F.col("node").alias("n"), "stop", "tag", "para", "form", "link", "cut", "head", "text", F.explode("path").alias("node")).join(open_, ["page_id", "node"])
    shown = shown.where((F.col("cut").isNull() | (F.col("cut") <= F.col("node"))) & (F.col("form").isNull() | (F.col("form") <= F.col("node"))))
    text = F.when(F.col("tag") == "br", "\n").otherwise(F.col("text"))
    by = ["page_id", "place", "node", "source"]
    own = shown.where(F.col("tag").isin("#text", "br") & (F.col("para") >= F.col("node")))
    paragraphs = own.groupBy(*by, "para").agg(F.collect_list(F.struct(F.col("n"), text.alias("t"))).alias("all"), F.collect_list(F.when(F.col("link") > F.col("para"), F.struct(F.col("n"), text.alias("t")))).alias("linked"))
    paragraphs = paragraphs.select(*by, "para", M.plain(_joined(F.col("all"))).alias("t"), M.content_length(M.plain(_joined(F.col("linked")))).alias("linked")).where("t <> ''")
    prose = _said(F.col("t")) & (F.col("linked") / F.greatest(M.content_length(F.col("t")), F.lit(1)) <= LINKED)
    told = paragraphs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(prose, F.struct("para", "t")))), lambda x: x["t"]), "\n\n").alias("body"))
    plain_text = lambda rows: _lines(rows, by, text)
    found = open_.select(*by, "lines").join(told, by, "left").join(plain_text(shown), by, "left")
    body = F.when(F.col("lines") | (F.col("body").isNull() & (F.col("source") != "article")), F.col("plain")).otherwise(F.col("body"))
    return found.select(*by, F.coalesce(body, F.lit("")).alias("body")).where("body <> ''")


def _lines(shown: DataFrame, by: list[str], text: Column) -> DataFrame:
    """The lines of containers: texts outside headlines, cut at line breaks and where blocks end."""
    outside = shown.where(F.col("head").isNull() | (F.col("head") <= F.col("node")))
    words = outside.where(F.col("tag").isin("#text", "br")).select(*by, (2 * F.col("n") + 1).alias("n"), text.alias("t"))
    ends = outside.where(F.col("tag").isin(*BLOCKS) | ((F.col("tag") == "p") & F.col("lines"))).select(*by, (2 * F.col("stop")).alias("n"), F.lit("\n\n").alias("t"))
    whole = words.unionAll(ends).groupBy(*by).agg(_joined(F.collect_list(F.struct("n", "t"))).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n+"), M.plain), _said)
    return whole.select(*by, F.array_join(lines, "\n\n").alias("plain"))


def scored_containers(rows: DataFrame) -> DataFrame:
    """page_id, node and score of the element of each page whose paragraphs say most.

    A paragraph is the innermost block around texts, of at least SCORED_CHARS characters outside of what
    stands beside the article. It is worth 1, 1 for each comma and 1 for each 100 characters (3 at most);
    its parent gets that (it itself too, if it isn't a p) and its grandparent half. The share of linked
    characters in an element lowers its score. Of equal ones the first counts.
    """
    blocks = rows.where(F.col("tag").isin(*SCORED)).select("page_id", F.col("node").alias("block"), F.col("tag").alias("kind"), F.col("path").alias("above"))
    per_page = _per_page(rows.where(F.col("tag").isin(*SCORED)), "blocks")
    texts = rows.where("tag = '#text' AND cut IS NULL").join(per_page, "page_id").select("page_id", "node", "path", "link", "text", F.array_max(F.array_intersect("path", "blocks")).alias("block"))
    said = texts.groupBy("page_id", "block").agg(M.plain(_joined(F.collect_list(F.struct("node", F.col("text").alias("t"))))).alias("t")).where(F.length("t") >= SCORED_CHARS)
    worth = 1 + F.length(F.regexp_replace("t", "[^,，、]", "")) + F.least(F.floor(F.length("t") / 100), F.lit(3))
    # the path of a block starts with html and body; from its end come parent and grandparent
    up = lambda k: F.try_element_at("above", F.lit(-k))
    given = F.array(F.struct(up(1).alias("node"), F.lit(2).alias("halves")), F.struct(up(2).alias("node"), F.lit(1).alias("halves")), F.struct(F.when(F.col("kind") != "p", F.col("block")).alias("node"), F.lit(2).alias("halves")))
    points = said.join(blocks, ["page_id", "block"]).select("page_id", worth.alias("worth"), F.explode(given).alias("g")).where("g.node IS NOT NULL")
    points = points.groupBy("page_id", F.col("g.node").alias("node")).agg(F.sum(F.col("worth") * F.col("g.halves")).alias("halves"))
    size = M.content_length(F.col("text"))
    shares = texts.select("page_id", F.explode("path").alias("node"), size.alias("n"), F.when(F.col("link").isNotNull(), size).otherwise(0).alias("l")).groupBy("page_id", "node").agg((F.sum("l") / F.greatest(F.sum("n"), F.lit(1))).alias("share"))
    ranked = points.join(shares, ["page_id", "node"]).withColumn("score", F.round(F.col("halves") / 2 * (1 - F.col("share")), 6))
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "node")
    return ranked.withColumn("k", F.row_number().over(best)).where("k = 1").select("page_id", "node", "score")


def _linked_data(text: str | None) -> list[dict]:
    """The article nodes of a JSON-LD text, in lists, graphs and main entities."""
    found: list[dict] = []

    def visit(value: object) -> None:
        for node in value if isinstance(value, list) else [value]:
            if isinstance(node, list):
                visit(node)
            elif isinstance(node, dict):
                kinds = node.get("@type") if isinstance(node.get("@type"), list) else [node.get("@type")]
                if any(isinstance(k, str) and k.replace("#", "/").rsplit("/", 1)[-1].endswith(("Article", "BlogPosting")) or k == "LiveBlogPosting" for k in kinds):
                    found.append(node)
                visit(node.get("@graph"))
                visit(node.get("mainEntity"))

    try:
        visit(json.loads(text or ""))
    except (ValueError, RecursionError):  # malformed data must not hide the page
        return []
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for page, at, text in zip(*(c.to_pylist() for c in batch.columns)):
            for i, node in enumerate(_linked_data(text)):
                urls = [v.get("@id") if isinstance(v, dict) else v for v in (node.get("url"), node.get("@id"), node.get("mainEntityOfPage"))]
                say = lambda k: node[k] if isinstance(node.get(k), str) else None
                out.append((page, at * 10_000 + i, [u for u in urls if isinstance(u, str)], say("headline"), say("articleBody"), node.get("isAccessibleForFree") in (False, "false")))
        kinds = [batch.schema.types[0], pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["page_id", "place", "urls", "headline", "body", "closed"])


def article_nodes(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, place, headline, body and closed of the JSON-LD articles of pages: those that name the page's address or canonical one, or else those that name none."""
    script = rows.where((F.col("tag") == "#text")).select("page_id", "node", "text", F.try_element_at("path", F.lit(-1)).alias("in"))
    holder = rows.where((F.col("tag") == "script") & (F.lower(M.attribute("type")) == "application/ld+json")).select("page_id", F.col("node").alias("in"))
    kind = pages.schema["page_id"].dataType.simpleString()
    nodes = script.join(holder, ["page_id", "in"]).select("page_id", "node", "text").mapInArrow(_linked, f"page_id {kind}, place long, urls array<string>, headline string, body string, closed boolean")
    canonical = rows.where((F.col("tag") == "link") & (F.lower(M.attribute("rel")) == "canonical")).groupBy("page_id").agg(F.min_by(M.attribute("href"), "node").alias("canonical"))
    own = pages.select("page_id", "url").join(canonical, "page_id", "left").select("page_id", F.array_compact(F.array(X.url_key(F.col("url")), X.url_key(X.absolute(F.col("canonical"), F.col("url"))))).alias("own"), "url")
    named = nodes.join(own, "page_id").withColumn("keys", F.transform("urls", lambda u: X.url_key(X.absolute(u, F.col("url")))))
    named = named.withColumn("hit", F.arrays_overlap("keys", "own")).withColumn("some", F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy("page_id")))
    return named.where(F.when(F.col("some"), F.col("hit")).otherwise(F.size("keys") == 0)).select("page_id", "place", "headline", "body", "closed")


def _structured(nodes: DataFrame) -> DataFrame:
    """page_id, place and text of the bodies of article nodes; one with markup is read like a page."""
    tagged = F.rlike("body", F.lit(r"(?i)</?(?:p|div|br|section|article|figure|script)\b"))
    some = nodes.where("body IS NOT NULL")
    lines = F.array_join(F.filter(F.transform(F.split("body", "\n+"), M.plain), _said), "\n\n")
    plain = some.where(~tagged).select("page_id", "place", lines.alias("body"))
    inner = some.where(tagged).select(F.concat_ws(" ", "place", "page_id").alias("page_id"), F.concat(F.lit('<div id="structured-body">'), "body", F.lit("</div>")).alias("html"), F.col("page_id").alias("of"), F.col("place").alias("at"))
    rows = _marked(M.elements(inner))
    root = rows.where("node = 0").select("page_id", "node", F.lit(0).alias("place"), F.lit("ld+json").alias("source"), F.lit(True).alias("trusted"), F.lit(False).alias("lines"))
    read = _bodies(rows, root).join(inner.select("page_id", "of", "at"), "page_id").select(F.col("of").alias("page_id"), F.col("at").alias("place"), "body")
    return plain.unionByName(read).where("body <> ''")


def _chosen(page: DataFrame, candidates: str, chosen: str) -> DataFrame:
    """``page`` with the candidate that is the body: a site's own container, or the first; in place of structured data the container with the same text, or with all of it and clearly more."""
    own = F.get(F.filter(candidates, lambda c: c["source"] == "selector"), F.lit(0))
    page = page.withColumn("first", F.coalesce(own, F.get(candidates, F.lit(0))))
    page = page.withColumn("same", F.when(F.col("first.source") == "ld+json", F.col("first.same")))
    page = page.withColumn("bare", F.aggregate("headlines", F.col("same"), lambda t, h: F.when((h != "") & F.startswith(t, h), F.substring(t, F.length(h) + 1, F.length(t))).otherwise(t)))
    page = page.withColumn("enough", F.length("same") + F.greatest(F.lit(40), F.ceil(F.length("same") * 0.1)))
    more = lambda c: ~c["source"].isin("article", "scored") & (F.length(c["same"]) >= F.col("enough")) & F.contains(c["same"], F.col("same"))
    fits = F.filter(candidates, lambda c: (c["source"] != "ld+json") & ((c["same"] == F.col("same")) | ((F.col("bare") != "") & (c["same"] == F.col("bare"))) | more(c)))
    better = F.when(F.col("same").isNotNull(), F.get(fits, F.lit(0)))
    return page.withColumn(chosen, F.coalesce(better, F.col("first"))).drop("first", "same", "bare", "enough")


def article_bodies(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, body, source, status and chars (without white space) of every row of ``pages`` (page_id, url, html).

    ``rules`` (host, selector, exclude, trusted, lines) name the container of a site: a simple selector, others
    whose elements go, whether its place counts, and whether its lines are its paragraphs. Candidates are,
    in this order, the site's containers, JSON-LD bodies, CONTAINERS, and the element that scores best.
    Status: *ok* from ENOUGH characters on; *blocked* for challenges, and for pages with a barrier and no
    whole body; *short* for the longest candidate otherwise; *missing* without any.

    page_id must be unique and not null; null and empty pages are missing; a null url has no rule and names
    no JSON-LD article.
    """
    single = pages.select("page_id", "url", "html").where("page_id IS NOT NULL")
    rows = settle(M.elements(single))
    host = single.select("page_id", X.host(F.col("url")).alias("host"))
    keyed = rows.where("attributes IS NOT NULL").select("page_id", "node", F.explode(M.keys(F.col("tag"), F.col("attributes"))).alias("key"))
    site = None if rules is None else host.join(rules, "host").select("page_id", F.col("selector").alias("key"), "exclude", "trusted", "lines")
    extra = None if site is None else keyed.join(site.select("page_id", F.explode("exclude").alias("key")), ["page_id", "key"])
    marked = settle(_marked(rows, extra))
    order = single.sparkSession.createDataFrame([(s, i + 10_000) for i, s in enumerate(CONTAINERS)], "key string, place int")
    named = keyed.join(F.broadcast(order), "key").select("page_id", "node", "place", F.col("key").alias("source"), F.lit(False).alias("trusted"), F.lit(False).alias("lines"))  # one row a selector
    best = scored_containers(marked).select("page_id", "node", F.lit(20_000).alias("place"), F.lit("scored").alias("source"), F.lit(False).alias("trusted"), F.lit(False).alias("lines"))
    containers = named.unionByName(best)
    if site is not None:
        containers = containers.unionByName(keyed.join(site, ["page_id", "key"]).select("page_id", "node", F.lit(9_999).alias("place"), F.lit("selector").alias("source"), "trusted", "lines"))
    nodes = settle(article_nodes(rows, single))
    some = _bodies(marked, containers).select("page_id", "place", F.col("node").cast("long").alias("at"), "source", "body").unionByName(_structured(nodes).select("page_id", F.lit(0).alias("place"), F.col("place").alias("at"), F.lit("ld+json").alias("source"), "body"))
    candidate = F.struct("place", "at", "source", "body", M.content_length(F.col("body")).alias("chars"), X.normalised(F.col("body")).alias("same"))
    candidates = some.groupBy("page_id").agg(F.array_sort(F.collect_list(candidate)).alias("all"))
    headlines = nodes.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "headline"))), lambda h: X.normalised(F.coalesce(h["headline"], F.lit("")))).alias("headlines"), F.max("closed").alias("closed"))
    texts = rows.where("tag = '#text'").select("page_id", "node", "text", F.try_element_at("path", F.lit(-1)).alias("in"))
    titled = texts.join(rows.where("tag = 'title'").select("page_id", F.col("node").alias("in")), ["page_id", "in"]).groupBy("page_id").agg(F.max(F.rlike("text", F.lit(BARRED))).alias("challenge_title"))
    wall = (F.rlike(F.concat_ws(" ", M.attribute("class"), M.attribute("id"), M.attribute("data-testid")), F.lit("paywall"))) | M.attribute("data-paywall").isNotNull()
    barriers = rows.where("attributes IS NOT NULL").groupBy("page_id").agg(F.max(F.arrays_overlap(M.keys(F.col("tag"), F.col("attributes")), F.array(*map(F.lit, CHALLENGES)))).alias("challenge"), F.max(F.coalesce(wall, F.lit(False))).alias("wall"))
    said = texts.groupBy("page_id").agg(F.max(F.rlike(M.plain(F.col("text")), F.lit(BARRED))).alias("barred"))
    page = single.select("page_id")
    for part in (candidates, headlines, titled, barriers, said):
        page = page.join(part, "page_id", "left")
    page = page.withColumns({"all": F.coalesce("all", F.array()), "headlines": F.coalesce("headlines", F.array().cast("array<string>"))} | {c: F.coalesce(c, F.lit(False)) for c in ("closed", "challenge_title", "challenge", "wall", "barred")})
    long_ = F.filter("all", lambda c: c["chars"] >= ENOUGH)
    longest = F.array_sort("all", lambda a, b: F.when(a["chars"] > b["chars"], -1).when(a["chars"] < b["chars"], 1).when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    page = page.select("page_id", (F.col("challenge") | F.col("challenge_title")).alias("challenge"), (F.col("wall") | F.col("closed") | F.col("barred")).alias("barrier"), "headlines", long_.alias("long"), longest.alias("longest"))
    page = _chosen(_chosen(page, "long", "whole"), "longest", "part")
    status = F.when(F.col("challenge"), "blocked").when(F.col("whole").isNotNull(), "ok").when(F.col("barrier"), "blocked").when(F.col("part").isNotNull(), "short").otherwise("missing")
    page = page.withColumn("status", status).withColumn("c", F.when(F.col("status") == "ok", F.col("whole")).when(F.col("status") == "short", F.col("part")))
    return page.select("page_id", F.col("c.body").alias("body"), F.coalesce("c.source", F.lit("none")).alias("source"), "status", F.coalesce("c.chars", F.lit(0)).cast("long").alias("chars"))
