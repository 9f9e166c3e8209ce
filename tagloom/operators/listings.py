"""Listings of pages: entries of JSON-LD lists and of state that scripts carry, plain links, and the group of links that is a page's own list.

Scripts' values are found by a small table function and read as variants; links come from the table of a
page's elements. Groups of links are formed by the shape of their place in the page, and what the outlet's other
pages show tells furniture from stories.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tagloom.functions import text as X
from tagloom.sources import markup as M
from tagloom.sources.sinks import settle

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_SET = re.compile(r"(?:^|[;\s{(])(?:(?:window|self|globalThis)\s*(?:\.\s*|\[\s*[\"']))?([A-Za-z_$][\w$]*)(?:[\"']\s*\])?\s*=\s*(?=[{\[])")


def balanced(text: str, start: int) -> int:
    """The place after the bracket that closes the one at ``start``; -1 if none does. Brackets in strings don't count."""
    depth, at = 0, start
    while at < len(text):
        c = text[at]
        if c in "\"'`":
            at += 1
            while at < len(text) and text[at] != c:
                at += 2 if text[at] == "\\" else 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def script_values(html: str | None) -> Iterator[tuple[int, str, str]]:
    """(place, kind, JSON text) of the values in a page's scripts: *ld* for JSON-LD, *flat* for a list that names its parts by number, *state* for other JSON and values set to a variable."""
    place = 0
    for attributes, body in _SCRIPT.findall(html or ""):
        low = attributes.lower()
        if "json" in re.sub(r"\bsrc\s*=\s*\S+", "", low):
            kind = "ld" if "ld+json" in low else "flat" if "__nuxt_data__" in low else "state"
            found = [body.strip()]
        else:
            kind, found, at = "state", [], 0
            while m := _SET.search(body, at):
                stop = balanced(body, m.end())
                if stop < 0:
                    break
                found.append(body[m.end() : stop])
                at = stop
        for text in found:
            try:
                json.loads(text)
            except (ValueError, RecursionError):
                continue
            yield place, kind, text
            place += 1


@udtf(returnType="place int, kind string, value string")
class ScriptValues:
    def eval(self, html: str):
        yield from script_values(html)


def _registrable(url: Column) -> Column:
    """The last two labels of a URL's host, or three under a country's second level."""
    return F.regexp_extract(X.host(url), r"(?:^|\.)([^.]+\.(?:(?:com|org|net|gov|edu|co|idv|ac)\.[a-z]{2}|[^.]+))$", 1)


def _said(value: str, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(value, f"$.{n}", "string")), F.lit("")) for n in names])


def script_entries(pages: DataFrame, depth: int = 6) -> DataFrame:
    """page_id, source, at, url and title of the entries in the scripts of ``pages`` (page_id, html), as written.

    *json-ld*: elements of an ItemList. *flat*: objects of a numbered list that have a link and a title. *state*:
    objects that have both, up to ``depth`` levels down in other values. ``at`` orders them.
    """
    called = pages.select("page_id", "html").lateralJoin(ScriptValues(F.col("html").outer())).select("page_id", "place", "kind", F.try_parse_json("value").alias("v"))
    values = settle(called.select("page_id", "place", "kind", F.to_json("v").alias("json"))).select("page_id", "place", "kind", F.try_parse_json("json").alias("v"))
    # JSON-LD: the value itself, or those of a list or graph
    roots = values.where("kind = 'ld'")
    each = lambda rows, path: rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), path, "variant"))).select("page_id", "place", F.col("value").alias("v"))
    spread = roots.select("page_id", "place", "v").unionByName(each(roots, "$")).unionByName(each(roots, "$.@graph"))
    lists = spread.where(F.lower(F.try_variant_get("v", "$.@type", "string")) == "itemlist")
    element = lists.lateralJoin(lists.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), "$.itemListElement", "variant"))).select("page_id", F.array("place", "pos").alias("at"), F.col("value").alias("e"))
    item = element.select("page_id", "at", F.lit("json-ld").alias("source"), F.coalesce(_said("e", "url"), _said("e", "item.url"), _said("e", "item.@id"), _said("e", "item")).alias("url"), F.coalesce(_said("e", "name"), _said("e", "item.name")).alias("title"))
    # flat lists: numbers stand for other elements of the list
    flat = each_value(values.where("kind = 'flat'"))
    texts = flat.select("page_id", "place", F.col("pos").alias("n"), F.try_variant_get("v", "$", "string").alias("text")).where(F.schema_of_variant("v") == "STRING")
    number = lambda name: F.try_variant_get("v", f"$.{name}", "int")
    records = flat.select("page_id", "place", "pos", F.coalesce(number("link"), number("url"), number("href")).alias("l"), F.coalesce(number("title"), number("name")).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    numbered = records.join(texts.select("page_id", "place", F.col("n").alias("l"), F.col("text").alias("url")), ["page_id", "place", "l"]).join(texts.select("page_id", "place", F.col("n").alias("t"), F.trim("text").alias("title")), ["page_id", "place", "t"])
    numbered = numbered.select("page_id", F.array("place", "pos").alias("at"), F.lit("flat").alias("source"), "url", "title")
    # state: level by level
    level = values.where("kind = 'state'").select("page_id", F.array("place").alias("at"), "v")
    found = item.unionByName(numbered)
    for _ in range(depth):
        shape = F.schema_of_variant("v")
        found = found.unionByName(level.where(F.startswith(shape, F.lit("OBJECT"))).select("page_id", "at", F.lit("state").alias("source"), _said("v", "url", "link", "href").alias("url"), _said("v", "title", "name", "headline").alias("title")))
        inside = level.where(F.startswith(shape, F.lit("OBJECT")) | F.startswith(shape, F.lit("ARRAY")))
        level = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("v").outer())).select("page_id", F.concat("at", F.array("pos")).alias("at"), F.col("value").alias("v"))
    return found.where("url IS NOT NULL AND title IS NOT NULL AND title <> ''")


def each_value(rows: DataFrame) -> DataFrame:
    """page_id, place, pos and v of the elements of variants ``v``."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select("page_id", "place", "pos", F.col("value").alias("v"))


#: Texts of links that are no titles, and parts of paths that are no stories.
NO_TITLE = r"(?i)^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^(?:→\s*)?(?:看更多|more|更多|閱讀|詳全文)"
NAVIGATION = r"(?i)^(?:tags?|categor(?:y|ies)|cat|plans?|authors?|writers?|columnists?|search|keywords?|labels?|members?|login|signin|signup|register|subscribe|newsletter)$"
_CARDS, _HEADINGS = ("li", "article", "div"), ("h1", "h2", "h3", "h4")


def page_links(rows: DataFrame) -> DataFrame:
    """page_id, node, href, title and shape of the links of pages (``rows``: their elements).

    The title is the link's text; where that is none, a date or a word for *more*, the first heading of the
    innermost li, article or div around it. The shape is the tags and first classes of the elements around the
    link and of the link, so that entries of one list have one.
    """
    links = rows.where((F.col("tag") == "a") & (F.trim(M.attribute("href")) != "")).select("page_id", "node", F.trim(M.attribute("href")).alias("href"), "path")
    words = rows.where("tag = '#text' AND link IS NOT NULL").groupBy("page_id", F.col("link").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "text"))).alias("t"))
    own = words.select("page_id", "node", M.plain(F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("text"))
    name = F.concat(F.col("tag"), F.coalesce(F.concat(F.lit("."), F.nullif(F.split_part(F.trim(M.attribute("class")), F.lit(" "), F.lit(1)), F.lit(""))), F.lit("")))
    above = links.select("page_id", "node", F.posexplode(F.concat("path", F.array("node"))).alias("depth", "at")).join(rows.where("attributes IS NOT NULL").select("page_id", F.col("node").alias("at"), name.alias("name"), F.col("tag").isin(*_CARDS).alias("is_card")), ["page_id", "at"])
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]), ">")
    around = above.groupBy("page_id", "node").agg(shape.alias("shape"), F.max(F.when(F.col("is_card"), F.col("at"))).alias("card"))
    titled = rows.where("attributes IS NOT NULL").where(F.col("tag").isin(*_HEADINGS) | F.rlike(F.coalesce(M.attribute("class"), F.lit("")), F.lit("title"))).select("page_id", F.col("node").alias("h"), F.explode("path").alias("card"))
    first = titled.join(around.select("page_id", "card").distinct(), ["page_id", "card"]).groupBy("page_id", "card").agg(F.min("h").alias("h"))
    inside = rows.where("tag = '#text'").select("page_id", "node", "text", F.explode("path").alias("h")).join(first.select("page_id", "h").distinct(), ["page_id", "h"])
    heading = inside.groupBy("page_id", "h").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("t")).select("page_id", "h", M.plain(F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("heading"))
    found = links.drop("path").join(own, ["page_id", "node"], "left").join(around, ["page_id", "node"], "left").join(first, ["page_id", "card"], "left").join(heading, ["page_id", "h"], "left")
    text = F.coalesce("text", F.lit(""))
    guessed = ((text == "") | F.rlike(text, F.lit(NO_TITLE))) & (F.coalesce("heading", F.lit("")) != "")
    return found.select("page_id", "node", "href", F.when(guessed, F.col("heading")).otherwise(text).alias("title"), guessed.alias("guessed"), F.coalesce("shape", F.lit("")).alias("shape"))


def listings(pages: DataFrame, pattern: str = "", own_site: bool = True, title_chars: int = 512) -> DataFrame:
    """page_id, source, place, url and title of the entries of every row of ``pages`` (page_id, url, html) whose address has ``pattern``.

    A page's JSON-LD lists count, or else its flat list, or else other state, or else its links (those within its
    site, unless ``own_site`` is false). Of entries with one address the first counts; of links a title of the
    link's own before one from a heading, then the longer one. Pages without page_id or url have none.
    """
    single = pages.select("page_id", "url", "html").where("page_id IS NOT NULL AND url IS NOT NULL")
    base = single.select("page_id", F.col("url").alias("base"))
    scripts = script_entries(single).join(base, "page_id").withColumn("url", X.absolute(F.col("url"), F.col("base")))
    links = page_links(settle(M.elements(single))).where(~F.rlike("href", F.lit(r"\s")) & (F.length("title") >= 2) & ~F.rlike("title", F.lit(NO_TITLE))).join(base, "page_id")
    links = links.select("page_id", F.lit("links").alias("source"), F.array("node").alias("at"), X.strip_tracking(X.absolute(F.col("href"), F.col("base"))).alias("url"), "title", "base", "guessed")
    if own_site:
        links = links.where(_registrable(F.col("url")) == _registrable(F.col("base")))
    every = scripts.select("page_id", "source", "at", "url", "title", F.lit(False).alias("guessed"), F.lit(0).alias("longer")).unionByName(links.select("page_id", "source", "at", "url", "title", "guessed", (-F.length("title")).alias("longer")))
    every = every.where(F.rlike("url", F.lit(pattern)))
    one = every.groupBy("page_id", "source", "url").agg(F.min("at").alias("at"), F.min_by("title", F.struct("guessed", "longer", "at")).alias("title"))
    order = F.expr("CASE source WHEN 'json-ld' THEN 0 WHEN 'flat' THEN 1 WHEN 'state' THEN 2 ELSE 3 END")
    best = one.withColumn("o", order).withColumn("least", F.min("o").over(Window.partitionBy("page_id"))).where("o = least")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at", "url"))
    return best.select("page_id", "source", place.alias("place"), "url", F.left("title", F.lit(title_chars)).alias("title"))


def key_shape(key: Column) -> Column:
    """The pattern of a URL key: host, first part of the path, then # for digits, 9 for parts with digits and _ for others."""
    host = F.regexp_extract(key, "^[^/#?]*", 0)
    rest = F.regexp_extract(key, "^[^/#?]*(.*)$", 1)
    parts = F.filter(F.split(F.split_part(rest, F.lit("?"), F.lit(1)), "/"), lambda s: s != "")
    named = F.transform(parts, lambda s, i: F.when(F.rlike(s, F.lit("^[0-9]+$")), "#").when(F.rlike(s, F.lit("[0-9]")), "9").when(i == 0, F.lower(s)).otherwise("_"))
    return F.when(F.startswith(rest, F.lit("#")), F.concat(host, F.lit("#"))).otherwise(F.concat(host, F.lit("/"), F.array_join(named, "/")))


def navigation(key: Column) -> Column:
    """Whether a URL key is that of a tag, category, author, search or member page."""
    path = F.split_part(F.regexp_extract(key, "^[^/#?]*(.*)$", 1), F.lit("?"), F.lit(1))
    return ~F.startswith(path, F.lit("#")) & F.exists(F.split(path, "/"), lambda s: F.rlike(s, F.lit(NAVIGATION)))


def _headline(title: Column) -> Column:
    return F.length(F.regexp_replace(title, r"[\d\s\p{P}\p{S}]", "")) >= 8


def story_groups(pages: DataFrame, crawled: DataFrame | None = None, least: int = 2) -> DataFrame:
    """page_id, shape, place, key and title of the links of each page's own list of stories.

    ``pages`` has page_id, outlet, url and html; ``crawled`` the keys (outlet, key) of articles that are known.
    Links of one shape are a group, navigation left out. Groups mostly of navigation, labels or furniture
    (links that other pages of the outlet have too) don't count. The group with the most known stories
    (at least ``least``) wins, then one with links shaped like the outlet's articles, then the larger one;
    failing that, of those that read like headlines, the one shaped like articles, then the larger one.
    Equal ones go by shape.
    """
    single = pages.where("page_id IS NOT NULL AND url IS NOT NULL")
    links = page_links(settle(M.elements(single))).join(single.select("page_id", "outlet", F.col("url").alias("base")), "page_id")
    keyed = links.withColumn("key", X.url_key(X.absolute(F.col("href"), F.col("base")))).groupBy("outlet", "page_id", "shape", "key").agg(F.min("node").alias("node"), F.max_by("title", F.struct(F.length("title"), "title")).alias("title"))
    keyed = settle(keyed.where(F.col("key") != ""))
    furniture = keyed.select("outlet", "page_id", "key").distinct().groupBy("outlet", "key").agg((F.count(F.lit(1)) > 1).alias("furniture"))
    known = (crawled if crawled is not None else keyed.select("outlet", "key").limit(0)).select("outlet", "key").distinct().where("key IS NOT NULL")
    counts = known.groupBy("outlet", key_shape(F.col("key")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("outlet").agg(F.sum("n").alias("all"))
    usual = counts.join(total, "outlet").where("n >= 2 AND n >= 0.02 * all").select("outlet", "pattern", F.lit(True).alias("usual"))
    told = keyed.join(furniture, ["outlet", "key"]).join(known.withColumn("crawled", F.lit(True)), ["outlet", "key"], "left").withColumn("pattern", key_shape(F.col("key"))).join(usual, ["outlet", "pattern"], "left")
    told = settle(told.select("page_id", "shape", "node", "key", "title", "furniture", F.coalesce("crawled", F.lit(False)).alias("crawled"), F.coalesce("usual", F.lit(False)).alias("usual"), navigation(F.col("key")).alias("nav"), _headline(F.col("title")).alias("headline")))
    story = ~F.col("nav")
    groups = told.groupBy("page_id", "shape").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(story).alias("n"), F.count_if("headline").alias("headlines"), F.count_if(story & (F.col("title") != "")).alias("titled"), F.count_if(story & F.col("headline")).alias("own_headlines"),
        F.count_if(story & F.col("furniture")).alias("furniture"), F.count_if(story & F.col("crawled")).alias("crawled"), F.count_if(story & F.col("usual")).alias("usual"),
    )
    labels = (F.col("titled") >= 3) & (F.col("own_headlines") < 0.3 * F.col("titled"))
    groups = groups.where((F.col("n") > F.col("all") / 2) & ~labels & (F.col("furniture") <= 0.5 * F.col("n")))
    articles = (F.col("usual") >= 0.5 * F.col("n")).cast("int")
    enough, reads = F.col("crawled") >= least, (F.col("all") >= 3) & (F.col("headlines") >= 0.6 * F.col("all"))
    order = Window.partitionBy("page_id").orderBy(F.desc(enough), F.desc(F.when(enough, F.col("crawled")).otherwise(0)), F.desc(articles), F.desc("n"), "shape")
    best = groups.where(enough | reads).withColumn("k", F.row_number().over(order)).where("k = 1").select("page_id", "shape", enough.alias("own"))
    # a list that is known drops its navigation links; one that reads like headlines too
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node"))
    return told.where(story).join(best, ["page_id", "shape"]).select("page_id", "shape", place.alias("place"), "key", "title")
