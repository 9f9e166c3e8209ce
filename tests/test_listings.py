"""Listings and story groups against plain versions."""

import json
import re

from pyspark.sql import functions as F

from tagloom.operators import listings as L
from tagloom.sources import markup as M

SF = "/root/testdata/sf0.001"


def ld(value):
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


LINKS = "".join(f'<li class="x{i}"><a href="/s/{i}?utm_source=q"><img><b>Story</b> number {i}</a></li>' for i in range(4))
FLAT = [["a"], {"link": 2, "title": 3}, "https://h.tw/t/1", " One ", {"link": 5, "title": 3}, 7, {"url": 2, "name": 3}, {"link": 99, "title": 3}]
PAGES = {
    "null": (None, []), "empty": ("", []), "links": (LINKS, [("links", f"https://h.tw/s/{i}", f"Story number {i}") for i in range(4)]),
    "ld": (LINKS + ld({"@type": "ItemList", "itemListElement": [{"url": "/t/1", "name": "One "}, {"item": {"@id": "https://h.tw/t/2", "name": "Two"}}, {"url": "/t/3"}, {"url": "/t/1", "name": "Again"}, 5]}), [("json-ld", "https://h.tw/t/1", "One"), ("json-ld", "https://h.tw/t/2", "Two")]),
    "ld graph": (ld({"@graph": [{"@type": "WebPage"}, {"@type": "itemlist", "itemListElement": [{"url": "t/1", "name": "G"}]}]}), [("json-ld", "https://h.tw/a/t/1", "G")]),
    "ld list": (ld([{"@type": "ItemList", "itemListElement": [{"url": "/t/1", "name": "L"}]}]), [("json-ld", "https://h.tw/t/1", "L")]),
    "flat": (f'<script type="application/json" id="__NUXT_DATA__">{json.dumps(FLAT)}</script>{LINKS}', [("flat", "https://h.tw/t/1", "One")]),
    "state": ('<script>var a = 1; window.__STATE__ = {"x": "}\\" ]", "list": [{"title": "T1", "link": "/t/1", "in": {"name": "T2", "href": "/t/2"}}, {"title": ""}]}; b = [{"url": "/t/3", "headline": "T3"}];</script>', [("state", "https://h.tw/t/3", "T3"), ("state", "https://h.tw/t/1", "T1"), ("state", "https://h.tw/t/2", "T2")]),
    "broken": (f"<script>window.x = {{not json}}; y = [1, 2</script><script type='application/ld+json'>{{</script>{LINKS[:60]}</a>", [("links", "https://h.tw/s/0", "Story")]),
    "titles": ('<div><h3>Heading</h3><a href="/m">more</a><a href="/n">2024/1/2 x</a></div><a href="/p">x</a><a href="/q">更多</a><a href="http://o.tw/r">Other site</a><a href="//sub.h.tw/u">Sub site</a><a href="a b">Blank</a><a>None</a><div class=card><span class=big-title>Big</span><a href="/m"><img></a></div><a href="/m">My</a>',
               [("links", "https://h.tw/m", "My"), ("links", "https://h.tw/n", "Heading"), ("links", "https://sub.h.tw/u", "Sub site")]),
}


def test_listings(spark):
    frame = spark.createDataFrame([(k, "https://h.tw/a/index.html?x=1", h, 1, "s") for k, (h, _) in PAGES.items()] + [("no url", None, LINKS, 1, "s"), (None, "https://h.tw/", LINKS, 1, "s")], "page_id string, url string, html string, place int, source string")
    got = {}
    for r in sorted(L.listings(frame).collect()):
        got.setdefault(r.page_id, []).append((r.source, r.url, r.title))
    want = {k: v for k, (_, v) in PAGES.items() if v}
    assert {k: (v, want.get(k)) for k, v in got.items() if sorted(v) != sorted(want.get(k, []))} == {} and got.keys() == want.keys()
    assert got["ld"] == want["ld"] and got["links"] == want["links"] and got["titles"] == want["titles"]
    few = L.listings(frame, pattern=r"/t/\d").collect()
    assert {r.url for r in few} == {"https://h.tw/t/1", "https://h.tw/t/2", "https://h.tw/t/3", "https://h.tw/a/t/1"}
    assert L.listings(frame.limit(0)).collect() == []


def test_balanced():
    assert L.balanced('{"a": "}", "b": [1, {"c": "\\"]"}]} x', 0) == 34
    assert L.balanced("{[", 0) == -1 and L.balanced('{"', 0) == -1 and L.balanced("[]", 0) == 2


def test_links_of_all_pages(spark):
    """Every link with a title, by a plain walk of each page's rows."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted((r.page_id, r.node, r.href, r.title) for r in L.page_links(M.elements(pages)).collect())
    want = []
    for p in pages.collect():
        rows = M.page_rows(p.html)
        for r in rows:
            if r["tag"] == "a" and r["attributes"].get("href", "").strip():
                text = "".join(x["text"] for x in rows[r["node"] + 1 : r["stop"]] if x["tag"] == "#text" and x["link"] == r["node"])
                want.append((p.page_id, r["node"], r["attributes"]["href"].strip(), re.sub(r"\s+", " ", text).strip()))
    assert got == sorted(want) and len(got) > 200


def story_pages():
    nav = "".join(f'<li><a href="/n/{i}">Front page section {i}</a></li>' for i in range(6))
    page = lambda i, extra="": f"<nav><ul>{nav}</ul></nav><main class='m'>" + "".join(f'<div class="card"><a href="/news/{i}{k}">A rather long headline {k}</a><a class=t href="/tag/{k}">tag</a></div>' for k in range(4)) + f"</main>{extra}"
    side = "<aside>" + "".join(f'<p><a href="/old/abc-{k}x">Another quite long headline {k}</a></p>' for k in range(9)) + "</aside>"
    return [(1, "o", "https://h.tw/t/1", page(1)), (2, "o", "https://h.tw/t/2", page(2, side)), (3, "o", "https://h.tw/t/3", page(3)), (4, "q", "https://q.tw/", nav), (5, "r", "https://r.tw/", None), (6, "s", "https://s.tw/", side), (7, "u", "https://u.tw/", "<p>" + "<a href='/a/1'>tag</a><a href='/b/2'>two</a><a href='/c/3'>x y</a>" + "</p>")]


def test_story_groups(spark):
    pages = spark.createDataFrame(story_pages(), "page_id int, outlet string, url string, html string")
    known = spark.createDataFrame([("o", f"h.tw/news/{i}") for i in (10, 11, 20, 21, 31, 32, 77)] + [("o", None)], "outlet string, key string")
    got = {}
    for r in sorted(L.story_groups(pages, known).collect()):
        got.setdefault(r.page_id, []).append(r.key)
    assert {k: got.get(k) for k in (1, 2, 3)} == {i: [f"h.tw/news/{i}{k}" for k in range(4)] for i in (1, 2, 3)}
    assert got[4] == [f"q.tw/n/{i}" for i in range(6)] and got[6] == [f"s.tw/old/abc-{k}x" for k in range(9)] and not {5, 7} & got.keys()
    without = {}
    for r in L.story_groups(pages).collect():
        without.setdefault(r.page_id, set()).add(r.key)
    assert without[2] == {f"h.tw/old/abc-{k}x" for k in range(9)}  # nothing known: the larger list of headlines


def test_shapes(spark):
    keys = {"newtalk.tw/news/view/2026-10-01/1063052": "newtalk.tw/news/_/9/#", "h.tw#12": "h.tw#", "h.tw": "h.tw/", "h.tw/A/B?x=1": "h.tw/a/_", "h.tw//12a": "h.tw/9"}
    frame = spark.createDataFrame(list(keys.items()), "k string, s string")
    assert frame.where(L.key_shape(F.col("k")) != F.col("s")).count() == 0
    nav = spark.createDataFrame([("h.tw/tag/x",), ("h.tw/news/Authors",), ("h.tw/news?tag=1",), ("h.tw#tag",), ("h.tw/tagged/x",)], "k string")
    assert [r.n for r in nav.select(L.navigation(F.col("k")).alias("n")).collect()] == [True, True, False, False, False]
