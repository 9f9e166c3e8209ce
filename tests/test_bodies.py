"""Article bodies against a plain version that walks each page's tree."""

import json
import re

import pytest

from tagloom.operators import bodies as B
from tagloom.sources import markup as M

SF = "/root/testdata/sf0.001"
SPACE = "\t\n\x0b\x0c\r                  　﻿"


def plain(t):
    return re.sub(f"[{SPACE}]+", " ", re.sub("[​-‍﻿]", "", t)).strip(" ")


def size(t):
    return len(re.sub(f"[{SPACE}]", "", t))


def said(t):
    return t and not re.search(B.PAGE_TALK, t) and not re.search(B.BARRED, t)


class Page:
    def __init__(self, html):
        self.rows = M.page_rows(html)
        for r in self.rows:
            r["a"] = r["attributes"]
        self.aside = [self._aside(r) for r in self.rows]

    def keys(self, r):
        if r["a"] is None:
            return set()
        a = r["a"]
        return {r["tag"], *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if "id" in a else []), *(f"[{k}]" for k in a), *(f"[{k}={v}]" for k, v in a.items())}

    def _aside(self, r):
        if r["a"] is None or r["tag"] in ("html", "body"):
            return False
        classes = " ".join(c for c in r["a"].get("class", "").split() if not re.fullmatch(B.NOT_ASIDE, c))
        return bool(self.keys(r) & set(B.NO_TEXT) or re.search(B.ASIDE, f"{classes} {r['a'].get('id', '')}") or re.search(B.UNSEEN, r["a"].get("style", "")))

    def texts(self, node, trusted):
        """Shown texts inside a container as (row, text)."""
        for r in self.rows[node + 1 : self.rows[node]["stop"]]:
            if r["tag"] in ("#text", "br"):
                inner = [p for p in [*r["path"], r["node"]] if p > node]
                if not any(self.aside[p] or self.rows[p]["tag"] == "form" for p in inner):
                    yield r, "\n" if r["tag"] == "br" else r["text"]

    def body(self, node, source, trusted=False, lines=False):
        if not trusted and any(self.aside[p] for p in [*self.rows[node]["path"], node]):
            return ""
        para = {}
        for r, t in self.texts(node, trusted):
            if r["para"] is not None and r["para"] >= node:
                p = para.setdefault(r["para"], ["", ""])
                p[0] += t
                p[1] += t if r["link"] is not None and r["link"] > r["para"] else ""
        para = {k: (plain(t), plain(linked)) for k, (t, linked) in para.items() if plain(t)}
        if lines or (not para and source != "article"):
            out, at = "", node + 1
            events = [(2 * r["node"] + 1, t) for r, t in self.texts(node, trusted) if not any(self.rows[p]["tag"] in B.HEADS for p in r["path"] if p > node)]
            for r in self.rows[node + 1 : self.rows[node]["stop"]]:
                inner = [p for p in [*r["path"], r["node"]] if p > node]
                gone = any(self.aside[p] or self.rows[p]["tag"] in ("form", *B.HEADS) for p in inner)
                if not gone and (r["tag"] in B.BLOCKS or lines and r["tag"] == "p"):
                    events.append((2 * r["stop"], "\n\n"))
            out = "".join(t for _, t in sorted(events))
            return "\n\n".join(x for x in map(plain, re.split("\n+", out)) if said(x))
        return "\n\n".join(t for k, (t, linked) in sorted(para.items()) if said(t) and size(linked) / max(size(t), 1) <= B.LINKED)

    def scored(self):
        blocks, text, linked = {}, {}, {}
        for r in self.rows:
            if r["tag"] == "#text" and not any(self.aside[p] for p in r["path"]):
                inside = [p for p in r["path"] if self.rows[p]["tag"] in B.SCORED]
                for p in r["path"]:
                    text[p] = text.get(p, 0) + size(r["text"])
                    linked[p] = linked.get(p, 0) + (size(r["text"]) if r["link"] is not None else 0)
                if inside:
                    blocks.setdefault(inside[-1], []).append(r["text"])
        points = {}
        for b, ts in blocks.items():
            t = plain("".join(ts))
            if len(t) >= B.SCORED_CHARS:
                worth = 1 + len(re.findall("[,，、]", t)) + min(len(t) // 100, 3)
                path = self.rows[b]["path"]
                for node, halves in ((path[-1:], 2), (path[-2:-1], 1), ([b] if self.rows[b]["tag"] != "p" else [], 2)):
                    for n in node:
                        points[n] = points.get(n, 0) + worth * halves
        best = sorted((-round(h / 2 * (1 - linked[n] / max(text[n], 1)), 6), n) for n, h in points.items())
        return best[0][1] if best else None


def bare(url):
    return re.sub("/+$", "", re.sub("^https?://", "", url or "").split("#")[0].split("?")[0])


def brute(url, html, rule=None):
    page = Page(html)
    nodes, candidates = [], []
    for r in page.rows:
        if r["tag"] == "script" and r["a"].get("type", "").lower() == "application/ld+json":
            nodes += B._linked_data("".join(x["text"] for x in page.rows[r["node"] + 1 : r["stop"]]))
    urls = lambda n: [u["@id"] if isinstance(u, dict) else u for u in (n.get("url"), n.get("@id"), n.get("mainEntityOfPage")) if isinstance(u, (str, dict))]
    mine = [n for n in nodes if bare(url) in map(bare, urls(n))]
    nodes = mine or [n for n in nodes if not urls(n)]
    for n in nodes:
        t = n.get("articleBody") or ""
        if re.search(r"(?i)</?(?:p|div|br|section|article|figure|script)\b", t):
            t = Page(f'<div id="structured-body">{t}</div>').body(0, "ld+json", True)
        else:
            t = "\n\n".join(x for x in map(plain, re.split("\n+", t)) if said(x))
        candidates.append(("ld+json", t))
    if rule:
        selector, exclude, trusted, lines = rule
        for i, r in enumerate(page.rows):
            page.aside[i] |= bool(page.keys(r) & set(exclude))
        candidates += [("selector", page.body(r["node"], "selector", trusted, lines)) for r in page.rows if selector in page.keys(r)]
    for s in B.CONTAINERS:
        candidates += [(s, page.body(r["node"], s)) for r in page.rows if s in page.keys(r)]
    best = page.scored()
    candidates += [("scored", page.body(best, "scored"))] if best is not None else []
    candidates = [c for c in candidates if c[1]]
    texts = [r for r in page.rows if r["tag"] == "#text"]
    if any(page.keys(r) & set(B.CHALLENGES) for r in page.rows) or any(re.search(B.BARRED, r["text"]) for r in texts if r["path"] and page.rows[r["path"][-1]]["tag"] == "title"):
        return None, "none", "blocked", 0
    same = lambda t: re.sub(r"[\W_]", "", t).lower()

    def choose(found):
        first = next((c for c in found if c[0] == "selector"), found[0] if found else None)
        if first and first[0] == "ld+json":
            s = same(first[1])
            b = s
            for n in nodes:
                h = same(n.get("headline") or "")
                b = b[len(h) :] if h and b.startswith(h) else b
            for c in found:
                d = same(c[1])
                if c[0] != "ld+json" and (d == s or b and d == b or c[0] not in ("article", "scored") and len(d) >= len(s) + max(40, -(-len(s) // 10)) and s in d):
                    return c
        return first

    whole = choose([c for c in candidates if size(c[1]) >= B.ENOUGH])
    if whole:
        return whole[1], whole[0], "ok", size(whole[1])
    wall = any("paywall" in " ".join([r["a"].get("class", ""), r["a"].get("id", ""), r["a"].get("data-testid", "")]) or "data-paywall" in r["a"] for r in page.rows if r["a"] is not None)
    if wall or any(n.get("isAccessibleForFree") in (False, "false") for n in nodes) or any(re.search(B.BARRED, plain(r["text"])) for r in texts):
        return None, "none", "blocked", 0
    part = choose(sorted(candidates, key=lambda c: -size(c[1])))
    return (part[1], part[0], "short", size(part[1])) if part else (None, "none", "missing", 0)


LONG = "The council met on Monday, and after a long debate, voted for the plan that it had put off, twice, in the spring. "
P = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
NAV = '<nav><p>' + LONG * 3 + '</p></nav><ul class="menu">' + "".join(f'<li><a href="/{i}">A rather long headline of another story, number {i}</a></li>' for i in range(30)) + "</ul>"


def ld(**node):
    return f'<script type="application/ld+json">{json.dumps(node)}</script>'


def odd_pages():
    pages = {
        "null": None, "empty": "", "text only": LONG * 3, "no end": f"<div><div class='x'><p>{LONG * 3}", "named": f"{NAV}<article>{P}<aside><p>{LONG}</p></aside></article>",
        "div only": f"<div>{NAV.replace('nav', 'div')}</div><div><div>{P}</div></div>", "line breaks": f"<div id=a>{NAV}<div><h1>Head</h1>{LONG}<br>{LONG}<br><br>{LONG}</div></div>",
        "two articles": f"<article><p>short</p></article><article>{P}</article>", "body beats article": f"<article><div class='entry-content'>{P}</div><p>after</p></article>",
        "in a form": f"<form><div class='article-body'>{P}<form><p>{LONG}</p></form></div></form>", "beside": f"<div class='sidebar related'><div class='article-body'>{P}</div></div><div class='share-bar x'>{P}</div>",
        "hidden": f"<article><div style='display: none'>{P}</div><p hidden>{LONG}</p>{P}</article>", "not aside": f"<article class='has-banner no-share'>{P}</article>", "article without p": f"<article>{LONG * 4}</article>",
        "links": f"<article>{P}<p><a href=x>{LONG}</a> and</p><p>{LONG}<a href=y>so</a></p></article>", "talk": f"<article>{P}<p>Advertisement here</p><p>廣告</p><p>Subscribe to read more</p></article>",
        "ld": ld(**{"@type": "NewsArticle", "articleBody": LONG * 3}) + "<p>other</p>", "ld other": ld(**{"@type": "NewsArticle", "url": "https://x.tw/else", "articleBody": LONG * 3}) + "<p>other</p>",
        "ld graph": ld(**{"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "http://schema.org/BlogPosting"], "mainEntityOfPage": {"@id": "https://h.tw/ld graph"}, "articleBody": f"<p>{LONG * 2}</p><script>no</script><p>{LONG}</p>"}]}),
        "ld same": ld(**{"@type": "Article", "headline": "Big News", "articleBody": "Big news! " + "".join(f"{LONG}{i}" for i in range(4))}) + f"<article>{P}</article>",
        "ld teaser": ld(**{"@type": "Article", "articleBody": LONG * 3}) + f"<div class='post-content'><p>{LONG * 3}</p><p>{'More of it. ' * 9}</p></div>", "ld article longer": ld(**{"@type": "Article", "articleBody": LONG * 3}) + f"<article><p>{LONG * 5}</p></article>",
        "ld broken": f'<script type="application/ld+json">{{"@type": </script><article>{P}</article>', "closed": ld(**{"@type": "Article", "isAccessibleForFree": "false", "articleBody": "a few words"}), "wall": f"<div class='paywall-x'>Pay</div><article><p>{LONG}</p></article>",
        "challenge": f"<div id='challenge-form'></div><article>{P}</article>", "title": f"<title>Just a moment...</title><article>{P}</article>", "barred": "<p>Access denied</p>", "short": "<article><p>Few words.</p></article><div class='story-body'><p>A few more words.</p></div>",
        "entities": f"<article><p>&lt;b&gt; &amp;amp; caf&eacute;​ &nbsp; {LONG * 3}</p></article>", "nested tables": f"<table><tr><td>{NAV}<td><table><tr><td>{LONG * 4}</table></table>", "deep": "<div>" * 200 + P + "</div>" * 200,
        "many": f"<div class='article-content'>{LONG}</div>" * 40 + f"<div class='article-content'>{P}</div>", "long": f"<article>{P * 700}</article>",
    }
    return [(f"{i:02d} {k}", f"https://h.tw/{k}", v) for i, (k, v) in enumerate(pages.items())]


def got(frame):
    return {r.page_id: (r.body, r.source, r.status, r.chars) for r in frame.collect()}


def test_odd_pages(spark):
    pages = odd_pages()
    found = got(B.article_bodies(spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id string, url string, html string, body string, node int")))
    want = {i: brute(u, h) for i, u, h in pages}
    assert {k: v for k, v in found.items() if v != want[k]} == {} and found.keys() == want.keys()
    status = {k[3:]: v[2] for k, v in found.items()}
    assert sorted(k for k, v in status.items() if v == "blocked") == ["barred", "challenge", "closed", "title", "wall"]
    assert status["null"] == status["empty"] == status["article without p"].replace("ok", "missing") == "missing"
    source = {k[3:]: v[1] for k, v in found.items()}
    assert (source["ld"], source["ld same"], source["ld teaser"], source["ld article longer"], source["div only"], source["body beats article"]) == ("ld+json", "article", ".post-content", "ld+json", "scored", ".entry-content")
    assert found["10 beside"][0] is None or LONG[:40] not in found["10 beside"][0]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_all_pages_of_a_table(spark, tag):
    pages = [(r.page_id, r.url, r.html.replace("<article", f"<{tag}").replace("</article", f"</{tag}")) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    found = got(B.article_bodies(spark.createDataFrame(pages, "page_id long, url string, html string")))
    want = {i: brute(u, h) for i, u, h in pages}
    assert {k: v for k, v in found.items() if v != want[k]} == {} and len(found) == len(pages)
    if tag == "div":  # the scored container is the article's
        named = got(B.article_bodies(spark.read.parquet(f"{SF}/pages.parquet")))
        assert sum(found[k][0] == named[k][0] for k in named) >= 0.95 * len(named)


def test_rules_of_sites(spark):
    html = f"<div class='related'><div class='text'><p>{LONG * 3}</p><span class='pull'><p>{LONG}</p></span></div></div><article>{P}</article><div class='raw'>One line,<p>{LONG}</p><p>{LONG * 2}</p></div>"
    pages = spark.createDataFrame([(1, "https://a.tw/1", html), (2, "https://b.tw/2", html), (3, "https://c.tw/3", html), (4, None, html)], "page_id long, url string, html string")
    rules = {"a.tw": (".text", [".pull"], True, False), "b.tw": (".raw", [], False, True), "d.tw": ("article", [], False, False)}
    found = got(B.article_bodies(pages, spark.createDataFrame([(h, *r) for h, r in rules.items()], "host string, selector string, exclude array<string>, trusted boolean, lines boolean")))
    want = {1: brute("https://a.tw/1", html, rules["a.tw"]), 2: brute("https://b.tw/2", html, rules["b.tw"]), 3: brute("https://c.tw/3", html), 4: brute(None, html)}
    assert found == want and [found[i][1] for i in (1, 2, 3)] == ["selector", "selector", "article"]


def test_no_pages(spark):
    assert B.article_bodies(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
