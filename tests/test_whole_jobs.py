"""Jobs that used to make a row for each pair or a recursive query, against plain Python."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import events as E
from tagloom.operators import graphs as G
from tagloom.operators import ranking as R


def test_references_without_semicolon_stay(spark):
    from tagloom.plans.language import decode_entities

    said = ["a &amp; b &lt;c&gt;", "cut &amp", "&ampx; &copy 2020 &notit;", "&amp;lt; &#39;&#x41;&#65", None]
    got = [r.t for r in spark.createDataFrame(pd.DataFrame({"i": range(5), "s": said}), "i int, s string").select("i", decode_entities("s").alias("t")).orderBy("i").collect()]
    assert got == ["a & b <c>", "cut &amp", "&ampx; &copy 2020 &notit;", "< 'A&#65", None]


def test_equal_scores_stand_by_tag(spark):
    """Fifty tags with the same counts at other outlets have one score, and so stand in byte order."""
    n = spark.range(50).select(F.format_string("t%02d", "id").alias("tag"), F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("media"))
    rows = n.select("tag", "media", F.explode(F.sequence(F.lit(1), 20 + (F.col("media") * 7 + F.col("i") * 11) % 25)).alias("article_id"))
    rows = rows.repartition(7, "media").select("*", F.lit("1998-01-20").cast("timestamp_ntz").alias("published_at"))
    got = R.charts_at_lags(rows, "1998-01-31", 30, 50).where("lag = 0").orderBy("rank").collect()
    assert [r.tag for r in got] == [f"t{i:02d}" for i in range(50)] and len({r.norm for r in got}) == 1


def test_rows_past_the_limit_of_recursion(spark):
    old = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        edges = spark.createDataFrame([(f"c{i}", f"n{i % 5}") for i in range(60)] + [(f"n{i}", f"r{i % 2}") for i in range(5)] + [("r0", "world"), ("r1", "world"), ("r1", "n1")], "child string, parent string")
        up = {}
        for c, p in edges.collect():
            up.setdefault(c, set()).add(p)
        want, front = {}, {(c, p) for c in up for p in up[c]}
        for depth in range(1, 9):
            for pair in front:
                want.setdefault(pair, depth)
            front = {(c, q) for c, p in front for q in up.get(p, ())}
        assert {(r.node, r.ancestor): r.depth for r in G.ancestors(edges).collect()} == want
        roles = {"r1": "west", "n3": "third", "world": "all"}
        got = dict(G.inherited(edges, spark.createDataFrame(list(roles.items()), "id string, role string")).collect())
        next_ = lambda c: roles[c] if c in roles else roles[min((d, a) for (x, a), d in want.items() if x == c and a in roles)[1]]
        assert got == {c: next_(c) for c in up}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)


def test_related_threads_of_sets(spark):
    sets = [["a"], ["a", "b"], ["b", "a", "c"], ["c"], ["d"], []]
    t = [(f"{u}-{d}", date(2024, 1, d), sets[(u * d + u) % 6]) for u in range(40) for d in (1, 2, 3)]
    got = {(r.a, r.b, r.hits) for r in E.related_threads(spark.createDataFrame(t, "id string, day date, majors array<string>")).collect()}
    want = set()
    for a, day, x in t:
        met = [(-len(set(x) & set(y)), b) for b, other, y in t if (other - day).days == 1 and set(x) & set(y)]
        most = max((-h for h, _ in met), default=0)
        want |= {(a, b, -h) for h, b in sorted(m for m in met if -m[0] >= 2 or -m[0] >= 0.75 * most)[:3]}
    assert got == want and len(got) > 100


def test_kept_boxes(spark):
    rows = [(k % 7, f"b{k}", float(k * 13 % 40), float(k * 7 % 30), 20.0 + k % 3, float(k * 5 % 11)) for k in range(60)] + [(None, "n", 0.0, 0.0, 20.0, 1.0), (1, "m", 0.0, 0.0, 20.0, None), (0, "b0", 0.0, 0.0, 20.0, 0.0)]
    want = {"n", "m"}
    for image in range(7):
        kept = []
        for _, b, x, y, s, score in sorted((r for r in rows if r[0] == image and r[5] is not None), key=lambda r: (-r[5], r[1])):
            both = [max(0, min(x + s, u + v) - max(x, u)) * max(0, min(y + s, w + v) - max(y, w)) for u, w, v in kept]
            if all(a / (s * s + v * v - a) <= 0.3 for a, (_, _, v) in zip(both, kept)):
                kept.append((x, y, s))
                want.add(b)
    got = [r.id for r in E.kept_boxes(spark.createDataFrame(rows, "image int, id string, x double, y double, s double, score double")).collect()]
    assert sorted(got) == sorted(want) and len(got) < 60


def test_groups_of_a_day_are_components(spark, tmp_path):
    from tagloom.plans.stories import draft_evidence

    o = [(i, i % 10, f"2024-01-0{1 + i % 3}", "HIGH" if i % 2 else "LOW") for i in range(1, 40)] + [(90, 3, "2024-02-01", None), (91, 3, "2024-02-01", None), (92, 24, "2024-02-01", "LOW")]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, d string, o_orderpriority string").selectExpr("*", "CAST(d AS timestamp_ntz) AS o_orderdate", "1.0D AS o_totalprice", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    groups = {}
    for i, c, d, p in o:
        groups.setdefault((c % 25, d, p), []).append(i)
    want = {}
    for (m, _, p), g in groups.items():
        n, similar, parts = want.get(m, (0, 0, 0))
        several = p is not None and len(g) > 1
        want[m] = (n + len(g), similar + several * len(g), parts + several)
    assert {r.media: (r.articles, r.similar, r.components) for r in draft_evidence(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("text,want", [
    ("<rss><channel><item><title>A</title><link>u</link><pubDate>t</pubDate></item><item><title>B</title></item></channel></rss>", ("rss", "u", "A", "t")),
    ('<RDF><item about="u"><title/><date>t</date></item></RDF>', ("rdf", "u", None, "t")),
    ('<feed><entry><link href="u"/><title>A <b>b</b></title></entry></feed>', ("atom", "u", "A b", None)),
    ("<urlset><url><loc>u</loc><lastmod>t</lastmod></url></urlset>", ("sitemap", "u", None, "t")), ("<x/>", (None,) * 4), (None, (None,) * 4),
])
def test_feed_entries(spark, text, want):
    from tagloom.plans.extraction import feed_entry

    assert tuple(spark.createDataFrame([(text,)], "x string").select(feed_entry("x").alias("e")).first().e) == want
