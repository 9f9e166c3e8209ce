"""Literal fixtures for the operators, and registered queries against DuckDB."""

import hashlib
import math
import random
import unicodedata
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagloom import catalog
from tagloom.functions import text as X
from tagloom.operators import coverage as C
from tagloom.operators import graphs as G
from tagloom.operators import ranking as R
from tagloom.operators import search as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "a01_tag_ranking a04_burst a05_basis_reprojection a06_window_pool a07_pool_manifest w09_rank_trails s18_upsert_merge f07_media_set_algebra j10_either_end j11_time_band_join "
    "t04_keyset_page u05_snapshot_changes w04_moving_average w05_moving_score a19_distinctive_terms a22_tag_history a27_vocabulary_tiers r01_sliding_ranking a14_facets a15_camp_coverage "
    "a54_whole_percentages a59_race_rounds w11_diverse_picks k01_split_legacy_tags k08_url_key k09_strip_tracking k11_trackers x16_title_dice s10_published_time_cascade g19_tree_descendants y26_series_runs "
    "c04_json_search c05_json_extract k03_normalise_tag k20_text_date k34_nested_history g06_hubs g07_bridge_cut g13_stories g14_folded_reports r08_thread_state r09_thread_links w15_period_picks x20_comparison_pair "
    "x24_longest_terms x14_attributions s06_feed_formats s17_snapshot_upsert s20_replaced_range y15_robots_rules q01_ranking q03_article_search q07_events q10_media_page q13_related_article q16_tag_groups"
).split()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_decay_sums_by_outlet(spark):
    a = spark.createDataFrame([("x", 1)] * 3 + [("x", 2), ("y", 1)], "tag string, media int")
    assert rows(R.rank_tags(a)) == [("x", 2.75, 4, 2, 1), ("y", 1.0, 1, 1, 2)]


def test_burst_unknown_is_not_zero(spark):
    charts = [(0, "x", 10.0, 1, 1, 1, False)] + [(h, "z", 4.0, 1, 1, 1, h == 3) for h in (3, 6, 12, 24)]
    schema = "lag int, tag string, norm double, count long, rank long, weight long, full boolean"
    assert rows(R.burst(spark.createDataFrame(charts, schema))) == [("x", 10.0, None)]
    charts.append((48, "z", 4.0, 1, 1, 1, False))
    got = rows(R.burst(spark.createDataFrame(charts, schema)))[0]
    assert got[2] == pytest.approx(10 + 0.92 * 6 + 10 * (0.84 + 0.7 + 0.5 + 0.25))


def test_gates(spark):
    n = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 3), ("b", 2, 2), ("b", 3, 1), ("c", 1, 9)], "tag string, media int, n int")
    assert rows(n.groupBy("tag").agg(R.early_gate(), R.broad_gate())) == [("a", True, False), ("b", True, True), ("c", False, False)]


def test_changes(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int"), spark.createDataFrame([("a", 1), ("b", 3), ("d", None)], "k string, v int")
    assert rows(S.changes(old, new, "k", "v")) == [("b", "upsert", 3), ("c", "absent", None), ("d", "upsert", None)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = dict(rows(G.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))


def test_minhash_bands_find_exact_pairs(spark):
    """All pairs with Dice of at least 0.8 are among the candidates."""
    base = [f"s{i}" for i in range(150)]
    sets = [(0, base)] + [(i, base[i * 3 :] + [f"n{i}{k}" for k in range(i * 3)]) for i in range(1, 12)] + [(50 + i, [f"o{i}{k}" for k in range(150)]) for i in range(10)]
    frame = spark.createDataFrame(sets, "id long, members array<string>")
    exact = {r[:2] for r in rows(G.dice_pairs(frame, 100, 0.8))}
    assert exact and exact <= set(rows(G.band_pairs(G.minhash(frame))))


def test_whole_percentages(spark):
    got = rows(C.whole_percentages(spark.createDataFrame([("g", x, 1) for x in "abc"], "g string, name string, n long"), "g", "name", "n"))
    assert [r[-1] for r in got] == [34, 33, 33]


def test_text_functions(spark):
    one = spark.createDataFrame([("https://www.Example.com:443/a/b.html?utm_source=x&id=7&ref=y#top", "[ab][c][][de]", "<p>a <b>b</b></p>", "Word", "/2024/02/30/x", "/n20240229.html")], "url string, tags string, html string, w string, bad string, good string")
    got = one.select(X.url_key(F.col("url")), X.split_legacy_tags(F.col("tags")), X.strip_tags(F.col("html")), X.shingles(F.col("w"), 2), X.url_date(F.col("bad")), X.url_date(F.col("good")).cast("string"), X.between(F.col("html"), "<b>", "</b>")).first()
    assert tuple(got) == ("www.example.com/a/b.html?id=7&ref=y", ["ab", "de"], "a b", ["Wo", "or", "rd"], None, "2024-02-29", "b")


def test_urls(spark):
    keys = {
        "http://Host.TW:80/a/b/?UTM_Source=x&_ga=1&from=home&spm=2#z": "host.tw/a/b?from=home", "https://m.host.tw/a.html": "m.host.tw/a.html", "https://h.tw:8080//": "h.tw:8080", "https://h.tw?rec=1": "h.tw",
        "https://h.tw/d.php?sn=1&&mc_cid=2&refx=3": "h.tw/d.php?sn=1&refx=3", "https://h.tw/" + "x" * 600: "h.tw/" + "x" * 507,
    }
    frame = spark.createDataFrame([(u, k) for u, k in keys.items()], "u string, k string")
    assert [r[0] for r in frame.where(X.url_key(F.col("u")) != F.col("k")).select(X.url_key(F.col("u"))).collect()] == []
    ids = spark.createDataFrame([("https://H.tw:81/news/123456?x=1",), ("https://h.tw/about",)], "u string").select(X.url_key(F.col("u"), r"/news/(\d+)").alias("k"))
    assert [r.k for r in ids.collect()] == ["h.tw#123456", "h.tw/about"]
    base = "https://h.tw/a/b/c.html?x=1#y"
    links = ["", "d", "./d", "../d", "../../../d", "/d?e", "//o.tw/d", "?q", "#z", "http://o.tw/a/../b/./c", "mailto:x", "..", "e/../f#g", " d "]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(links)], "i int, h string").select("i", X.absolute(F.col("h"), F.lit(base)).alias("u")).orderBy("i").collect()
    want = [urljoin(base, h.strip()) for h in links]
    want[0] = "https://h.tw/a/b/c.html?x=1"
    want[8] = "https://h.tw/a/b/c.html?x=1#z"
    want[9] = "http://o.tw/b/c"
    assert [r.u for r in got] == want


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = catalog.queries()[name](spark, SF)
    order = sorted(frame.columns)
    sql = con.execute(catalog.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(sql.description)}
    assert sorted(at) == order
    flat = lambda r: tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r)
    assert sorted(flat(r) for r in frame.select(*order).collect()) == sorted(flat([r[at[c]] for c in order]) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_medoids_of_all_vectors(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) + (i % 3) for _ in range(4)], i % 3) for i in range(180, 420)] + [(900, [0.0] * 4, 0), (901, None, 0), (902, [1.0] * 4, None), (903, [1.0] * 4, 7)]
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    want = []
    for label in (0, 1, 2):
        own = [(i, v) for i, v, k in vectors if k == label and v and any(v)]
        votes = {i: sum(i != j and cosine(v, w) >= 0.2 for j, w in own) for i, v in own}
        best = min(votes, key=lambda i: (-votes[i], i))
        want.append((label, best, votes[best]))
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    for size in (7, 1000):
        assert rows(G.medoids(frame, 0.2, size)) == want


def test_whole_tables(spark):
    """The queries without SQL against brute force, the others against their SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    links = con.execute("SELECT DISTINCT l_partkey, l_partkey * 7 + l_suppkey FROM lineitem").fetchall()
    least = {x: x for a, b in links if a != b for x in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert rows(catalog.queries()["g12_components_whole"](spark, SF)) == rows(catalog.queries()["g12_components"](spark, SF)) == sorted(least.items(), key=repr)
    got = rows(catalog.queries()["j17_thread_merge_links_whole"](spark, SF).select("a_user", "b_user", "section"))
    found = con.execute(f"SELECT a_user, b_user, section FROM ({catalog.oracle_sql()['j17_thread_merge_links_whole']})").fetchall()
    assert got == sorted(found, key=repr)
    vectors = con.execute("SELECT vec_id, label, embedding FROM embeddings").fetchall()
    best = {}
    for i, label, v in vectors:
        unit = lambda x: [a / math.sqrt(sum(b * b for b in x)) for a in x]
        best.setdefault(label, []).append((i, unit(v)))
    want = []
    for label, own in best.items():
        votes = {i: sum(i != j and sum(a * b for a, b in zip(v, w)) >= 0.2 for j, w in own) for i, v in own}
        if max(votes.values()):
            top = min(votes, key=lambda i: (-votes[i], i))
            want.append((label, top, votes[top]))
    assert rows(catalog.queries()["y02_medoid_whole"](spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", "r21_pending_queue t08_byte_order y11_identity_review t02_nulls_last s06_feed_items a45_reading_report".split())
def test_whole_against_sql(spark, name):
    test_against_sql(spark, f"{name}_whole")
    # both names stand for all rows
    assert rows(catalog.queries()[name](spark, SF)) == rows(catalog.queries()[f"{name}_whole"](spark, SF))


def test_whole_lines_and_texts(spark):
    con = duckdb.connect()
    near = lambda got, want: len(got) == len(want) and all(a[:2] == b[:2] and all(x == pytest.approx(y, abs=2e-6) for x, y in zip(a[2:], b[2:])) for a, b in zip(sorted(got), sorted(want)))
    lines = con.execute(f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM '{SF}/lineitem.parquet'").fetchall()
    clamp = lambda x: max(0.0, min(1.0, x))
    q = lambda name, *c: [tuple(r) for r in catalog.queries()[name](spark, SF).select(*c).collect()]
    want = [(o, n, (0.5 * clamp(k / 40) + 0.3 * clamp(d * 12) + 0.2 * clamp(t * 10 - 0.1)) * (0.5 if f == "R" else 1)) for o, n, k, _, d, t, f in lines]
    assert near(q("y03_clamped_score_whole", "l_orderkey", "l_linenumber", "score"), want)
    want = [(o, n, p * (1 - d), round(d * 1e6)) for o, n, _, p, d, _, _ in lines]
    assert near(q("k29_round_and_micro_whole", "l_orderkey", "l_linenumber", "price", "micro"), want)
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    plain = {i: "".join(c for c in t if unicodedata.category(c)[0] in "LN").lower() for i, t in docs if t is not None}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in plain.items()}
    assert dict(q("x01_body_normalisation_whole", "doc_id", "digest")) == {i: hashlib.sha256(plain[i].encode()).hexdigest() if i in plain else None for i, _ in docs}
    assert {i: n for i, n in q("x02_shingle_counts_whole", "doc_id", "shingles") if i in sets} == {i: len(x) for i, x in sets.items()}
    assert sorted(i for i, in q("x03_eligibility_whole", "doc_id")) == sorted(i for i, t in plain.items() if len(t) >= 200 and len(sets[i]) >= 100)
