"""Queries of tag graphs, components, trees, threads and near-duplicate pairs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.functions import text as X
from tagloom.operators import graphs as G
from tagloom.operators import search as S
from tagloom.operators import windows as V
from tagloom.sources.tables import ARTICLES_SQL, BASKETS_SQL, STREAM_SQL, articles, baskets, stream, table

A, B, ST = (f"WITH {x}" for x in (ARTICLES_SQL, BASKETS_SQL, STREAM_SQL))
GRAPH_SQL = f"{BASKETS_SQL}, w AS (SELECT * FROM baskets WHERE published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-01-11'), n AS (SELECT tag, count(*) AS n FROM w GROUP BY tag), g AS (SELECT x.tag AS a, y.tag AS b, count(*) AS shared FROM w x JOIN w y ON x.article_id = y.article_id AND x.tag <> y.tag GROUP BY ALL), graph AS (SELECT g.*, na.n AS na, nb.n AS nb FROM g JOIN n na ON na.tag = a JOIN n nb ON nb.tag = b)"


def graph(spark, sf_dir):
    return G.tag_graph(baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-01", "1998-01-11")))


@query("g01_tag_graph", f"WITH {GRAPH_SQL} SELECT * FROM graph")
def tag_graph(spark, sf_dir):
    return graph(spark, sf_dir)


@query("g02_relations", f"WITH {GRAPH_SQL} SELECT a, b, shared FROM graph WHERE shared > 1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 100")
def relations(spark, sf_dir):
    return S.capped(graph(spark, sf_dir).where("shared > 1"), ["a"], [F.desc("shared"), F.col("b")], 100).select("a", "b", "shared")


@query("g03_equal_edges", f"WITH {GRAPH_SQL} SELECT a, b FROM graph WHERE shared > 0.25 * na")
def equal_edges(spark, sf_dir):
    return G.equal_edges(graph(spark, sf_dir), 0.25)


@query("g04_equal_closure", f"WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT a, b FROM graph WHERE shared > 0.3 * na), t(root, node, depth) AS (SELECT a, a, 0 FROM e UNION SELECT root, b, depth + 1 FROM t JOIN e ON e.a = t.node WHERE depth < 4) SELECT root, node, min(depth)::INT AS depth FROM t GROUP BY ALL")
def equal_closure(spark, sf_dir):
    """What the directed edges reach in four steps, by repeated joins of the newly reached."""
    e = G.equal_edges(graph(spark, sf_dir), 0.3)
    seen = front = e.select(F.col("a").alias("root"), F.col("a").alias("node"), F.lit(0).alias("depth")).distinct()
    for depth in range(1, 5):
        fresh = front.join(e, front["node"] == e["a"]).select("root", F.col("b").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = fresh.withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


@query("g08_story_groups", f"WITH RECURSIVE {GRAPH_SQL}, u AS (SELECT a, b FROM graph WHERE shared >= 0.34 * least(na, nb)), t(id, node) AS (SELECT a, a FROM u UNION SELECT id, b FROM t JOIN u ON u.a = t.node) SELECT id, min(node) AS component FROM t GROUP BY id")
def story_groups(spark, sf_dir):
    return G.components(G.together_edges(graph(spark, sf_dir), 0.34))


@query("g12_components")
@query("g12_components_whole")
def story_components_whole(spark, sf_dir):
    """The components of the links of all rows; without SQL, as a recursive closure of one large component grows with its square."""
    return _link_components(table(spark, sf_dir, "lineitem"))


def _link_components(rows):
    return G.components(rows.select(F.col("l_partkey").alias("a"), (F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("b")).where("a <> b"))


@query("g16_strongest_edges", f"WITH {GRAPH_SQL}, u AS (SELECT a, b, shared FROM graph WHERE a < b), ends AS (SELECT a AS node, * FROM u UNION ALL SELECT b, * FROM u) SELECT DISTINCT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY shared DESC, a, b) AS p FROM ends) WHERE p <= 2")
def strongest_edges(spark, sf_dir):
    return G.strongest_edges(graph(spark, sf_dir).where("a < b"), 2)


@query("g17_connected_nodes", f"WITH {GRAPH_SQL}, u AS (SELECT a, b FROM graph WHERE shared >= 4) SELECT tag FROM n WHERE tag IN (SELECT a FROM u UNION SELECT b FROM u)")
def connected_nodes(spark, sf_dir):
    g = graph(spark, sf_dir).where("shared >= 4").select(F.explode(F.array("a", "b")).alias("tag"))
    tags = baskets(spark, sf_dir).where(S.half_open(F.col("published_at"), "1998-01-01", "1998-01-11")).select("tag").distinct()
    return tags.join(g, "tag", "left_semi")


TREE_SQL = "tree(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def tree(spark, sf_dir):
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = n.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")).union(r.select(key("r", "r_regionkey"), F.lit("world"))).union(c.select(key("c", "c_custkey"), key("n", "c_nationkey")))
    edges.createOrReplaceTempView("tagloom_tree")
    return edges


@query("g19_tree_descendants", f"WITH RECURSIVE {TREE_SQL}, t(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, child, depth + 1 FROM t JOIN tree ON parent = node WHERE depth < 8) SELECT root, node, depth FROM t")
def tree_descendants(spark, sf_dir):
    tree(spark, sf_dir).where("parent = 'world'").select(F.col("child").alias("root")).createOrReplaceTempView("tagloom_roots")
    return G.descendants(spark, "tagloom_tree", "tagloom_roots")


@query("g20_ancestor_closure", f"WITH RECURSIVE {TREE_SQL}, t(node, ancestor, depth) AS (SELECT child, parent, 1 FROM tree UNION ALL SELECT node, parent, depth + 1 FROM t JOIN tree ON child = ancestor WHERE depth < 8) SELECT node, ancestor, min(depth) AS depth FROM t GROUP BY ALL")
def ancestor_closure(spark, sf_dir):
    return G.ancestors(tree(spark, sf_dir))


@query("g21_cycle_check", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 60 AS a, (l_suppkey * 3 + 1) % 60 AS b FROM lineitem), t(root, node, depth) AS (SELECT a, b, 1 FROM e UNION SELECT root, b, depth + 1 FROM t JOIN e ON a = node WHERE depth < 8) SELECT a AS node, coalesce(bool_or(t.node = a), FALSE) AS cyclic FROM (SELECT DISTINCT a FROM e) LEFT JOIN t ON root = a GROUP BY a")
def cycle_check(spark, sf_dir):
    """Whether a node reaches itself in eight steps."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 60).alias("a"), ((F.col("l_suppkey") * 3 + 1) % 60).alias("b")).distinct()
    reach = e.select(F.col("a").alias("root"), F.col("b").alias("node"))
    front = reach
    for _ in range(7):
        front = front.join(e, front["node"] == e["a"]).select("root", F.col("b").alias("node")).distinct()
        reach = reach.union(front)
    return reach.groupBy(F.col("root").alias("node")).agg(F.bool_or(F.col("node") == F.col("root")).alias("cyclic"))


@query("g22_inherited_role", f"WITH RECURSIVE {TREE_SQL}, t(node, up, depth) AS (SELECT child, child, 0 FROM tree UNION ALL SELECT node, parent, depth + 1 FROM t JOIN tree ON child = up WHERE depth < 8), roles(id, role) AS (VALUES ('r1', 'west'), ('n3', 'third'), ('r2', 'east')) SELECT node, first(role ORDER BY depth) AS role FROM t JOIN roles ON id = up GROUP BY node")
def inherited_role(spark, sf_dir):
    return G.inherited(tree(spark, sf_dir), spark.createDataFrame([("r1", "west"), ("n3", "third"), ("r2", "east")], "id string, role string"))


@query("a37_group_overview", "WITH g AS (SELECT n_regionkey AS group_id, c_nationkey AS tag, o_orderdate AS t FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), c AS (SELECT group_id, tag, count(*) AS n, count(*) FILTER (t >= TIMESTAMP '2001-01-01') AS recent FROM g GROUP BY ALL) SELECT group_id, tag, n, recent, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, tag) AS place FROM c QUALIFY place <= 5")
def group_overview(spark, sf_dir):
    g = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = g.groupBy(F.col("n_regionkey").alias("group_id"), F.col("c_nationkey").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("recent"))
    return S.capped(c, ["group_id"], [F.desc("n"), F.col("tag")], 5)


PAIRS_SQL = "p AS (SELECT o.o_orderkey AS a, q.o_orderkey AS b, o.o_orderdate AS ta, q.o_orderdate AS tb, o.o_custkey % 25 AS ma, q.o_custkey % 25 AS mb FROM orders o JOIN orders q ON o.o_custkey = q.o_custkey AND o.o_orderkey < q.o_orderkey WHERE o.o_orderdate >= TIMESTAMP '2000-01-01' AND q.o_orderdate >= TIMESTAMP '2000-01-01')"


def pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= "2000-01-01").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.toDF("who", "a", "ta").join(o.toDF("who", "b", "tb"), "who").where("a < b")


@query("x12_relation_classes", f"WITH {PAIRS_SQL} SELECT a, b, CASE WHEN a % 5 = b % 5 THEN 'attributed' WHEN a % 3 = b % 3 THEN 'same-byline' ELSE 'unattributed' END AS kind, CASE WHEN (a + b) % 11 = 0 THEN 'unknown' WHEN abs(epoch(tb) - epoch(ta)) < 60 THEN 'same' WHEN tb > ta THEN 'first' ELSE 'second' END AS a_was FROM p")
def relation_classes(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("a", "b", G.relation_kind(F.col("a") % 5 == F.col("b") % 5, F.col("a") % 3 == F.col("b") % 3).alias("kind"), G.publication_order(F.col("ta"), F.col("tb"), (F.col("a") + F.col("b")) % 11 == 0).alias("a_was"))


@query("a30_relation_graph", f"WITH {PAIRS_SQL} SELECT least(a % 20, b % 20) AS source, greatest(a % 20, b % 20) AS target, count(*) AS pairs, count(DISTINCT a) AS articles, max(date_diff('day', ta, tb)) AS widest FROM p WHERE a % 20 <> b % 20 GROUP BY ALL")
def relation_graph(spark, sf_dir):
    x, y = F.col("a") % 20, F.col("b") % 20
    return pairs(spark, sf_dir).where(x != y).groupBy(F.least(x, y).alias("source"), F.greatest(x, y).alias("target")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("articles"), F.max(F.datediff("tb", "ta")).cast("long").alias("widest"))


@query("a31_daily_relations", f"WITH {PAIRS_SQL}, e AS (SELECT a AS article, ta AS t FROM p UNION SELECT b, tb FROM p) SELECT t::DATE AS day, count(DISTINCT article) AS articles FROM e GROUP BY 1")
def daily_relations(spark, sf_dir):
    ends = F.array(F.struct(F.col("a").alias("article"), F.col("ta").alias("at")), F.struct(F.col("b").alias("article"), F.col("tb").alias("at")))
    return pairs(spark, sf_dir).select(F.explode(ends).alias("e")).groupBy(F.to_date("e.at").alias("day")).agg(F.count_distinct("e.article").alias("articles"))


@query("j16_thread_match", f"{B}, ev AS (SELECT media AS event, tag FROM baskets WHERE published_at >= TIMESTAMP '1998-01-02' AND published_at < TIMESTAMP '1998-01-04' GROUP BY ALL), th AS (SELECT media AS thread, tag, max(published_at) AS last_at FROM baskets WHERE published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-01-02' GROUP BY ALL), lt AS (SELECT thread, max(last_at) AS last_at FROM th GROUP BY thread), m AS (SELECT event, thread, count(*) AS hits FROM ev JOIN th USING (tag) GROUP BY ALL HAVING count(*) >= 2) SELECT event, thread, hits FROM m JOIN lt USING (thread) QUALIFY row_number() OVER (PARTITION BY event ORDER BY hits DESC, last_at DESC, thread) = 1")
def thread_match(spark, sf_dir):
    """Each event's thread: at least two common tags, most hits first, then the most recent, then the older."""
    rows = baskets(spark, sf_dir)
    ev = rows.where(S.half_open(F.col("published_at"), "1998-01-02", "1998-01-04")).select(F.col("media").alias("event"), "tag").distinct()
    th = rows.where(S.half_open(F.col("published_at"), "1998-01-01", "1998-01-02")).groupBy(F.col("media").alias("thread"), "tag").agg(F.max("published_at").alias("at"))
    last = th.groupBy("thread").agg(F.max("at").alias("last_at"))
    m = ev.join(th, "tag").groupBy("event", "thread").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 2").join(last, "thread")
    return S.capped(m, ["event"], [F.desc("hits"), F.desc("last_at"), F.col("thread")], 1).select("event", "thread", "hits")


@query("j17_thread_merge_links", f"{ST}, t AS (SELECT user_id, section, date_trunc('day', published_at) AS day, min(published_at) AS a, max(published_at) AS z FROM stream GROUP BY ALL) SELECT DISTINCT x.user_id AS a_user, y.user_id AS b_user, x.section FROM t x JOIN t y ON x.section = y.section AND x.user_id <> y.user_id AND y.a > x.z AND y.a <= x.z + INTERVAL 20 MINUTE")
def thread_merge_links(spark, sf_dir):
    """Threads of a day that start within twenty minutes after another of their section ended: found and told in blocks of readers."""
    return _merge_links(stream(spark, sf_dir))


@query("j17_thread_merge_links_whole", f"{ST}, t AS (SELECT user_id, section, date_trunc('day', published_at) AS day, min(published_at) AS a, max(published_at) AS z FROM stream GROUP BY ALL) SELECT DISTINCT x.user_id AS a_user, y.user_id AS b_user, x.section FROM t x JOIN t y ON x.section = y.section AND x.user_id <> y.user_id AND y.a > x.z AND y.a <= x.z + INTERVAL 20 MINUTE")
def thread_merge_links_whole(spark, sf_dir):
    """The same over the threads of all readers."""
    return _merge_links(stream(spark, sf_dir))


def _merge_links(rows):
    return V.followers(rows.groupBy("user_id", "section", F.to_date("published_at").alias("day")).agg(F.min("published_at").alias("a"), F.max("published_at").alias("z")))
