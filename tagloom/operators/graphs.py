"""Co-occurrence graphs, components, trees, event clusters and near-duplicate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.sources.sinks import settle


def tag_graph(tags: DataFrame) -> DataFrame:
    """a, b, shared, na, nb for each ordered pair of tags of one article (article_id, tag, distinct)."""
    n = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    pairs = tags.select("article_id", F.col("tag").alias("a")).join(tags.select("article_id", F.col("tag").alias("b")), "article_id").where("a <> b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")


def equal_edges(graph: DataFrame, share: float = 0.5) -> DataFrame:
    """Directed edges a -> b where b is on more than ``share`` of a's articles."""
    return graph.where(F.col("shared") > share * F.col("na")).select("a", "b")


def together_edges(graph: DataFrame, share: float = 0.2) -> DataFrame:
    """Undirected edges where at least ``share`` of the rarer tag's articles have both."""
    return graph.where((F.col("a") < F.col("b")) & (F.col("shared") >= share * F.least("na", "nb"))).select("a", "b")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component: the least id that the undirected edges (a, b) reach.

    Labels spread by minimum and jump along themselves, so the rounds grow with the logarithm of the
    diameter. Each round is written out, so that a lost executor costs no more than the round.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        hop = labels.join(near, "id").select("id", F.least("component", "near").alias("hop"), "component")
        after = hop.select(F.col("id").alias("hop"), F.col("hop").alias("far"))
        step = settle(hop.join(after, "hop", "left").select("id", F.coalesce("far", "hop").alias("new"), "component"))
        labels = step.select("id", F.col("new").alias("component"))
        if step.where("new <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def strongest_edges(edges: DataFrame, k: int, weight: str = "shared") -> DataFrame:
    """The k strongest edges of each node, seen from either end."""
    ends = edges.select("a", "b", weight, F.explode(F.array("a", "b")).alias("node"))
    best = ends.withColumn("p", F.row_number().over(Window.partitionBy("node").orderBy(F.desc(weight), "a", "b"))).where(F.col("p") <= k)
    return best.select("a", "b", weight).distinct()


def descendants(spark, edges: str, roots: str, depth: int = 8) -> DataFrame:
    """root, node, depth of a tree given as views: edges (child, parent), roots (root)."""
    return spark.sql(f"""
        WITH RECURSIVE t(root, node, depth) AS (
          SELECT root, root, 0 FROM {roots}
          UNION ALL
          SELECT t.root, e.child, t.depth + 1 FROM t JOIN {edges} e ON e.parent = t.node WHERE t.depth < {depth})
        SELECT root, node, depth FROM t""")


def ancestors(edges: DataFrame, depth: int = 8) -> DataFrame:
    """node, ancestor, depth (the least) of what the edges (child, parent) reach in ``depth`` steps; rounds of joins, as a recursive query stops at a number of rows."""
    edges = settle(edges.select("child", "parent").where("child is not null"))
    front = found = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    for n in range(2, depth + 1):
        front = settle(front.join(edges, F.col("child") == F.col("ancestor")).select("node", F.col("parent").alias("ancestor"), F.lit(n).alias("depth")).distinct())
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def inherited(edges: DataFrame, roles: DataFrame, depth: int = 8) -> DataFrame:
    """node, role: for each child of the edges (child, parent) its own role (id, role) or that of its next ancestor within ``depth`` steps that has one."""
    edges = settle(edges.select("child", "parent").where("child is not null"))
    front = roles.select(F.col("id").alias("node"), "role", F.lit(0).alias("depth"))
    found = front.join(edges.select(F.col("child").alias("node")), "node", "left_semi")
    for n in range(1, depth + 1):
        front = settle(front.join(edges, F.col("parent") == F.col("node")).select(F.col("child").alias("node"), "role", F.lit(n).alias("depth")).distinct())
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.groupBy("node").agg(F.min_by("role", "depth").alias("role"))


def relation_kind(attributed: Column, same_byline: Column) -> Column:
    """attributed before same byline before neither."""
    return F.when(attributed, "attributed").when(same_byline, "same-byline").otherwise("unattributed")


def publication_order(a: Column, b: Column, pending: Column) -> Column:
    """Which text was first: less than a minute apart counts as the same time; pending dates are unknown."""
    gap = F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))
    return F.when(pending, "unknown").when(F.abs(gap) < 60, "same").when(gap > 0, "first").otherwise("second")


def minhash(sets: DataFrame, permutations: int = 128) -> DataFrame:
    """id, sketch: for each permutation the least hash of the members of a set (id, members)."""
    seeds = F.sequence(F.lit(0), F.lit(permutations - 1))
    sketch = F.transform(seeds, lambda s: F.array_min(F.transform("members", lambda m: F.xxhash64(s, m))))
    return sets.where(F.size("members") > 0).select("id", sketch.alias("sketch"))


def band_pairs(sketches: DataFrame, bands: int = 64, rows: int = 2) -> DataFrame:
    """Candidate pairs a < b that agree in a band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sketch", i * rows + 1, rows)))
    banded = sketches.select("id", F.explode(keys).alias("band"))
    return banded.toDF("a", "band").join(banded.toDF("b", "band"), "band").where("a < b").select("a", "b").distinct()


def dice_pairs(sets: DataFrame, least_shared: int, least_dice: float) -> DataFrame:
    """a, b, shared, dice, containment of sets (id, members) through the members they share, exactly."""
    flat = sets.select("id", F.size("members").alias("n"), F.explode("members").alias("m"))
    x, y = (flat.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), "m") for c in "ab")
    both = x.join(y, "m").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    dice = 2 * F.col("shared") / (F.col("na") + F.col("nb"))
    return both.where((F.col("shared") >= least_shared) & (dice >= least_dice)).select("a", "b", "shared", F.round(dice, 9).alias("dice"), F.round(F.col("shared") / F.least("na", "nb"), 9).alias("containment"))


def _votes(least: float):
    def block(_, frame):
        ids, votes = frame["vec_id"].to_numpy(), {}
        left = np.array(frame["left"].to_pylist(), bool)
        vectors = np.array(frame["embedding"].to_pylist(), float).reshape(len(ids), -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            x, y = np.flatnonzero(left), np.flatnonzero(~left)
            agree = (vectors[x] @ vectors[y].T >= least) & (ids[x][:, None] != ids[y])
        for i, n in zip(ids[x].tolist(), agree.sum(axis=1).tolist()):
            votes[i] = votes.get(i, 0) + n
        return pa.table({"label": pa.array([frame["label"][0].as_py()] * len(votes), frame["label"].type), "vec_id": pa.array(list(votes), frame["vec_id"].type), "n": pa.array(list(votes.values()), pa.int64())})

    return block


def medoids(vectors: DataFrame, least: float, block_rows: int = 1000) -> DataFrame:
    """label, vec_id, votes of the vector (vec_id, embedding, label) of each label with most others of at least the cosine ``least``; none without a vote.

    All pairs of a label are compared, by pairs of blocks of about ``block_rows`` vectors, so that a label takes many tasks.
    Rows with a null id, label, vector or component vote for none; vectors of different lengths don't agree.
    """
    whole = vectors.where("vec_id is not null and label is not null and embedding is not null and not exists(embedding, e -> e is null)")
    whole = whole.select("label", "vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("embedding"), F.size("embedding").alias("size"))
    blocks = whole.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    own = whole.join(blocks, ["label", "size"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["label", "size", "vec_id", "embedding"]
    sides = other.select(*columns, F.lit(True).alias("left"), F.col("own").alias("x"), F.col("other").alias("y")).union(other.select(*columns, F.lit(False), F.col("other"), F.col("own")))
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("label", "vec_id")}
    votes = sides.groupBy("label", "size", "x", "y").applyInArrow(_votes(least), f"label {kinds['label']}, vec_id {kinds['vec_id']}, n long")
    votes = votes.groupBy("label", "vec_id").agg(F.sum("n").alias("votes")).where("votes > 0")
    best = F.max_by(F.struct("vec_id", "votes"), F.struct("votes", -F.col("vec_id"))).alias("best")
    return votes.groupBy("label").agg(best).select("label", "best.vec_id", "best.votes")


def _cosines(least: float):
    def block(_, frame):
        left = np.array(frame["left"].to_pylist(), bool)
        ids = frame["vec_id"].to_numpy()
        vectors = np.array(frame["embedding"].to_pylist(), float).reshape(len(ids), -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            norm = np.sqrt((vectors * vectors).sum(axis=1))
            x, y = np.flatnonzero(left), np.flatnonzero(~left)
            cosine = (vectors[x] @ vectors[y].T) / (norm[x][:, None] * norm[y])
        i, j = np.nonzero((cosine >= least) & (ids[x][:, None] != ids[y]))
        return pa.table({"a": pa.array(ids[x][i], frame["vec_id"].type), "b": pa.array(ids[y][j], frame["vec_id"].type), "cosine": pa.array(cosine[i, j])})

    return block


def cosine_pairs(queries: DataFrame, vectors: DataFrame, least: float, block_rows: int = 2000) -> DataFrame:
    """a, b, cosine of each of ``queries`` with each other of ``vectors`` (vec_id, embedding) of at least the cosine ``least``.

    Both sides are dealt to blocks of about ``block_rows``; a task multiplies one pair of blocks. Rows with
    a null id, vector or component are left out, as are vectors of another length than the query's.
    """
    whole = lambda f: f.where("vec_id is not null and embedding is not null and not exists(embedding, e -> e is null)").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("embedding"), F.size("embedding").alias("size"))
    q, v = whole(queries), whole(vectors)
    x, y = (max(1, -(-f.count() // block_rows)) for f in (q, v))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = q.select("size", "vec_id", "embedding", F.lit(True).alias("left"), own(x).alias("x"), other(y).alias("y")).union(v.select("size", "vec_id", "embedding", F.lit(False), other(x), own(y)))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return sides.groupBy("size", "x", "y").applyInArrow(_cosines(least), f"a {kind}, b {kind}, cosine double")
