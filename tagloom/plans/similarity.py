"""Queries of near-duplicate texts, from sketches to the pairs of an incremental index. Hashes have no SQL form; these are tested by brute force."""

from pyspark.sql import functions as F

from tagloom.catalog import query
from tagloom.functions import text as X
from tagloom.operators import graphs as G
from tagloom.operators import similarity as N
from tagloom.plans.graphs import PAIRS_SQL, pairs
from tagloom.sources.sinks import scratch
from tagloom.sources.tables import texts
from tagloom.streaming import near_index as I


def bodies(spark, sf_dir):
    """id, at, t (normalised, at least 200 characters) and body of the eligible texts."""
    t = texts(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("published_at").alias("at"), X.normalised(F.col("body")).alias("t"), "body")
    return t.where(F.length("t") >= 200)


def sketched(spark, sf_dir):
    b = bodies(spark, sf_dir)
    return N.sketches(b).join(b.select("id", "at"), "id")


@query("x04_shingle_hashes")
def shingle_hashes(spark, sf_dir):
    """How many distinct shingle hashes each text has."""
    return N.sketches(bodies(spark, sf_dir), 1).select("id", "shingles")


@query("x05_minhash")
def minhash(spark, sf_dir):
    return N.sketches(bodies(spark, sf_dir))


@query("x06_band_keys")
def band_keys(spark, sf_dir):
    return N.band_keys(N.sketches(bodies(spark, sf_dir))).select("id", "band", "key")


@query("j12_band_candidates")
def band_candidates(spark, sf_dir):
    """Candidate pairs of the bands within seven days, whatever their estimate."""
    return N.candidates(sketched(spark, sf_dir), least=0.0).select("a", "b")


@query("x07_jaccard_estimate")
def jaccard_estimate(spark, sf_dir):
    """Candidate pairs within seven days whose estimated similarity is at least 0.2."""
    return N.candidates(sketched(spark, sf_dir))


def near(spark, sf_dir):
    """The near-duplicate pairs: at least 100 shared shingles and a Dice of 0.5."""
    b = bodies(spark, sf_dir).select("id", N.seconds("at").alias("sec"), "t")
    sizes = texts(spark, sf_dir).select(N.seconds("published_at").alias("sec"), F.length("body").alias("size"))  # of all texts as they are, which costs less than to normalise them twice
    return N.near_pairs(N.sketched_texts(b), sizes)


@query("x08_exact_dice")
def exact_dice(spark, sf_dir):
    """Exact Dice and containment of the near-duplicate pairs."""
    return near(spark, sf_dir).drop("kind")


@query("x09_shared_passage")
def shared_passage(spark, sf_dir):
    return N.evidence(near(spark, sf_dir), bodies(spark, sf_dir))


@query("x10_pair_kind")
def pair_kind(spark, sf_dir):
    return near(spark, sf_dir).select("a", "b", "kind")


@query("x11_incremental_index")
def incremental_index(spark, sf_dir):
    """The texts that no earlier run indexed (two in three are) against all within seven days."""
    b = bodies(spark, sf_dir)
    return N.index_batch(b, b.where("id % 3 <> 0").select("id"))


@query("r16_index_marker")
def index_marker(spark, sf_dir):
    """What the next run takes: texts without the marker, the newest first, in batches of 2,000."""
    b = bodies(spark, sf_dir).where("id % 3 = 0").select("id", "at")
    newest = b.orderBy(F.desc("at"), F.desc("id")).limit(10_000)
    return newest.select("id", "at", F.lit(True).alias("taken"))


def stored_index(spark, sf_dir):
    """An index to which three batches of the texts have been appended, the newest texts first."""
    b = bodies(spark, sf_dir)
    latest = F.lit(b.agg(F.max("at").cast("string")).first()[0]).cast("timestamp_ntz")
    dealt = b.withColumn("batch", F.least(F.timestamp_diff("WEEK", F.col("at"), latest), F.lit(2))).select("id", "at", "t", "batch")
    index = I.NearIndex(spark, f"{scratch(spark)}/near")
    for n in range(3):
        index.append(dealt.where(F.col("batch") == n), n)
    return index


@query("r16_stored_index")
def stored_pairs(spark, sf_dir):
    """The near-duplicate pairs of representatives that three batches have found, each against what was there."""
    return stored_index(spark, sf_dir).pairs()


@query("x11_stored_members")
def stored_members(spark, sf_dir):
    """Which text of its week stands for each indexed text."""
    return stored_index(spark, sf_dir).members()


@query("x13_connection_direction", f"WITH {PAIRS_SQL}, d AS (SELECT a, b, CASE WHEN a % 5 = b % 5 THEN 'attributed' WHEN a % 3 = b % 3 THEN 'same-byline' ELSE 'unattributed' END AS kind, CASE WHEN (a + b) % 11 = 0 THEN 'unknown' WHEN abs(epoch(tb) - epoch(ta)) < 60 THEN 'same' WHEN tb > ta THEN 'first' ELSE 'second' END AS o FROM p) SELECT a, b, kind, CASE WHEN kind = 'attributed' THEN 'b-to-a' WHEN o = 'first' THEN 'a-to-b' WHEN o = 'second' THEN 'b-to-a' ELSE 'none' END AS direction FROM d")
def connection_direction(spark, sf_dir):
    kind = G.relation_kind(F.col("a") % 5 == F.col("b") % 5, F.col("a") % 3 == F.col("b") % 3)
    order = G.publication_order(F.col("ta"), F.col("tb"), (F.col("a") + F.col("b")) % 11 == 0)
    return pairs(spark, sf_dir).select("a", "b", kind.alias("kind"), N.direction(kind, order).alias("direction"))
