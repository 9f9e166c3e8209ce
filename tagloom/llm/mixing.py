"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with token share p gets the weight ``p^a / sum(p^a)``. The exponent a between 0 (all sources
alike) and 1 (as they are) is bisected: the largest whose entropy reaches the target, but no smaller
than the smallest that repeats no source more than the limit. A source's budget of tokens is then
realised by permutations: it is read whole as often as the budget allows, each time in another order
of its blocks and of the documents in each, and a last time up to the rest of the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import Stash

#: Steps of bisection at once in one pass over the source table, and passes.
STEPS, PASSES = 4, 8
#: A plan with so few sources is broadcast; a larger one is joined by key.
SMALL_PLAN = 10_000


def _order(*parts: Column | str) -> Column:
    """A pseudo-random order: the MD5 of the parts."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _bisect(shares: DataFrame, holds: Column, low_holds: bool) -> float:
    """The border in [0, 1] of ``holds`` over the exponent, on the side where it holds.

    ``holds`` is a condition on h (entropy in bits) and r (largest repetition for budget factor f).
    """
    low, width = 0, 1 << (STEPS * PASSES)
    for _ in range(PASSES):
        step = width >> STEPS
        points = [(low + i * step) / (1 << (STEPS * PASSES)) for i in range(1, 1 << STEPS)]
        tried = shares.withColumn("a", F.explode(F.array(*[F.lit(x) for x in points]))).withColumn("w", F.pow("p", "a"))
        sums = tried.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log2("w")).alias("l"), F.max(F.col("w") / F.col("p")).alias("m"))
        good = {r["a"] for r in sums.select("a", (F.log2("z") - F.col("l") / F.col("z")).alias("h"), (F.col("m") / F.col("z")).alias("r")).where(holds).select("a").collect()}
        number = sum(x in good for x in points) if low_holds else sum(x not in good for x in points)
        low += number * step
        width = step
    return (low if low_holds else low + width) / (1 << (STEPS * PASSES))


def exponent_for(shares: DataFrame, budget_factor: float, entropy_share: float | None, max_repeats: float | None) -> float:
    """The exponent for source shares p, rounded to 6 digits."""
    n = shares.count()
    a = 1.0
    if n > 1 and entropy_share is not None:
        a = _bisect(shares, F.col("h") >= entropy_share * math.log2(n) - 1e-9, True)
    if n > 1 and max_repeats is not None:
        a = max(a, _bisect(shares, F.col("r") * budget_factor <= max_repeats + 1e-9, False))
    return round(a, 6)


def mix_sources(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget_factor: float = 1.0, block_docs: int = 1024, seed: str = "mix") -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block and place for each appearance of a document.

    The budget is ``budget_factor`` times the tokens (words) of ``docs`` (doc_id, text, source), dealt to
    the sources in whole tokens by largest remainders; only the column weight is rounded (9 digits).
    ``entropy_share`` is the target entropy as a share of the largest; None leaves it out, as it does
    ``max_repeats``. epoch counts from 0; place orders the appearances: epoch, then permuted blocks,
    then permuted documents. A null source is a source of its own. Documents without tokens appear
    with their block; sources without tokens have weight 0 and don't appear. No appearance exceeds the
    budget: in the last epoch whole blocks are taken as long as they fit, then documents of the next
    block. Repeated rows appear each for itself; null doc_ids are allowed; more columns are ignored.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = stash.put(docs.select("doc_id", "source", name.alias("s"), tokens.alias("n_tokens")), "tokens")
    sources = stash.put(slim.groupBy("s").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("docs")), "sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = sources.where("t > 0").select("s", "t", "docs", (F.col("t") / F.lit(float(total or 1))).alias("p"))
    a = exponent_for(shares, budget_factor, entropy_share, max_repeats) if total else 1.0
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    budget = math.floor(total * budget_factor + 0.5)
    exact = F.pow("p", F.lit(a)) / z * budget
    dealt = stash.put(shares.select("s", "t", "docs", F.round(F.pow("p", F.lit(a)) / z, 9).alias("weight"), F.floor(exact + 1e-6).cast("long").alias("base"), exact.alias("exact")), "budgets")
    # the tokens that rounding down leaves go to the largest remainders
    left = max(0, budget - (dealt.agg(F.sum("base")).first()[0] or 0))
    more = dealt.select("s", F.lit(1).alias("more"), F.round(F.col("exact") - F.col("base"), 6).alias("part")).orderBy(F.desc("part"), "s").limit(left).select("s", "more")
    dealt = dealt.join(more, "s", "left").withColumn("budget", F.col("base") + F.coalesce("more", F.lit(0)))
    plan = dealt.select("s", "weight", "budget", "t", F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks"))
    plan = stash.put(plan.select("s", "weight", "blocks", F.expr("budget div t").alias("whole"), F.expr("budget % t").alias("rest")), "plan")
    if plan.count() <= SMALL_PLAN:
        plan = F.broadcast(plan)
    number = F.conv(F.substring(_order(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    placed = slim.join(plan, "s").withColumn("block", F.pmod(number, F.col("blocks")))
    blocks = placed.groupBy("s", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    upto = F.sum("in_block").over(Window.partitionBy("s").orderBy(_order(seed, F.col("whole"), F.col("s"), F.col("block"))))
    blocks = blocks.select("s", "block", (F.col("rest") - (upto - F.col("in_block"))).alias("left"))
    order = _order(seed, F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    within = F.sum("n_tokens").over(Window.partitionBy("s", "block").orderBy(order))
    told = placed.join(blocks, ["s", "block"]).withColumn("copies", F.col("whole") + (within <= F.col("left")).cast("long"))
    out = told.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    place = F.concat_ws("-", F.lpad(F.col("epoch").cast("string"), 6, "0"), F.substring(_order(seed, F.col("epoch"), F.col("s"), F.col("block")), 1, 12), F.substring(_order(seed, F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12))
    return out.select("doc_id", "source", "n_tokens", "weight", F.col("epoch").cast("long").alias("epoch"), "block", place.alias("place"))


#: The same for DuckDB, with the default parameters.
MIX_SQL = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
sources AS (SELECT s, sum(n_tokens)::BIGINT AS t, count(*) AS docs FROM slim GROUP BY s),
tot AS (SELECT sum(t)::BIGINT AS total FROM sources),
shares AS (SELECT s, t, docs, t / total::DOUBLE AS p FROM sources, tot WHERE t > 0),
list_p AS (SELECT list(p) AS ps, count(*) AS n FROM shares),
ent(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      log2(list_sum(list_transform(ps, lambda x: power(x, (lo + hi) / 2))))
      - list_sum(list_transform(ps, lambda x: power(x, (lo + hi) / 2) * log2(power(x, (lo + hi) / 2)))) / list_sum(list_transform(ps, lambda x: power(x, (lo + hi) / 2)))
      >= 0.95 * log2(n) - 1e-9 AS ok
    FROM ent, list_p WHERE i < 32)),
rep(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      list_max(list_transform(ps, lambda x: power(x, (lo + hi) / 2) / x)) / list_sum(list_transform(ps, lambda x: power(x, (lo + hi) / 2))) <= 4.0 + 1e-9 AS ok
    FROM rep, list_p WHERE i < 32)),
expo AS (SELECT CASE WHEN (SELECT n FROM list_p) > 1 THEN round(greatest((SELECT lo FROM ent WHERE i = 32), (SELECT hi FROM rep WHERE i = 32)), 6) ELSE 1.0 END AS a),
z AS (SELECT sum(power(p, a)) AS z FROM shares, expo),
weights AS (SELECT s, t, docs, total, round(power(p, a) / z, 9) AS weight, power(p, a) / z * total AS exact, floor(power(p, a) / z * total + 1e-6)::BIGINT AS base FROM shares, expo, z, tot),
dealt AS (SELECT *, base + (row_number() OVER (ORDER BY round(exact - base, 6) DESC, s) <= total - sum(base) OVER ())::BIGINT AS budget FROM weights),
plan AS (SELECT s, weight, ceil(docs / 1024.0)::BIGINT AS blocks, budget // t AS whole, budget % t AS rest FROM dealt),
placed AS (SELECT slim.*, weight, whole, rest, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block FROM slim JOIN plan USING (s)),
b AS (SELECT s, block, sum(n_tokens)::BIGINT AS in_block, any_value(whole) AS whole, any_value(rest) AS rest FROM placed GROUP BY s, block),
c AS (SELECT s, block, rest - (sum(in_block) OVER (PARTITION BY s ORDER BY md5('mix|' || whole || '|' || s || '|' || block)) - in_block) AS l FROM b),
told AS (SELECT placed.*, whole + (sum(n_tokens) OVER (PARTITION BY placed.s, placed.block ORDER BY md5('mix|' || whole || '|' || coalesce(doc_id::VARCHAR, ''))) <= l)::BIGINT AS copies
         FROM placed JOIN c ON placed.s = c.s AND placed.block = c.block),
appear AS (SELECT *, unnest(range(copies::BIGINT)) AS epoch FROM told WHERE copies > 0)
SELECT doc_id, source, n_tokens, weight, epoch, block,
  lpad(epoch::VARCHAR, 6, '0') || '-' || substr(md5('mix|' || epoch || '|' || s || '|' || block), 1, 12) || '-' || substr(md5('mix|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12) AS place
FROM appear"""
