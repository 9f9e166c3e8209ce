"""Headlines: similarity through shared bigrams, comparison pairs, diffs, distinctive words and greedy picks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tagloom.functions.text import shingles


def bigram_dice(titles: DataFrame, within: list[str], least: float) -> DataFrame:
    """within, a, b, dice of titles (id, title) with a common bigram in one group; a < b."""
    flat = titles.select(*within, "id", F.explode(shingles(F.col("title"), 2)).alias("g"))
    size = titles.select("id", F.size(shingles(F.col("title"), 2)).alias("n"))
    x, y = flat.withColumnRenamed("id", "a"), flat.withColumnRenamed("id", "b")
    both = x.join(y, [*within, "g"]).where("a < b").groupBy(*within, "a", "b").agg(F.count(F.lit(1)).alias("k"))
    dice = 2 * F.col("k") / (F.col("na") + F.col("nb"))
    return both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select(*within, "a", "b", dice.alias("dice")).where(F.col("dice") >= least)


def _incidence(titles: list[str], at: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """For each title which of the bigrams ``at`` (by default all of the titles') it has, how many it has in all, and the bigrams' places."""
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in titles]
    at = {g: k for k, g in enumerate(sorted(set().union(*sets)))} if at is None else at
    has = np.zeros((len(titles), len(at)), np.float32)
    for row, grams in zip(has, sets):
        row[[at[g] for g in grams if g in at]] = 1
    return has, np.array([len(s) for s in sets], np.float64), at


def _best_pair(rows: pd.DataFrame, seed: str, hours: int, least: float, least_seed: float, block: int = 256) -> tuple | None:
    """(id, title, id, title, score) of an event's best pair of its reports (title, camp, media, hour, id: the least of such reports).

    Titles are compared by blocks, those nearest to the seed first, until no pair of the rest can have a better score; what a pair of
    titles scores is the same for all their reports, so reports are looked at for the best titles only.
    """
    titles = rows["title"].unique().tolist()
    (seed_has,), (seed_n,), grams = _incidence([seed])
    has, n, _ = _incidence(titles, grams)
    near = np.divide(2 * (has @ seed_has).astype(np.float64), n + seed_n, out=np.zeros(len(titles)), where=n > 0)
    keep = (near >= least_seed) & (n > 0)
    to_seed = {t: s for t, s, k in zip(titles, near, keep) if k}
    own = {camp: dict(list(f.sort_values(["hour", "id"], ascending=[False, True]).groupby("title", sort=False))) for camp, f in rows[rows["title"].isin(to_seed)].groupby("camp")}
    blue, green = (sorted(own.get(c, {}), key=lambda t: (-to_seed[t], t)) for c in ("blue", "green"))
    best = None
    for i in range(0, len(blue), block):
        for j in range(0, len(green), block):
            xs, ys = blue[i : i + block], green[j : j + block]
            if best and np.floor((1 + to_seed[xs[0]] + to_seed[ys[0]]) * 1e6 + 0.5) / 1e6 < best[0]:
                break
            x, nx, grams = _incidence(xs)
            y, ny, _ = _incidence(ys, grams)
            dice = 2 * (x @ y.T).astype(np.float64) / (nx[:, None] + ny)
            score = np.floor((dice + np.array([to_seed[t] for t in xs])[:, None] + np.array([to_seed[t] for t in ys])) * 1e6 + 0.5) / 1e6
            at = np.argwhere(dice >= least)
            for a, b in at[np.argsort(-score[at[:, 0], at[:, 1]], kind="stable")]:
                if best and score[a, b] < best[0]:
                    break
                other = own["green"][ys[b]]
                for h, m, p in own["blue"][xs[a]][["hour", "media", "id"]].itertuples(index=False):
                    if best and (score[a, b], h, -p) < best[:3]:
                        break
                    fits = other["id"][(other["media"] != m) & ((other["hour"] - h).abs() <= hours)]
                    if len(fits):
                        found = (score[a, b], h, -p, -fits.min(), xs[a], ys[b])
                        best = max(best, found, key=lambda v: v[:4]) if best else found
                        break
    return best and (-best[2], best[4], -best[3], best[5], best[0])


def compared_headlines(reports: DataFrame, hours: int = 12, least: float = 0.24, least_seed: float = 0.18) -> DataFrame:
    """event, blue, blue_title, green, green_title, score of ``comparison_pairs``.

    An event's distinct reports meet in one task, which holds a block of titles at a time; no table is broadcast and no pair shuffled.
    """
    seed = reports.groupBy("event").agg(F.min_by("title", "id").alias("title")).select("event", "title", F.lit("").alias("camp"), F.lit(None).cast(reports.schema["media"].dataType).alias("media"), F.lit(None).cast(reports.schema["hour"].dataType).alias("hour"), F.lit(None).cast(reports.schema["id"].dataType).alias("id"))
    once = reports.where("camp IN ('blue', 'green') AND title IS NOT NULL AND media IS NOT NULL AND hour IS NOT NULL AND id IS NOT NULL").groupBy("event", "title", "camp", "media", "hour").agg(F.min("id").alias("id"))
    kind = reports.schema["id"].dataType.simpleString()

    def pick(key, frame):
        rows = frame.to_pandas()
        seeds, rows = rows[rows["camp"] == ""]["title"], rows[rows["camp"] != ""].astype({"id": "int64", "media": "int64", "hour": "int64"})
        found = _best_pair(rows, seeds.iloc[0], hours, least, least_seed) if len(rows) and seeds.iloc[0] else None
        columns = [[key[0].as_py()], *([v] for v in found)] if found else [[]] * 6
        types = [pa.string(), frame.schema.field("id").type, pa.string(), frame.schema.field("id").type, pa.string(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["event", "blue", "blue_title", "green", "green_title", "score"])

    return seed.unionByName(once).groupBy("event").applyInArrow(pick, f"event string, blue {kind}, blue_title string, green {kind}, green_title string, score double")


def comparison_pairs(reports: DataFrame, hours: int = 12, least: float = 0.24, least_seed: float = 0.18) -> DataFrame:
    """event, blue, green, score: for each event the pair of reports (id, event, title, media, camp, hour) of two camps that tells of the same.

    The seed is the event's first report; both must resemble it and each other, and be of different
    outlets within ``hours``. score: the pair's similarity plus both to the seed; ties to the later, then the lesser ids.
    """
    return compared_headlines(reports, hours, least, least_seed).select("event", "blue", "green", "score")


def common_characters(left: str, right: str) -> tuple[set[int], set[int]]:
    """Places of a longest common subsequence of characters in both."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    x, y = set(), set()
    while i < n and j < m:
        if left[i] == right[j]:
            x.add(i)
            y.add(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return x, y


def _marked(text: str, same: set[int]) -> str:
    out, inside = [], False
    for i, c in enumerate(text):
        if (i not in same) != inside:
            inside = not inside
            out.append("[" if inside else "]")
        out.append(c)
    return "".join(out) + ("]" if inside else "")


@pandas_udf(StructType([StructField("left", StringType()), StructField("right", StringType())]))
def headline_diff(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Both headlines with what the other lacks in brackets; those of over 600 characters as they are."""
    rows = []
    for a, b in zip(left, right):
        if a is None or b is None or max(len(a), len(b)) > 600:
            rows.append((a, b))
        else:
            x, y = common_characters(a, b)
            rows.append((_marked(a, x), _marked(b, y)))
    return pd.DataFrame(rows, columns=["left", "right"])


def edit_script(a: list[str], b: list[str], most: int) -> tuple[int, int, int] | None:
    """(removed, added, hunks) of a shortest edit script of tokens, by furthest-reaching paths; None if it needs more than ``most`` edits."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most:
        return None
    front, trail = {1: 0}, []
    for d in range(min(most, len(a) + len(b)) + 1):
        trail.append(dict(front))
        for k in range(-d, d + 1, 2):
            x = front[k + 1] if k == -d or (k != d and front.get(k - 1, -1) < front.get(k + 1, -1)) else front[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            front[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        return None
    x, y = len(a), len(b)
    removed = added = hunks = 0
    touching = False
    for d in range(len(trail) - 1, 0, -1):
        past, k = trail[d], x - y
        down = k == -d or (k != d and past.get(k - 1, -1) < past.get(k + 1, -1))
        px = past[k + 1] if down else past[k - 1]
        py = px - (k + 1 if down else k - 1)
        sx, sy = (px, py + 1) if down else (px + 1, py)
        hunks += not (touching and x == sx and y == sy)
        removed, added = removed + (not down), added + down
        x, y, touching = px, py, True
    return removed, added, hunks


@pandas_udf(StructType([StructField(name, LongType()) for name in ("removed", "added", "hunks")]))
def token_diff(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Words removed and added between two texts and in how many places; null where over 15 % of the words change."""
    rows = []
    for a, b in zip(left, right):
        x, y = (a or "").split(), (b or "").split()
        rows.append(edit_script(x, y, max(4, 15 * (len(x) + len(y)) // 100)) or (None, None, None))
    return pd.DataFrame(rows, columns=["removed", "added", "hunks"]).astype("Int64")


def distinctive_words(reports: DataFrame) -> DataFrame:
    """event, id, words: the words of a headline that only its own outlet uses for the event, in order."""
    w = reports.select("event", "id", "media", F.posexplode(F.split("title", " ")).alias("at", "word")).where("word <> ''")
    alone = w.groupBy("event", "word").agg(F.count_distinct("media").alias("outlets")).where("outlets = 1")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return w.join(alone, ["event", "word"]).groupBy("event", "id").agg(words.alias("words"))


def _dice(a: str, b: str) -> float:
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def camp_picks(reports: DataFrame, camps: tuple[str, ...] = ("blue", "green", "other"), each: int = 3) -> DataFrame:
    """event, camp, id, place: camps take turns; a pick is relevant to the event's seed and new against the picks before it.

    The score is 0.65 relevance + 0.35 (1 - overlap); overlap of 0.72 or more excludes, an outlet has one pick.
    What is relevant is found with joins; an event's relevant reports are one group.
    """
    seed = reports.groupBy("event").agg(F.min_by("title", "id").alias("seed"))
    near = reports.join(seed, "event")
    x, y = shingles(F.col("title"), 2), shingles(F.col("seed"), 2)
    near = near.withColumn("relevance", 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    floor = F.greatest(F.lit(0.12), 0.25 * F.max("relevance").over(Window.partitionBy("event")))
    near = near.withColumn("floor", floor).where("relevance >= floor")

    def pick(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["hour", "id"], ascending=[False, True]).to_dict("records")
        picks: list[dict] = []
        for _ in range(each):
            for camp in camps:
                best = None
                for r in rows:
                    if r["camp"] != camp or any(p["media"] == r["media"] for p in picks):
                        continue
                    overlap = max((_dice(p["title"], r["title"]) for p in picks), default=0.0)
                    score = 0.65 * r["relevance"] + 0.35 * (1 - overlap)
                    if overlap < 0.72 and (best is None or score > best[0]):
                        best = (score, r)
                if best:
                    picks.append(best[1])
        return pd.DataFrame([(key[0], p["camp"], p["id"], i + 1) for i, p in enumerate(picks)], columns=["event", "camp", "id", "place"])

    return near.groupBy("event").applyInPandas(pick, "event string, camp string, id long, place long")


def lead_picks(reports: DataFrame, n: int = 6) -> DataFrame:
    """event, id, place of n reports to read first (hits, then newest): one of each outlet, no camp with over half, no similar titles; the camp rule is dropped if places are left."""

    def pick(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["hits", "hour", "id"], ascending=[False, False, True]).to_dict("records")
        picks: list[dict] = []
        for relaxed in (False, True):
            for r in rows:
                if len(picks) >= n or any(p["media"] == r["media"] for p in picks):
                    continue
                if not relaxed and sum(p["camp"] == r["camp"] for p in picks) >= -(-n // 2):
                    continue
                if all(_dice(p["title"], r["title"]) < 0.5 for p in picks):
                    picks.append(r)
        return pd.DataFrame([(key[0], p["id"], i + 1) for i, p in enumerate(picks)], columns=["event", "id", "place"])

    # of an outlet and camp only its first n distinct titles can be picked, so no more are gathered
    order = Window.partitionBy("event", "media").orderBy(F.desc("hits"), F.desc("hour"), "id")
    first = reports.withColumn("copy", F.row_number().over(Window.partitionBy("event", "media", "title").orderBy(F.desc("hits"), F.desc("hour"), "id"))).where("copy = 1")
    return first.withColumn("k", F.row_number().over(order)).groupBy("event").applyInPandas(pick, "event string, id long, place long")


def word_grams(words: Column, longest: int) -> Column:
    """first, last and tag of each run of 1 to ``longest`` words of an array."""

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("first"), (i + n - 1).alias("last"), F.array_join(F.slice(words, i, n), " ").alias("tag")))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def vocabulary_tags(titles: DataFrame, vocabulary: DataFrame, longest: int = 3, top: int = 8) -> DataFrame:
    """id, tags: the terms (tag, freq) of whole words in each title, without those inside a longer one, the ``top`` most frequent."""
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at = titles.select("id", words.alias("w")).where("size(w) > 0")
    grams = at.select("id", F.explode(word_grams(F.col("w"), longest)).alias("s")).select("id", "s.*")
    hits = grams.join(vocabulary, "tag")
    wider = hits.select("id", F.col("first").alias("f"), F.col("last").alias("l"))
    inside = hits.join(wider, "id").where("f <= first AND l >= last AND (f < first OR l > last)").select("id", "first", "last").distinct()
    kept = hits.join(inside, ["id", "first", "last"], "left_anti").select("id", "tag", "freq").distinct()
    best = kept.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("freq"), "tag"))).where(F.col("k") <= top)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


def attributions(sentences: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, outlet, evidence: sentences (id, sentence) that name an outlet (alias, outlet) as their source.

    The alias must be a word of the sentence with a citing word beside it: *according to* or *citing* before, *said*, *told* or *reported* after.
    """
    words = sentences.select("id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"([\w]+)"), 1))).alias("alias"))
    found = words.join(aliases, "alias")
    cites: Column = F.rlike("sentence", F.concat(F.lit(r"(?i)\b(?:according to|citing) "), "alias", F.lit(r"\b"))) | F.rlike("sentence", F.concat(F.lit(r"(?i)\b"), "alias", F.lit(r" (?:said|told|reported)\b")))
    return found.where(cites).groupBy("id", "outlet").agg(F.min("sentence").alias("evidence"))
