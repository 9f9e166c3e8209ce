"""Near-duplicate texts: MinHash sketches, bands within a time window, Jaccard estimates, exact Dice, evidence and direction.

A sketch decides only which pairs are compared; what is told of a pair comes from the exact sets of its
texts. Texts within a time window meet in one task, by pairs of blocks where there are many: a text is sent
to its blocks and not to each of its pairs, of which there are far more. Here every copy meets every other;
``streaming.near_index`` keeps one representative for equal texts instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.sources.sinks import settle, spread

PERMUTATIONS, BANDS, ROWS, SIZE = 128, 64, 2, 5
_U8 = np.uint64
#: One hash in so many is in a set's sample.
SAMPLED = 8
_PRIME = _U8(0x100000001B3)


def _spread(n: int, start: int) -> np.ndarray:
    """n 64-bit numbers from a rule (the splitmix64 sequence)."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=_U8) * _U8(0x9E3779B97F4A7C15) + _U8(start)
        x = (x ^ (x >> _U8(30))) * _U8(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U8(27))) * _U8(0x94D049BB133111EB)
        return x ^ (x >> _U8(31))


_SEED = (_spread(PERMUTATIONS, 3) >> _U8(32)).astype(np.uint32)


def shingle_hashes(text: str, size: int = SIZE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``size`` code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U8)
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, _U8)
    with np.errstate(over="ignore"):
        h = np.full(n, _U8(0xCBF29CE484222325))
        for j in range(size):
            h = (h ^ points[j : j + n]) * _PRIME
        h = (h ^ (h >> _U8(32))) * _U8(0xD6E8FEB86659FD93)
        return np.unique(h ^ (h >> _U8(32)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser, in place (fixed values: two factors and three shifts)."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each permutation the least 32-bit image of the hashes."""
    found = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> _U8(32)).astype(np.uint32)
    for at in range(0, len(short), 512):  # what fits a core's cache
        np.minimum(found, _mixed(short[at : at + 512, None] ^ _SEED).min(axis=0), out=found)
    return found


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns[0], batch.column(1).to_pylist()
        sets = [shingle_hashes(t) for t in texts]
        packed = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), packed], names=["id", "shingles", "sketch"])


def sketches(texts: DataFrame, least_shingles: int = 100) -> DataFrame:
    """id, shingles (how many distinct), sketch (PERMUTATIONS 32-bit numbers) of each text (id, t: normalised) with enough of them."""
    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts.select("id", "t").where("t is not null")).mapInArrow(_sketches, f"id {kind}, shingles long, sketch binary").where(F.col("shingles") >= least_shingles)


def band_keys(sketched: DataFrame) -> DataFrame:
    """Rows of ``sketched`` for each band, with its key: the hash of the band's number and values."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * 4 * ROWS + 1, F.lit(4 * ROWS))))
    return sketched.select("*", F.posexplode(keys).alias("band", "key"))


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], names=["a", "b", "jaccard"])


def estimates(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """a, b, jaccard: the share of equal places of the sketches of pairs (a, b), which estimates the Jaccard similarity."""
    of = sketched.select("id", "sketch")
    both = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(_estimates, f"a {kind}, b {kind}, jaccard double")


#: A slot of time spans so many windows; a block of a slot holds about so many texts and characters at most.
SPAN, BLOCK_TEXTS, BLOCK_CHARS = 2, 4000, 8_000_000


def seconds(at: str) -> Column:
    return F.unix_seconds(F.col(at).cast("timestamp"))


def meeting(rows: DataFrame, counted: DataFrame, days: int) -> DataFrame:
    """``rows`` (id, sec, ...) once for each group (slot, block, turn) of texts that may be within ``days`` of each other; mine: of the group's own block.

    A slot has as many blocks as ``counted`` (sec, size: at least the rows) takes. A block meets those behind it in its slot
    and, by turns, the texts less than ``days`` from the next slot's beginning; its own texts meet in turn 0.
    """
    window = 86400 * days
    slot, early = F.floor(F.col("sec") / (window * SPAN)).alias("slot"), F.pmod(F.col("sec"), F.lit(window * SPAN)) < window
    blocks = lambda some: F.ceil(F.greatest(F.lit(1), F.count_if(some) / BLOCK_TEXTS, F.coalesce(F.sum(F.when(some, F.col("size"))), F.lit(0)) / BLOCK_CHARS)).cast("int")
    n = counted.where("sec is not null").groupBy(slot).agg(blocks(F.lit(True)).alias("_n"), blocks(early).alias("_e"))
    none = F.lit(None).cast("int")
    sides = F.array(*(F.struct((F.col("slot") + d).alias("slot"), own.alias("_n"), early_.alias("_e"), before.alias("_before"), after.alias("_after")) for d, own, early_, before, after in ((0, F.col("_n"), F.col("_e"), none, none), (1, none, none, F.col("_n"), none), (-1, none, none, none, F.col("_e")))))
    n = n.select(F.explode(sides).alias("s")).select("s.*").groupBy("slot").agg(*(F.max(c).alias(c) for c in ("_n", "_e", "_before", "_after"))).where("_n is not null")
    at = rows.drop("slot").withColumn("slot", slot).join(F.broadcast(n), "slot")  # a row for each slot of time
    mine, ahead = (F.pmod(F.xxhash64("id"), F.col(c)).cast("int") for c in ("_n", "_e"))
    place = lambda s, b, t, own: F.struct(s.cast("long").alias("slot"), b.cast("int").alias("block"), t.cast("int").alias("turn"), F.lit(own).alias("mine"))
    each = lambda k, f: F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), f)).otherwise(F.array().cast("array<struct<slot:bigint,block:int,turn:int,mine:boolean>>"))
    own = each(F.greatest(F.lit(1), F.col("_n") - 1 - mine + F.coalesce("_after", F.lit(0))), lambda t: place(F.col("slot"), mine, t, True))
    behind = each(mine, lambda b: place(F.col("slot"), b, mine - b - 1, False))
    next_ = each(F.when(early, F.coalesce("_before", F.lit(0))).otherwise(0), lambda b: place(F.col("slot") - 1, b, F.col("_before") - 1 - b + ahead, False))
    kept = [c for c in rows.columns if c != "slot"]
    return at.select(*kept, F.explode(F.concat(own, behind, next_)).alias("_p")).select(*kept, "_p.*")


def _met(frame: pa.Table, turn: int, days: int, least: float, least_bands: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a group's texts, sorted by time: the pairs of each run of them by place, with their estimates; no later run has places before ``at``."""
    ids, sec, mine, asked = (frame[c].to_numpy(zero_copy_only=False) for c in ("id", "sec", "mine", "asked"))
    sketches = np.frombuffer(b"".join(frame["sketch"].to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
    bands = np.ascontiguousarray(sketches.reshape(len(ids), BANDS, ROWS).view(np.uint64)[:, :, 0].T)
    until = np.searchsorted(sec, sec + 86400 * days, "right")
    for at in range(0, len(ids), 64):
        to = min(at + 64, len(ids))
        far = until[to - 1]
        agree = np.zeros((to - at, far - at), np.uint8)
        for band in bands:
            agree += band[at:to, None] == band[None, at:far]
        i, j = (x + at for x in np.nonzero(agree >= least_bands))
        keep = (j > i) & (j < until[i]) & (ids[i] != ids[j]) & (asked[i] | asked[j]) & ((mine[i] | mine[j]) if turn == 0 else (mine[i] != mine[j]))
        i, j = i[keep], j[keep]
        jaccard = (sketches[i] == sketches[j]).mean(axis=1)
        keep = jaccard >= least
        i, j = i[keep], j[keep]
        swap = ids[i] > ids[j]
        yield at, np.where(swap, j, i), np.where(swap, i, j), jaccard[keep]


def _estimated(days: int, least: float, least_bands: int):
    def group(key, frame):
        frame, kind = frame.sort_by("sec"), frame.schema.field("id").type
        ids = frame["id"].to_numpy(zero_copy_only=False)
        parts = [(ids[i], ids[j], jaccard) for _, i, j, jaccard in _met(frame, key[2].as_py(), days, least, least_bands)]
        a, b, jaccard = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "jaccard": pa.array(jaccard, pa.float64())})

    return group


def candidates(sketched: DataFrame, days: int = 7, least: float = 0.2, queries: DataFrame | None = None, least_bands: int = 1) -> DataFrame:
    """a, b, jaccard of pairs of texts (id, at, sketch) within ``days`` that agree in a band and whose estimate is at least ``least``.

    With ``least_bands`` = 2 pairs that agree in one band only, most of which are unlike, aren't estimated; of those with
    a Dice of 0.5 that leaves out less than one in a hundred.

    a < b. With ``queries`` (the rows of ``sketched`` to look up) only pairs with one of them are made.
    """
    kind = sketched.schema["id"].dataType.simpleString()
    asked = F.lit(True).alias("asked")
    rows = sketched.select("id", seconds("at").alias("sec"), "sketch")
    rows = settle(rows.select("*", asked) if queries is None else rows.join(queries.select("id", asked).distinct(), "id", "left").fillna(False, "asked"))
    met = meeting(rows, rows.select("sec", F.lit(0).alias("size")), days)
    return met.groupBy("slot", "block", "turn").applyInArrow(_estimated(days, least, least_bands), f"a {kind}, b {kind}, jaccard double")


def _sketched_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(t) for t in batch.column(2).to_pylist()]
        packed = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int64()), packed], names=["id", "sec", "t", "n", "sketch"])


def sketched_texts(texts: DataFrame, least_shingles: int = 100) -> DataFrame:
    """id, sec, t, n (distinct shingles) and sketch of each text (id, sec, t: normalised) with enough of them."""
    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts.select("id", "sec", "t").where("t is not null")).mapInArrow(_sketched_texts, f"id {kind}, sec long, t string, n long, sketch binary").where(F.col("n") >= least_shingles)


def _near(days: int, least: float, least_bands: int, least_shared: int, least_dice: float):
    jaccard = least_dice / (2 - least_dice)

    def group(key, frame):
        frame, kind = frame.sort_by("sec"), frame.schema.field("id").type
        ids, n, texts = frame["id"].to_numpy(zero_copy_only=False), frame["n"].to_numpy(), frame["t"].combine_chunks()
        sets, found = {}, []

        def of(p: int) -> tuple[np.ndarray, np.ndarray]:
            if p not in sets:
                s = shingle_hashes(texts[p].as_py())
                sets[p] = s, s[s % _U8(SAMPLED) == 0]
            return sets[p]

        for at, a, b, _ in _met(frame, key[2].as_py(), days, least, least_bands):
            for p in [p for p in sets if p < at]:
                del sets[p]
            few = np.minimum(n[a], n[b])
            keep = (few >= least_shared) & (2 * few >= least_dice * (n[a] + n[b]))
            for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                (x, sx), (y, sy) = of(i), of(j)
                both = _in_common(sx, sy)
                union = max(len(sx) + len(sy) - both, 1)
                if both / union >= jaccard - 5 * np.sqrt(jaccard * (1 - jaccard) / union):
                    found.append((i, j, _in_common(x, y), texts[i] == texts[j]))
        i, j, shared, same = (list(c) for c in zip(*found)) if found else ([], [], [], [])
        i, j = np.array(i, int), np.array(j, int)
        columns = [pa.array(ids[i], kind), pa.array(ids[j], kind), pa.array(shared, pa.int64()), pa.array(n[i], pa.int64()), pa.array(n[j], pa.int64()), pa.array(same, pa.bool_())]
        return pa.table(columns, names=["a", "b", "shared", "na", "nb", "same"])

    return group


def near_pairs(rows: DataFrame, counted: DataFrame, days: int = 7, least: float = 0.2, least_bands: int = 2, least_shared: int = 100, least_dice: float = 0.5) -> DataFrame:
    """What ``measured`` tells of the ``candidates`` of texts (id, sec, t, n, sketch), where texts meet; asked: whether a text's pairs are wanted, if there is such a column.

    ``counted`` (sec, size in characters) holds at least the rows, and may be cheaper to read.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "sec", "t", "n", "sketch", *(["asked"] if "asked" in rows.columns else [F.lit(True).alias("asked")]))
    met = meeting(rows, counted, days).groupBy("slot", "block", "turn")
    counts = met.applyInArrow(_near(days, least, least_bands, least_shared, least_dice), f"a {kind}, b {kind}, shared long, na long, nb long, same boolean")
    return _told(counts, least_shared, least_dice)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(t) for t in batch.column(1).to_pylist()]
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in batch.column(1).to_pylist()]
        packed = [pa.array([s.astype("<u8").tobytes() for s in some], pa.binary()) for some in (sets, [s[s % _U8(SAMPLED) == 0] for s in sets])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *packed, pa.array(digests, pa.binary())], names=["id", "n", "hashes", "sample", "digest"])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id, n, hashes (sorted, 8 bytes each), sample (those divisible by SAMPLED) and digest (of the text) of each text (id, t); null texts have none."""
    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts.select("id", "t").where("t is not null")).mapInArrow(_sets, f"id {kind}, n long, hashes binary, sample binary, digest binary")


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted arrays have in common."""
    x, y = sorted((x, y), key=len)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _shared(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes the sorted sets of columns 2 and 3 have in common, and how many there are in both together."""
    shared, union = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    for i, pair in enumerate(zip(batch.column(2), batch.column(3))):
        x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in pair)
        shared[i] = _in_common(x, y)
        union[i] = len(x) + len(y) - shared[i]
    return shared, union


def _likely(jaccard: float):
    """Pairs whose sampled sets don't rule out this similarity by five standard deviations."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, union = _shared(batch)
            union = np.maximum(union, 1)
            keep = pa.array(shared / union >= jaccard - 5 * np.sqrt(jaccard * (1 - jaccard) / union))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return rows


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, _ = _shared(batch)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1)), pa.array(shared, pa.int64()), *(batch.column(k) for k in (4, 5, 6))], names=["a", "b", "shared", "na", "nb", "same"])


def measured_sets(pairs: DataFrame, sets: DataFrame, least_shared: int = 100, least_dice: float = 0.5) -> DataFrame:
    """a, b, shared, dice, containment, kind of pairs (a, b) by the exact shingle sets (id, n, hashes, digest) of their texts.

    Pairs whose sizes rule out the least Dice aren't compared, nor those whose samples do (at five standard deviations:
    fewer than one in a million of those that reach it). kind is *identical* where the digests are equal, else *high*.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    few = sets.select("id", "n", "sample")
    near = pairs.select("a", "b").join(few.toDF("a", "na", "ha"), "a").join(few.toDF("b", "nb", "hb"), "b")
    near = near.where((F.least("na", "nb") >= least_shared) & (2 * F.least("na", "nb") >= least_dice * (F.col("na") + F.col("nb"))))
    likely = near.select("a", "b", "ha", "hb").mapInArrow(_likely(least_dice / (2 - least_dice)), f"a {kind}, b {kind}")
    of = sets.select("id", "n", "hashes", "digest")
    both = likely.join(of.toDF("a", "na", "ha", "da"), "a").join(of.toDF("b", "nb", "hb", "db"), "b")
    counted = both.select("a", "b", "ha", "hb", "na", "nb", (F.col("da") == F.col("db")).alias("same")).mapInArrow(_measure, f"a {kind}, b {kind}, shared long, na long, nb long, same boolean")
    return _told(counted, least_shared, least_dice)


def _told(counted: DataFrame, least_shared: int, least_dice: float) -> DataFrame:
    dice = 2 * F.col("shared") / (F.col("na") + F.col("nb"))
    found = counted.where((F.col("shared") >= least_shared) & (dice >= least_dice))
    return found.select("a", "b", "shared", F.round(dice, 9).alias("dice"), F.round(F.col("shared") / F.least("na", "nb"), 9).alias("containment"), F.when(F.col("same"), "identical").otherwise("high").alias("kind"))


def measured(pairs: DataFrame, texts: DataFrame, least_shared: int = 100, least_dice: float = 0.5) -> DataFrame:
    """``measured_sets`` of pairs of texts (id, t): a text that is in a pair is shingled once."""
    pairs = settle(pairs.select("a", "b"))
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return measured_sets(pairs, settle(shingle_sets(texts.join(met, "id", "left_semi"))), least_shared, least_dice)


#: Lengths of the passages that are looked for, and the step between them.
PASSAGES, STEP = (100, 60, 30, 20), 5


def shared_passage(a: str | None, b: str | None) -> str | None:
    """The first passage of a, of the greatest length of PASSAGES, that b holds too."""
    for n in PASSAGES if a and b else ():
        for i in range(0, len(a) - n + 1, STEP):
            if a[i : i + n] in b:
                return a[i : i + n]
    return None


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shared_passage(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["a", "b", "passage"])


def evidence(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, passage: the text that shows what two texts have in common."""
    of = texts.select("id", "body")
    both = pairs.select("a", "b").join(of.toDF("a", "ta"), "a").join(of.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(_evidence, f"a {kind}, b {kind}, passage string")


def direction(kind: Column, order: Column) -> Column:
    """Which way a connection points: attributed ones from the cited text, others from the earlier one; none where that is unknown or the same."""
    return F.when(kind == "attributed", "b-to-a").when(order == "first", "a-to-b").when(order == "second", "b-to-a").otherwise("none")


def index_batch(texts: DataFrame, indexed: DataFrame, batch: int = 2000, rounds: int = 5, days: int = 7) -> DataFrame:
    """a, b, jaccard of the newest texts that aren't in ``indexed`` (id) against all within ``days``.

    At most batch x rounds texts are taken, the newest first; the rest wait for the next call.
    """
    sketched = sketches(texts).join(texts.select("id", "at"), "id")
    fresh = sketched.join(indexed.select("id"), "id", "left_anti").orderBy(F.desc("at"), F.desc("id")).limit(batch * rounds)
    return candidates(sketched, days, queries=fresh)
