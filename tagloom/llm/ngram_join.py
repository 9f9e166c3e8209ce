"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts become sets of 64-bit hashes of word n-grams. The work is dealt three times:

1. *By n-gram.* A chunk of texts sends its n-grams, packed in arrays, to hash buckets. A bucket
   knows how many texts hold each n-gram and answers for those that two or more hold. An n-gram
   that many texts of a chunk share goes as one marker, and its texts are told at once, so no
   bucket receives a very common n-gram once for each text.
2. *By text.* A text hears which of its n-grams are shared. At a similarity of 80 % at least 80 %
   of its n-grams have to be, so most texts drop out here. Equal sets become one class.
3. *By prefix n-gram.* The n-grams of a class stand in rare-first order; two classes can only link
   if they share one of the first ``n - ceil(0.8 n) + 1``. Each posting list compares its members
   with one pivot (rows in proportion to the list, never all pairs), linked classes merge, and
   further pivots follow while lists are still split. What is then left compares members of
   *different* components only, in pairs of blocks of a list, which loses no link. Each pair passes
   the length, positional and suffix filters and is verified once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import U8, Stash, binary, buckets_for, mix, one_row_per_id, slices, span_hashes, window_hashes, words
from tagloom.llm.common import LOWER
from tagloom.llm.graph import components

#: Bytes of text whose n-grams are packed together.
CHUNK_BYTES = 12 << 20
#: An n-gram that so many texts of a chunk hold is sent as one marker.
COMMON = 64
#: The code of the commonest n-grams, those that a chunk sends as markers.
TOP_DF = 255
#: In exhaustive rounds a posting list is dealt in blocks of about so many members; other rounds salt lists by so many.
BLOCK, SALT = 256, 2048


def frequency_codes(df: np.ndarray) -> np.ndarray:
    """One byte for the rare-first order: up to 128 the frequency, beyond it three steps for each doubling."""
    wide = 128 + np.floor(3 * np.log2(np.maximum(df, 128) / 128)).astype(np.int64)
    return np.minimum(np.where(df <= 128, df, wide), TOP_DF).astype(np.uint8)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text with fewer words has its whole sequence."""
    first, end, row = words(data, offsets)
    low = LOWER[data]
    tokens = span_hashes(low, first, end)
    grams, at = window_hashes(tokens, row, size)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    start = np.concatenate([[0], np.cumsum(count)])
    grams_start = np.searchsorted(at, start)
    out = []
    for i in range(rows):
        if count[i] >= size:
            part = np.sort(grams[grams_start[i] : grams_start[i + 1]])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif count[i]:
            whole = np.full(1, 0x5EED + count[i], U8)
            for t in tokens[start[i] : start[i + 1]]:
                whole = mix(whole + t)
            out.append(whole)
        else:
            out.append(np.zeros(0, U8))
    return out


_PACKED = "bucket int, kind int, docs binary, sizes binary, counts binary, grams binary, df binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("docs", "sizes", "counts", "grams", "df")]])
#: Kinds of packed rows: n-grams for their bucket, markers of common ones, what goes on to the texts.
TO_BUCKET, MARKER, TO_TEXT = 0, 1, 2


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PACKED_ARROW)], schema=_PACKED_ARROW)


def _by_group(group: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, positions in the old order) of each group that occurs."""
    order = np.argsort(group.astype(np.uint32), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(n + 1))
    for g in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(g), order[cuts[g] : cuts[g + 1]]


def _pack(docs: np.ndarray, sizes: np.ndarray, at: np.ndarray, grams: np.ndarray, df: np.ndarray | None) -> tuple:
    """at: the place in docs of each n-gram, in ascending order."""
    used, counts = np.unique(at, return_counts=True)
    return binary(docs[used]), binary(sizes[used].astype(np.int32)), binary(counts.astype(np.int32)), binary(grams), b"" if df is None else binary(df)


def _send(size: int, buckets: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0
        for rows, data, offsets in slices(batches):
            docs.append(rows.column(rows.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64))
            sets += ngram_sets(data, offsets, size)
            held += len(data)
            if held >= CHUNK_BYTES:
                yield from dealt(np.concatenate(docs), sets)
                docs, sets, held = [], [], 0
        if sets:
            yield from dealt(np.concatenate(docs), sets)

    def dealt(docs: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets) if sets else np.zeros(0, U8)
        at = np.repeat(np.arange(len(docs)), sizes)
        ordered = np.sort(grams)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        common = ordered[edge[np.diff(np.append(edge, len(ordered))) >= COMMON]]
        home = mix(docs.astype(U8)) % U8(buckets)
        for g, pick in _by_group(home, buckets):
            yield _packed([(g, TO_TEXT, binary(docs[pick]), binary(sizes[pick].astype(np.int32)), b"", b"", b"")])
        if len(common):
            place = np.minimum(np.searchsorted(common, grams), len(common) - 1)
            told = common[place] == grams
            far = np.flatnonzero(told)
            for g, pick in _by_group(home[at[far]], buckets):
                pick = far[pick]
                yield _packed([(g, TO_TEXT, *_pack(docs, sizes, at[pick], grams[pick], np.full(len(pick), TOP_DF, np.uint8)))])
            for g, pick in _by_group(common % U8(buckets), buckets):
                yield _packed([(g, MARKER, b"", b"", b"", binary(common[pick]), b"")])
            grams, at = grams[~told], at[~told]
        for g, pick in _by_group(grams % U8(buckets), buckets):
            yield _packed([(g, TO_BUCKET, *_pack(docs, sizes, at[pick], grams[pick], None))])

    return chunks


def _ints(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), kind)


def _answer(buckets: int):
    def bucket(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [(b, TO_TEXT, d, s, c, g, f) for b, k, d, s, c, g, f in zip(*(table.column(i).to_pylist() for i in range(7))) if k == TO_TEXT]
        own = table.filter(pa.array(kinds == TO_BUCKET))
        grams = _ints(own, "grams", U8)
        if len(grams):
            docs, sizes = _ints(own, "docs", np.int64), _ints(own, "sizes", np.int32)
            at = np.repeat(np.arange(len(docs)), _ints(own, "counts", np.int32))
            marked = np.sort(_ints(table.filter(pa.array(kinds == MARKER)), "grams", U8))
            order = np.argsort(grams)
            ordered = grams[order]
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            df = frequency_codes(np.diff(np.append(edge, len(grams))))
            if len(marked):
                df[marked[np.minimum(np.searchsorted(marked, ordered[edge]), len(marked) - 1)] == ordered[edge]] = TOP_DF
            df = np.repeat(df, np.diff(np.append(edge, len(grams))))
            pick = np.sort(order[df >= 2])
            back = np.zeros(len(grams), np.uint8)
            back[order] = df
            home = mix(docs.astype(U8)) % U8(buckets)
            for g, some in _by_group(home[at[pick]], buckets):
                some = pick[some]
                out.append((g, TO_TEXT, *_pack(docs, sizes, at[some], grams[some], back[some])))
        return pa.Table.from_batches([_packed(out)] if out else [], schema=_PACKED_ARROW)

    return bucket


_TEXTS = "doc_id long, n long, class_hi long, class_lo long, grams binary, df binary"
_TEXTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class_hi", pa.int64()), ("class_lo", pa.int64()), ("grams", pa.binary()), ("df", pa.binary())])


def _gather(percent: int):
    def texts(table: pa.Table) -> pa.Table:
        docs, sizes = _ints(table, "docs", np.int64), _ints(table, "sizes", np.int32)
        ids, where = np.unique(docs, return_index=True)
        n = sizes[where].astype(np.int64)
        told = table.filter(pa.array([bool(x) for x in table.column("counts").to_pylist()], pa.bool_()))
        grams, df = _ints(told, "grams", U8), _ints(told, "df", np.uint8)
        at = np.searchsorted(ids, np.repeat(_ints(told, "docs", np.int64), _ints(told, "counts", np.int32)))
        shared = np.bincount(at, minlength=len(ids))
        start = np.concatenate([[0], np.cumsum(shared)])
        able = (n > 0) & (100 * shared >= percent * n)
        order = np.argsort(at, kind="stable")
        hi, lo, packed, packed_df = [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)
        for i in np.flatnonzero(able):
            pick = order[start[i] : start[i + 1]]
            own = grams[pick]
            by = np.argsort(own)
            own = own[by]
            packed[i], packed_df[i] = binary(own), binary(df[pick][by])
            if len(own) == n[i]:
                with np.errstate(over="ignore"):
                    hi[i], lo[i] = (int(np.bitwise_xor.reduce(mix(own + U8(k))).view(np.int64)) for k in (1, 2))
        return pa.Table.from_arrays([pa.array(ids), pa.array(n), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(packed, pa.binary()), pa.array(packed_df, pa.binary())], schema=_TEXTS_ARROW)

    return texts


def _prefixes(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rid, size, pos = [], [], [], []
            for i, n, grams, df in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rid", "n", "grams", "df"))):
                own, f = np.frombuffer(grams, U8), np.frombuffer(df, np.uint8)
                alone = n - len(own)
                take = n + (-percent * n // 100) + 1 - alone
                if take > 0:
                    head = np.lexsort((own, f))[:take]
                    key.append(own[head].view(np.int64))
                    pos.append(alone + np.arange(len(head)))
                    rid.append(np.full(len(head), i, np.int64))
                    size.append(np.full(len(head), n, np.int64))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, rid, size, pos)], names=["k", "rid", "n", "pos"])

    return rows


#: The suffix filter compares how many n-grams fall in each of so many equal ranges of the hash.
RANGES = 16
_CUTS = (np.arange(1, RANGES, dtype=U8) << U8(64 - RANGES.bit_length() + 1)).astype(U8)


def linked(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted arrays of the shared n-grams of each."""
    need = -(-percent * (nx + ny) // (100 + percent))
    cx, cy = (np.diff(np.concatenate([[0], np.searchsorted(v, _CUTS), [len(v)]])) for v in (x, y))
    if np.minimum(cx, cy).sum() < need:
        return False
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (nx + ny - both)


def _verify(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "na", "nb", "ga", "gb")}
            na, nb = col["na"].to_pylist(), col["nb"].to_pylist()
            ok = [linked(np.frombuffer(x.as_buffer(), U8), np.frombuffer(y.as_buffer(), U8), i, j, percent) for x, y, i, j in zip(col["ga"], col["gb"], na, nb)]
            yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return rows


def _possible(x: str, y: str, percent: int):
    """The length and positional filters for one shared prefix n-gram of two sets.

    The bound counts no n-gram before this one as shared. It holds for the first n-gram, in rare-first
    order, that two sets share, which suffices: a linked pair passes by that one.
    """
    nx, px, ny, py = (F.col(f"{s}.{c}") for s in (x, y) for c in ("n", "pos"))
    most = F.least(nx - px, ny - py)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * most >= percent * (nx + ny))


def _link_classes(reps: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """(id, component) of the classes that link with another one. reps: rid, n, grams, df."""
    posting = reps.mapInArrow(_prefixes(percent), "k long, rid long, n long, pos long")
    posting = stash.put(posting, "prefixes")
    # a member too deep in its order for even the smallest set of the list can't be linked by this n-gram
    lists = stash.put(posting.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1"), "lists")
    fits = (100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.col("least"))
    salts = F.ceil(F.col("members") / SALT).cast("int").alias("salts")
    posting = stash.put(posting.join(lists, "k").where(fits).select("k", "rid", "n", "pos", salts, F.pmod(F.xxhash64("rid"), salts).cast("int").alias("salt")), "postings")
    rows = posting.count()
    sets = reps.select("rid", "n", "grams")
    tested = links = labels = None
    rounds = 0
    while rows:
        rounds += 1
        member = posting.withColumn("c", F.col("rid")) if labels is None else posting.join(labels.select(F.col("id").alias("rid"), "component"), "rid", "left").select(*posting.columns, F.coalesce("component", "rid").alias("c"))
        # first the member with the fewest rarer n-grams, which is most like the others; later any
        first = F.struct("pos", "rid") if rounds == 1 else F.struct(F.xxhash64("rid", F.lit(rounds)), "rid")
        pivot = F.min_by(F.struct("rid", "n", "pos", "c"), first)
        lists = member.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("members"), F.max("salts").alias("salts"), pivot.alias("y"))
        lists = stash.put(lists.where("low < high").select("k", "members", "salts", "y"), "split")
        most = lists.agg(F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()[0]
        if most is None:  # no list is split
            break
        exhaustive = rounds > 1 and (rounds > 6 or not grew or most <= 16 * rows or _split_pairs(member) <= 16 * rows)
        x = F.struct("rid", "n", "pos", "c")
        if exhaustive:
            star = _block_pairs(member, lists)
        else:
            star = member.select("k", "salt", x.alias("x")).join(lists.select("k", "y", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), ["k", "salt"])
        star = star.where("x.c <> y.c").where(_possible("x", "y", percent))
        pairs = star.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        left = pairs.join(sets.toDF("a", "na", "ga"), "a").join(sets.toDF("b", "nb", "gb"), "b")
        seen = stash.put(left.mapInArrow(_verify(percent), "a long, b long, ok boolean"), "verified")
        fresh = seen.where("ok").select("a", "b")
        grew = not fresh.isEmpty()
        if grew:
            links = fresh if links is None else links.unionAll(fresh)
            labels = components(links, stash)
        if exhaustive:
            break
        tested = seen.select("a", "b") if tested is None else tested.unionAll(seen.select("a", "b"))
    return labels if labels is not None else reps.select(F.col("rid").alias("id"), F.col("rid").alias("component")).limit(0)


def _block_pairs(member: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (x, y) of members of each split list once, dealt by pairs of blocks so that a task gets BLOCK x BLOCK of them at a time."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = member.join(lists.select("k", blocks.alias("blocks")), "k").select("k", "blocks", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("blocks")).cast("int").alias("own"), F.struct("rid", "n", "pos", "c").alias("m"))
    x = dealt.select("k", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("m").alias("x"))
    y = dealt.select("k", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("m").alias("y"))
    return x.join(y, ["k", "i", "j"]).where("i < j or x.rid < y.rid")


def _split_pairs(member: DataFrame) -> int:
    """How many pairs of a posting list stand in different components."""
    inner = member.groupBy("k", "c").count()
    lists = inner.groupBy("k").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    return int(lists.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def ngram_jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, for each doc_id of ``docs`` (doc_id, text; more columns are ignored).

    Two documents link when 100 * intersection >= percent * union of their sets of word n-grams.
    class_id is the least doc_id with the same set; component_id the least doc_id reachable by links.

    Null or empty texts and texts without a word have an empty set, size 0, and link with nothing.
    Rows without doc_id go; of rows that repeat a doc_id the one with the greatest text counts. An
    empty table gives an empty result. Texts of any length count whole.
    """
    spark = docs.sparkSession
    stash, buckets = Stash(spark), buckets_for(spark)
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sent = docs.mapInArrow(_send(size, buckets), _PACKED)
    answers = sent.groupBy("bucket").applyInArrow(_answer(buckets), _PACKED)
    texts = stash.put(answers.groupBy("bucket").applyInArrow(_gather(percent), _TEXTS), "texts")
    sure = F.col("class_hi").isNotNull()
    named = texts.where(sure).groupBy("n", "class_hi", "class_lo").agg(F.min("doc_id").alias("class_id"))
    able = texts.where("grams is not null").join(named, ["n", "class_hi", "class_lo"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    able = stash.put(able, "classes")
    reps = texts.where("grams is not null").join(able.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    reps = stash.put(reps.select(F.col("doc_id").alias("rid"), "n", "grams", "df"), "sets")
    labels = _link_classes(reps, percent, stash)
    placed = able.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    out = texts.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
