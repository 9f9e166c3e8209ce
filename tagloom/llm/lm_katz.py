"""Katz backoff language model: counts, discounts, backoff weights and scores of a corpus in one job chain.

P(w | h) is ``d(c) c(h w) / c(h)`` for a seen pair, with Good-Turing discounts d, and
``a(h) P(w)`` otherwise, where ``a(h) = (1 - sum of the seen) / (1 - sum of P(w) over the seen)``
makes the probabilities of a context sum to exactly 1; P(w) is a Good-Turing discounted unigram
whose left-over mass belongs to one unknown word.

Documents are packed in chunks that keep their vocabulary and token numbers in a table bucketed by
chunk. For each order a chunk asks hash buckets about its *distinct* n-grams: the buckets add up the
training counts, store the model (one row for each bucket) and answer with what the chunk needs. A
very common n-gram costs one entry a chunk. A known word's 64-bit number holds its count, so whoever
has the number needs no table to tell its probability. The pairs of a context with a large share of
all tokens are dealt to a number of buckets in proportion to that share, whose sums Spark adds up.
Every token is then scored in its chunk, first as a pair and, where the pair wasn't seen, by the
lower order. A chunk meets the answers it got as a group of its own, so that a task holds one chunk
at a time, and workers give back what a chunk or bucket took before the next one comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, U8, Stash, binary, buckets_for, mix, release, slices, span_hashes, words

CHUNK_BYTES = 8 << 20
#: Counts up to TOP are discounted by Good-Turing; larger ones lose one part in a million.
TOP, REST = 5, 1e-6
END = U8(0x00E0D0E0D0E0D0E0)
#: A word number: 14 bits of the bucket, 6 of the length of its count, 44 of the count without its
#: leading bit and then the place among the words of the bucket with that count. As these words hold
#: count x place tokens, both fit for buckets of up to 2^44 tokens.
LENGTH_AT, COUNT_BITS, MOST_BUCKETS = 44, 44, 16_000
UNKNOWN, START = U8(0xFFFFFFFFFFFFFFFF), U8(0xFFFFFFFFFFFFFFFE)

_CHUNK = "chunk long, ids binary, flags binary, sizes binary, vocab binary, counts binary, tokens binary"


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, without most of its copies."""
    order = np.argsort(values)
    values = values[order]
    edge = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=edge[1:])
    run = np.cumsum(edge, dtype=np.int32)
    run -= 1
    place = np.empty(len(values), np.int32)
    place[order] = run
    return values[edge], place


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks. flags: 1 for training, 2 for a null doc_id; counts: of training tokens."""
    number = TaskContext.get().partitionId() << 32
    ids, flags, sizes, hashes, held = [], [], [], [], 0

    def packed() -> pa.RecordBatch:
        size = np.concatenate(sizes)
        flag = np.concatenate(flags)
        vocab, tokens = distinct(np.concatenate(hashes))
        counts = np.bincount(tokens[np.repeat(flag & 1, size) == 1], minlength=len(vocab))
        cols = [np.concatenate(ids), flag.astype(np.uint8), size.astype(np.int32), vocab, counts.astype(np.uint32), tokens.astype(np.uint32)]
        names = ["chunk", "ids", "flags", "sizes", "vocab", "counts", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([binary(c)], pa.binary()) for c in cols)], names=names)

    for batch, data, offsets in slices(batches):
        first, end, row = words(data, offsets)
        h = span_hashes(LOWER[data], first, end)
        n = np.bincount(row, minlength=len(offsets) - 1)
        hashes.append(np.insert(h, np.cumsum(n), END))
        sizes.append(n + 1)
        doc = batch.column(batch.schema.get_field_index("doc_id"))
        train = batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
        flags.append(train.astype(np.int64) + 2 * doc.is_null().to_numpy(zero_copy_only=False))
        ids.append(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        held += len(data)
        if held >= CHUNK_BYTES:
            yield packed()
            number += 1
            ids, flags, sizes, hashes, held = [], [], [], [], 0
            release()
    if sizes:
        yield packed()
    ids, flags, sizes, hashes = [], [], [], []
    release()


def _each(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one; binary values are the table's own buffers and no copies."""
    for i in range(table.num_rows):
        values = ((name, table.column(k)[i]) for k, name in enumerate(table.schema.names))
        yield {name: v.as_buffer() if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type) else v.as_py() for name, v in values}


def _deal(group: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group.astype(np.uint32), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(n + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        yield int(g), order[cuts[g] : cuts[g + 1]]


def _ask_words(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _each(batch)):
            vocab, counts = np.frombuffer(r["vocab"], U8), np.frombuffer(r["counts"], np.uint32)
            got = [(g, r["chunk"], binary(vocab[p]), binary(counts[p])) for g, p in _deal(vocab % U8(buckets), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "grams", "counts"])

    return rows


_ANSWER = "bucket int, chunk long, grams binary, counts binary, extra binary"
_ANSWER_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("extra", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ANSWER_ARROW)], schema=_ANSWER_ARROW)


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers by place, which compress better, without the high ones that all are 0; how many come first."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    used = max(1, int(planes.any(axis=1).nonzero()[0].max(initial=0)) + 1)
    return bytes([used]) + planes[:used].tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(U8).ravel()


def number_words(bucket: int, counts: np.ndarray) -> np.ndarray:
    """The number of each word of a bucket; counts are positive and fall."""
    fresh = np.concatenate([[True], counts[1:] != counts[:-1]]) if len(counts) else np.zeros(0, bool)
    place = np.arange(len(counts)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(counts) else np.zeros(0, np.int64)
    length = np.frexp(counts.astype(float))[1].astype(np.int64)
    rest = (counts - (np.int64(1) << (length - 1))) << (COUNT_BITS + 1 - length)
    return U8(bucket) << U8(50) | length.astype(U8) << U8(LENGTH_AT) | (rest + place).astype(U8)


def counts_of(numbers: np.ndarray, texts: int) -> np.ndarray:
    """Training counts; of the start of a text, the number of texts; of unknown words 0."""
    word = numbers < START
    length = np.where(word, (numbers >> U8(LENGTH_AT)) & U8(63), U8(1)).astype(np.int64)
    rest = (numbers & U8((1 << COUNT_BITS) - 1)).astype(np.int64) >> (COUNT_BITS + 1 - length)
    return np.where(word, (np.int64(1) << (length - 1)) + rest, np.where(numbers == START, texts, 0))


def _count_words(table: pa.Table) -> pa.Table:
    """A model row (chunk null: words by falling count, their numbers, how many words have each count up to TOP + 1,
    tokens and ends) and, for each chunk, the number of each word it asked for."""
    rows = list(_each(table))
    grams = np.concatenate([np.frombuffer(r["grams"], U8) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    known, where = distinct(grams)
    total = np.bincount(where, weights=counts, minlength=len(known)).astype(np.int64)
    order = np.argsort(-total, kind="stable")
    used = order[: int((total > 0).sum())]
    number = np.full(len(known), UNKNOWN, U8)
    number[used] = number_words(rows[0]["bucket"], total[used])
    sizes = np.append(np.bincount(np.minimum(total[used], TOP + 2), minlength=TOP + 3), [total.sum(), total[known == END].sum()])
    out = [(rows[0]["bucket"], None, binary(known[used]), _planes(number[used]), binary(sizes.astype(np.int64)))]
    at = 0
    for r in rows:
        n = r["grams"].size // 8
        out.append((r["bucket"], r["chunk"], _planes(number[where[at : at + n]]), None, None))
        at += n
    return _table(out)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[c] for c = 0..TOP from the numbers n[1..TOP + 1] of n-grams with that count; n[0] isn't used.

    Katz's formula; where it leaves (0, 1), as tiny corpora can make it, 1 - 1 / (2 c) stands in.
    """
    d = np.ones(TOP + 1)
    for c in range(1, TOP + 1):
        cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 0.0
        raw = ((c + 1) * n[c + 1] / (c * n[c]) - cut) / (1 - cut) if n[c] and cut < 1 else -1.0
        d[c] = raw if 0 < raw < 1 else 1 - 1 / (2 * c)
    return d


class Unigrams:
    """Sizes and discounts of the unigram model; sizes: words by count up to TOP + 1, more, all tokens and ends."""

    def __init__(self, sizes: np.ndarray, buckets: int) -> None:
        n, self.total, self.texts = sizes[:-2], int(sizes[-2]), int(sizes[-1])
        self.known, self.buckets = int(n.sum()), buckets
        self.d = discounts(n)
        few = n[1 : TOP + 1] * np.arange(1, TOP + 1)
        mass = float((few * self.d[1:]).sum()) + (1 - REST) * (self.total - int(few.sum()))
        self.unknown = 1 - mass / self.total if self.total else 1.0
        #: A context with more tokens is dealt to several buckets: in all at most 8 x buckets parts.
        self.often = max(1, self.total // (4 * buckets))

    def count(self, numbers: np.ndarray) -> np.ndarray:
        return counts_of(numbers, self.texts)

    def p(self, numbers: np.ndarray) -> np.ndarray:
        c = self.count(numbers)
        return np.where(c > 0, np.where(c <= TOP, self.d[np.minimum(c, TOP)], 1 - REST) * c / max(self.total, 1), self.unknown)

    def parts(self, context: np.ndarray) -> np.ndarray:
        """Into how many parts the pairs of a context are dealt."""
        return np.minimum(1 + self.count(context) // self.often, self.buckets)

    def pair_bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            part = mix(word + U8(0x9E3779B97F4A7C15)) % self.parts(context).astype(U8)
        return (mix(context) % U8(self.buckets) + part) % U8(self.buckets)


class Chunk:
    """A chunk with numbered words: number, context and training mark of each token, distinct pairs with a known context in their order."""

    def __init__(self, row: dict, told: dict[int, pa.Buffer], buckets: int) -> None:
        """told: each bucket's answer about the words asked."""
        vocab = np.frombuffer(row["vocab"], U8)
        number = np.full(len(vocab) + 1, START, U8)
        for g, p in _deal(vocab % U8(buckets), buckets):
            number[p] = _from_planes(told[g])
        order = np.argsort(number, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        number = self.number = number[order]
        at = rank[np.frombuffer(row["tokens"], np.uint32)]
        self.size = np.frombuffer(row["sizes"], np.int32)
        self.flags = np.frombuffer(row["flags"], np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        before = np.concatenate([at[:1], at[:-1]])
        before[self.first] = rank[-1]
        self.at, self.train = at, np.repeat(self.flags & 1, self.size) == 1
        known = (number != UNKNOWN)[before]
        key = before[known].astype(U8)
        del before
        key <<= U8(32)
        key |= at.view(np.uint32)[known]
        pairs, where = distinct(key)
        del key
        self.place = np.full(len(at), -1, np.int32)
        self.place[known] = where
        self.context, self.word = number[(pairs >> U8(32)).astype(np.int64)], number[(pairs & U8(0xFFFFFFFF)).astype(np.int64)]


def _runs(contexts: np.ndarray) -> tuple[bytes, bytes]:
    """Each run of equal contexts once, and their lengths."""
    edge = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    return _planes(contexts[edge]), _planes(np.diff(np.append(edge, len(contexts))))


_PAIRS = "bucket int, chunk long, contexts binary, runs binary, grams binary, counts binary"
_PAIRS_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((name, pa.binary()) for name in ("contexts", "runs", "grams", "counts"))])


def _ask_pairs(uni: Unigrams):
    def rows(chunk: pa.Table, words_told: pa.Table) -> pa.Table:
        told, got = {a["bucket"]: a["grams"] for a in _each(words_told)}, []
        for r in _each(chunk):
            c = Chunk(r, told, uni.buckets)
            counts = np.bincount(c.place[c.train & (c.place >= 0)], minlength=len(c.word))
            got += [(g, r["chunk"], *_runs(c.context[p]), _planes(c.word[p]), _planes(counts[p])) for g, p in _deal(uni.pair_bucket(c.context, c.word), uni.buckets)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), _PAIRS_ARROW)], schema=_PAIRS_ARROW) if got else _PAIRS_ARROW.empty_table()

    return rows


def _context_sums(at: np.ndarray, contexts: int, word: np.ndarray, counts: np.ndarray, uni: Unigrams) -> np.ndarray:
    """Rows for the contexts of: seen pairs with count 1..TOP, sum of larger counts, sum of P(w). at: the context of each seen pair."""
    sums = np.zeros((contexts, TOP + 2))
    for c in range(1, TOP + 1):
        sums[:, c - 1] = np.bincount(at, weights=counts == c, minlength=contexts)
    sums[:, TOP] = np.bincount(at, weights=np.where(counts > TOP, counts, 0), minlength=contexts)
    sums[:, TOP + 1] = np.bincount(at, weights=uni.p(word), minlength=contexts)
    return sums


def _count_pairs(uni: Unigrams):
    """Rows: the model's (chunk null: contexts and words, counts, numbers of counts), sums of contexts dealt in parts
    (chunk -1), and for each chunk the count of each pair, the contexts of its unseen pairs and their sums."""

    def bucket(table: pa.Table) -> pa.Table:
        rows = list(_each(table))
        asked = [_from_planes(r["grams"]) for r in rows]
        sizes = [len(x) for x in asked]
        contexts, c = distinct(np.concatenate([_from_planes(r["contexts"]) for r in rows]))
        c = np.repeat(c, np.concatenate([_from_planes(r["runs"]) for r in rows]).astype(np.int64))
        vocab, w = distinct(np.concatenate(asked))
        del asked
        counts = np.concatenate([_from_planes(r["counts"]) for r in rows]).astype(np.int64)
        key = c.astype(U8)
        key <<= U8(32)
        key |= w.view(np.uint32)
        del w
        known, where = distinct(key)
        del key
        total = np.bincount(where, weights=counts, minlength=len(known)).astype(np.int64)
        seen = total > 0
        context, word = (known >> U8(32)).astype(np.int64)[seen], vocab[(known & U8(0xFFFFFFFF)).astype(np.int64)[seen]]
        sums = _context_sums(context, len(contexts), word, total[seen], uni)
        b = rows[0]["bucket"]
        out = [(b, None, _planes(contexts[context]) + _planes(word), _planes(total[seen]), binary(np.bincount(np.minimum(total[seen], TOP + 2), minlength=TOP + 3).astype(np.int64)))]
        split = uni.parts(contexts) > 1
        if split.any():
            out.append((b, -1, binary(contexts[split]), None, binary(sums[split])))
        at = 0
        for r, size in zip(rows, sizes):
            n = total[where[at : at + size]]
            missing = np.unique(c[at : at + size][n == 0])
            missing = missing[~split[missing]]
            out.append((b, r["chunk"], binary(contexts[missing]), _planes(n), binary(sums[missing])))
            at += size
        return _table(out)

    return bucket


_SUMS = [f"s{i}" for i in range(TOP + 2)]


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            sums = np.frombuffer(r["extra"], float).reshape(-1, TOP + 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["grams"], np.int64)), *(pa.array(s) for s in sums.T)], names=["h", *_SUMS])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(uni: Unigrams, split: tuple[np.ndarray, np.ndarray], d: np.ndarray):
    """split: contexts dealt in parts and their summed rows of _context_sums."""

    def rows(table: pa.Table, told: pa.Table) -> pa.Table:
        words_told, pairs_told = ({a["bucket"]: a for a in _each(told) if a["pair"] == pair} for pair in (False, True))
        words_told = {g: a["grams"] for g, a in words_told.items()}
        out = []
        for r in _each(table):
            chunk = Chunk(r, words_told, uni.buckets)
            seen = np.zeros(len(chunk.word), np.int64)
            contexts, sums = [split[0]], [split[1]]
            for g, p in _deal(uni.pair_bucket(chunk.context, chunk.word), uni.buckets):
                seen[p] = _from_planes(pairs_told[g]["counts"]).astype(np.int64)
                contexts.append(np.frombuffer(pairs_told[g]["grams"], U8))
                sums.append(np.frombuffer(pairs_told[g]["extra"], float).reshape(-1, TOP + 2))
            contexts, sums = np.concatenate(contexts), np.concatenate(sums)
            order = np.argsort(contexts)
            contexts, sums = contexts[order], sums[order]
            of = uni.count(contexts).astype(float)
            taken = (sums[:, :TOP] * (d[1:] * np.arange(1, TOP + 1))).sum(axis=1) + (1 - REST) * sums[:, TOP]
            back = np.where(of > 0, (1 - taken / np.maximum(of, 1)) / (1 - sums[:, TOP + 1]), 1.0)
            p = np.where(seen <= TOP, d[np.minimum(seen, TOP)], 1 - REST) * seen / np.maximum(uni.count(chunk.context), 1)
            unseen = np.flatnonzero(seen == 0)
            if len(unseen):
                p[unseen] = uni.p(chunk.word[unseen]) * back[np.searchsorted(contexts, chunk.context[unseen])]
            add = lambda x: pa.array(np.add.reduceat(x, chunk.first))
            lone = chunk.place < 0
            log = np.empty(len(chunk.at))
            log[~lone] = np.log10(p)[chunk.place[~lone]]
            log[lone] = np.log10(uni.p(chunk.number))[chunk.at[lone]]
            score = add(log)
            del log
            c = uni.count(chunk.number)
            base = add(np.log10((c + 1) / (uni.total + uni.known + 1))[chunk.at])
            known = add((c > 0).astype(np.int64)[chunk.at])
            ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=(chunk.flags & 2) == 2)
            out.append(pa.RecordBatch.from_arrays(
                [ids, pa.array((chunk.flags & 1) == 0), pa.array(chunk.size.astype(np.int64)), known, pa.array(np.full(len(chunk.size), uni.total)), base, score],
                schema=_SCORES_ARROW,
            ))
        return pa.Table.from_batches(out, _SCORES_ARROW)

    return rows


def katz_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text).

    The model learns from the rows where ``held_out`` is false (null counts as true). Tokens are the
    words, A-Z lower-cased, and one end for each text; a text starts in a context of its own. score is
    the log10 probability of the text, base_score that of the add-one unigram model. Null and empty
    texts are one end token. Every row gives a row, repeated ones too; null doc_ids stay null. An empty
    table gives an empty result; without training rows every token has the probability 1.
    """
    spark = docs.sparkSession
    stash, buckets = Stash(spark), min(buckets_for(spark), MOST_BUCKETS)
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(~held_out, F.lit(False)).alias("train"))
    chunks = stash.put_bucketed(wide.mapInArrow(_chunks, _CHUNK), "chunks", "chunk", buckets // 2)

    asked = chunks.select("chunk", "vocab", "counts").mapInArrow(_ask_words(buckets), "bucket int, chunk long, grams binary, counts binary")
    unigrams = stash.put(asked.groupBy("bucket").applyInArrow(lambda table: release(_count_words(table)), _ANSWER), "unigrams")
    sizes = [np.frombuffer(r["extra"], np.int64) for r in unigrams.where("chunk is null").select("extra").collect()]  # ten numbers for each bucket
    uni = Unigrams(sum(sizes, np.zeros(TOP + 5, np.int64)), buckets)

    told = unigrams.where("chunk is not null")
    ask, count = _ask_pairs(uni), _count_pairs(uni)
    asked = chunks.select("chunk", "vocab", "tokens", "sizes", "flags").groupBy("chunk").cogroup(told.select("chunk", "bucket", "grams").groupBy("chunk")).applyInArrow(lambda chunk, told: release(ask(chunk, told)), _PAIRS)
    bigrams = stash.put(asked.groupBy("bucket").applyInArrow(lambda table: release(count(table)), _ANSWER), "bigrams")
    numbers = sum((np.frombuffer(r["extra"], np.int64) for r in bigrams.where("chunk is null").select("extra").collect()), np.zeros(TOP + 3, np.int64))
    parts = bigrams.where("chunk = -1").select("grams", "extra").mapInArrow(_split_sums, "h long, " + ", ".join(f"{c} double" for c in _SUMS))
    split = parts.groupBy("h").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect()  # contexts with a share of 1 / (4 x buckets), so 4 x buckets at most
    split = np.array([r["h"] for r in split], np.int64).view(U8), np.array([[r[c] for c in _SUMS] for r in split], float).reshape(-1, TOP + 2)
    told = told.withColumn("pair", F.lit(False)).unionByName(bigrams.where("chunk >= 0").withColumn("pair", F.lit(True)))
    score = _scores(uni, split, discounts(numbers))
    return chunks.drop("counts").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda chunk, told: release(score(chunk, told)), _SCORES)
