"""Ranked lexical search by Fagin's threshold algorithm over an index in shards of documents.

A shard holds whole documents: each one's terms and how often they occur. With the corpus statistics
every pair of term and document has an impact, a whole number. For a query a shard reads the lists of
its terms by falling impact in turn, looks up the full score of each document that it meets for the
first time in the document's own row, and stops when what the lists could still give to a document not
yet met falls below the score of the k-th best. The shards' best meet in one ranking by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, Stash, binary, one_row_per_id, slices, words

#: Text of a shard in bytes, about.
SHARD_BYTES = 24 << 20
#: Entries that a list gives at its first turn, and at most; each turn doubles them.
FIRST_TURN, LONGEST_TURN = 16, 1024

TERM = np.zeros(256, bool)
TERM[128:] = True
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    TERM[_a:_z] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a run of texts (ASCII letters lower-cased), and the row of each.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
    """
    inside = TERM[data]
    first, end, row = words(data, offsets, inside)
    places = np.zeros(len(first) + 1, np.int64)
    np.cumsum(end - first, out=places[1:])
    packed = LOWER[data[inside]]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode(), row


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


INDEX = "shard long, documents long, occurrences long, doc_ids array<long>, lengths binary, sizes binary, terms array<binary>, pairs long, codes binary, counts binary"


def _build(shard_bytes: int):
    def shard(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, lengths, sizes, codes, counts, dictionaries = zip(*parts)
        together = pa.concat_arrays(dictionaries).unique()
        codes = [pc.index_in(d, together).to_numpy()[c] if len(c) else c for d, c in zip(dictionaries, codes)]
        length, size, code, count = (np.concatenate(x).astype(np.int64) for x in (lengths, sizes, codes, counts))
        own = [number, int((length > 0).sum()), int(length.sum()), pa.concat_arrays(ids), binary(_narrow(length)), binary(_narrow(size)), together.cast(pa.binary()), len(code), binary(_narrow(code)), binary(_narrow(count))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.binary()]
        one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if pa.types.is_list(t) else pa.array([v], t)
        return pa.RecordBatch.from_arrays([one(v, t) for v, t in zip(own, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch, data, offsets in slices(batches):
            coded, row = terms_of(data, offsets)
            n = max(1, len(coded.dictionary))
            pair, count = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
            docs = len(offsets) - 1
            parts.append((batch.column(0), np.bincount(row, minlength=docs), np.bincount(pair // n, minlength=docs), pair % n, count, coded.dictionary))
            held += len(data)
            if held >= shard_bytes:
                yield shard(number, parts)
                number, parts, held = number + 1, [], 0
        if parts:
            yield shard(number, parts)

    return rows


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of about ``shard_bytes`` of text of ``docs`` (doc_id, text), in no set order; a shard is a row, and every document is in one.

    Null texts are empty and hold no term. Write it before use, as a search reads it twice.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_build(shard_bytes), INDEX)


class Shard:
    """The postings of one shard for some terms: lists by falling impact, and rows by document."""

    def __init__(self, row: dict, terms: pa.Array, documents: int, occurrences: int) -> None:
        self.ids = row["doc_ids"]
        docs, pairs = len(self.ids), row["pairs"]
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.place = np.lexsort((self.ids.fill_null(0).to_numpy(), ~known)).argsort()  # the rows' order among equal scores
        own = pc.fill_null(pc.index_in(row["terms"], terms), -1).to_numpy(zero_copy_only=False)
        term = own[_wide(row["codes"], pairs)] if pairs else np.zeros(0, np.int64)
        wanted = term >= 0
        doc = np.repeat(np.arange(docs), _wide(row["sizes"], docs))[wanted]
        term, tf = term[wanted], _wide(row["counts"], pairs)[wanted]
        length = _wide(row["lengths"], docs)
        if 50 * documents * int(length.max(initial=0)) >= 1 << 63:
            length = length.astype(object)
        m = (100 - 50 + (50 * length * documents) // occurrences).astype(np.int64)
        self.term, self.impact = term, (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        self.row_ends = np.cumsum(np.bincount(doc, minlength=docs))
        order = np.lexsort((-self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_ends = np.cumsum(np.bincount(term, minlength=len(terms)))
        self.list_starts = np.concatenate([[0], self.list_ends[:-1]])
        self.row_starts = np.concatenate([[0], self.row_ends[:-1]])

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The full scores of documents, by their rows; none of them is without a term."""
        size = self.row_ends[docs] - self.row_starts[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.row_starts[docs] - (ends - size), size) + np.arange(int(ends[-1]))
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], ends - size)

    def best(self, query: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, rows looked up) of the k best documents for the terms ``query``, best first.

        ``weight`` has the terms' weights, 0 for those that are not in the query.
        """
        start, end = self.list_starts[query], self.list_ends[query]
        start, end, w = start[end > start], end[end > start], weight[query][end > start]
        met = np.zeros(len(self.ids), bool)
        rows, score, turn = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST_TURN
        while len(start):
            stop = np.minimum(start + turn, end)
            size = stop - start
            ends = np.cumsum(size)
            fresh = np.zeros(len(met), bool)
            fresh[self.list_doc[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))]] = True
            new = np.flatnonzero(fresh & ~met)
            if len(new):
                met[new] = True
                rows, score = np.concatenate([rows, new]), np.concatenate([score, self.scores(new, weight)])
                order = np.lexsort((self.place[rows], -score))[:k]
                rows, score = rows[order], score[order]
            more = stop < end
            start, end, w = stop[more], end[more], w[more]
            threshold = int((w * self.list_impact[start]).sum())
            if len(rows) == k and threshold < score[-1]:
                break
            turn = min(2 * turn, LONGEST_TURN)
        return rows, score, int(met.sum())


def query_terms(texts: list[str | None]) -> list[list[bytes]]:
    """The distinct terms of each text, sorted."""
    raw = [(t or "").encode() for t in texts]
    coded, row = terms_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    names = coded.dictionary.to_pylist()
    found: list[set[bytes]] = [set() for _ in raw]
    for r, c in zip(row.tolist(), coded.indices.to_pylist()):
        found[r].add(names[c])
    return [sorted(f) for f in found]


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: v[i].values if isinstance(v[i], pa.ListScalar) else v[i].as_py() for c, v in zip(batch.schema.names, batch.columns)}


def _frequencies(terms: pa.Array):
    """How many documents hold each term, a row for each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _shard_rows(batches):
            own = pc.fill_null(pc.index_in(row["terms"], terms), -1).to_numpy(zero_copy_only=False)
            held = np.bincount(_wide(row["codes"], row["pairs"]), minlength=len(own))
            total[own[own >= 0]] += held[own >= 0]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["held"])

    return rows


def _search(items: list[tuple[int, np.ndarray]], terms: pa.Array, weights: np.ndarray, documents: int, occurrences: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _shard_rows(batches):
            shard, weight = Shard(row, terms, documents, occurrences), np.zeros(len(terms), np.int64)
            for item_id, query in items:
                weight[query] = weights[query]
                found, score, _ = shard.best(query, weight, k)
                weight[query] = 0
                found, score = found[score > 0], score[score > 0]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(found), pa.int64()), shard.ids.take(pa.array(found)), pa.array(score)], names=["item_id", "doc_id", "score"])

    return rows


def ranked_search(index: DataFrame, items: DataFrame, k: int = 50, block_chars: int = 2 << 20) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of ``index`` that score highest for each row of ``items`` (item_id, text).

    With N documents that have a term, L terms in all and n in the document, a term that df documents hold
    weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); the score sums w * (10^9 tf div (1000 tf + 20 m))
    over the item's distinct terms, where m = 50 + (50 n N div L). Documents without score give no row.

    Equal scores rank by ascending doc_id, documents without one last; rows that repeat a doc_id rank each
    for itself. Items without item_id are left out; of rows that repeat one the one with the greatest text counts.
    Items without a term, empty tables and texts give no rows. Items are dealt by a hash to blocks of about
    ``block_chars`` characters; one block at a time goes to the executors and is held against all shards.
    """
    spark = items.sparkSession
    schema = "item_id long, doc_id long, score long"
    asked = one_row_per_id(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item_id").where("text is not null")
    totals = index.agg(F.sum("documents"), F.sum("occurrences")).first()
    documents, occurrences = (int(t or 0) for t in totals)
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-2 * chars // block_chars) if chars > block_chars else 1
    out = None
    for b in range(blocks if documents else 0):
        texts = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about half of block_chars, or all if less than that
        queries = query_terms([r["text"] for r in texts])
        terms = sorted({t for q in queries for t in q})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        held = index.select("terms", "pairs", "codes").mapInArrow(_frequencies(pa.array(terms, pa.binary())), "held array<long>")
        df = {r["i"]: r["n"] for r in held.select(F.posexplode("held").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        block = [(r["item_id"], np.array([number[t] for t in q], np.int64)) for r, q in zip(texts, queries)]
        found = index.drop("shard", "documents", "occurrences").mapInArrow(_search(block, pa.array(terms, pa.binary()), weights, documents, occurrences, k), schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``ranked_search`` over an index of ``docs`` that is written to the shared folder first."""
    return ranked_search(Stash(docs.sparkSession).put(build_index(docs), "index"), items, k)


#: The same ranking in DuckDB, by scoring every document that holds a term.
SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * n.n + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * p.n * n.n) // n.l))))::BIGINT AS score
  FROM w JOIN p USING (term), n GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""
