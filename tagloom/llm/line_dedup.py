"""Line deduplication with two Bloom filters.

1. A chunk of documents keeps the 128-bit digests of its long lines in a table bucketed by chunk.
2. It sends the first 64 bits, each at most twice, to the hash range they fall in. The range keeps two
   Bloom filters: a hash that the *once-seen* filter already knows enters the *twice-seen* filter.
   What the twice-seen filter knows are suspects, and the range tells each chunk its own.
3. Only suspects are sent for the exact count: by digest, with the chunk's number of documents and
   its largest doc_id. So a line of all documents costs one entry a chunk, and no task gets it once a document.
4. The chunk tells each document which of its lines go.

The filters stay in their range, with ``BITS_PER_LINE`` bits for each hash that came; nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tagloom.llm.common import LOWER, SPACE, U8, Stash, binary, buckets_for, mix, slices

BITS_PER_LINE, PROBES = 16, 4
CHUNK_BYTES = 12 << 20
_LEAD = (np.arange(256) & 0xC0) != 0x80
OUTPUTS = ("kept_text", "n_lines", "n_dropped", "kept_sha256")


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first, end and code points of the key of each line: stripped."""
    rows = np.arange(len(offsets) - 1)
    newline = np.flatnonzero(data == 10)
    row = np.concatenate([rows, np.searchsorted(offsets, newline, side="right") - 1])
    first, stop = np.concatenate([offsets[:-1], newline + 1]), np.concatenate([offsets[1:], newline])
    first, stop, row = first[np.lexsort((first, row))], stop[np.lexsort((stop, row))], np.sort(row)
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, first), np.searchsorted(solid, stop)
    some = b > a
    key_first, key_end = np.where(some, solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else 0, first), np.where(some, solid[b - 1] + 1 if len(solid) else 0, first)
    lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
    return row, key_first, key_end, lead[key_end] - lead[key_first]


def digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The 16-byte digest of each key, A-Z lower-cased."""
    text, digest = LOWER[data].tobytes(), hashlib.blake2b
    return [digest(text[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist())]


def _halves(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(keys, U8).reshape(-1, 2)
    return both[:, 0], both[:, 1]


_CHUNK = "chunk long, ids binary, counts binary, keys binary"


def _chunks(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, counts, keys, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            cols = [binary(np.concatenate(ids)), binary(np.concatenate(counts).astype(np.int32)), b"".join(keys)]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c], pa.binary()) for c in cols)], names=["chunk", "ids", "counts", "keys"])

        for part, data, offsets in slices(batches):
            row, first, end, points = line_keys(data, offsets)
            long = points >= least
            row, own = row[long], digests(data, first[long], end[long])
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            sets = [list(dict.fromkeys(own[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            ids.append(part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64))
            counts.append(np.array([len(s) for s in sets]))
            keys += [k for s in sets for k in s]
            held += len(data)
            if held >= CHUNK_BYTES:
                yield packed()
                number += 1
                ids, counts, keys, held = [], [], [], 0
        if ids:
            yield packed()

    return rows


def _deal(of: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, positions) of each group that occurs."""
    order = np.argsort(of.astype(np.uint32), kind="stable")
    cuts = np.searchsorted(of[order], np.arange(n + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        yield int(g), order[cuts[g] : cuts[g + 1]]


def _ask_hashes(ranges: int):
    """The hashes of a chunk, each at most twice, for their ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h = np.sort(_halves(r["keys"])[0])
                third = np.zeros(len(h), bool)
                third[2:] = h[2:] == h[:-2]
                h = h[~third]
                got = [(g, r["chunk"], binary(h[p])) for g, p in _deal(h % U8(ranges), ranges)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.binary()))], names=["range", "chunk", "hashes"])

    return rows


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES x hashes places in a filter of ``bits`` (a power of two) bits."""
    h, step = mix(h), mix(h + U8(77)) | U8(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + U8(i) * step) & U8(bits - 1) for i in range(PROBES)]).astype(np.int64)


class Filter:
    """A Bloom filter of packed bits."""

    def __init__(self, bits: int) -> None:
        self.size, self.bits = bits, np.zeros(bits >> 3, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at = probes(h, self.size).ravel()
        np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = probes(h, self.size)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _suspects(table: pa.Table) -> pa.Table:
    """For each chunk those of its hashes of a range that the twice-seen filter knows."""
    parts = [np.frombuffer(x, U8) for x in table.column("hashes").to_pylist()]
    bits = 1 << max(10, (BITS_PER_LINE * sum(map(len, parts)) - 1).bit_length())
    once, twice = Filter(bits), Filter(bits)
    parts = [np.unique(h, return_counts=True) for h in parts]
    for h, n in parts:
        twice.add(h[(n > 1) | once.has(h)])
        once.add(h)
    found = [h[twice.has(h)] for h, _ in parts]
    keep = [i for i, h in enumerate(found) if len(h)]
    return pa.table({"chunk": table.column("chunk").take(pa.array(keep, pa.int64())), "hashes": pa.array([binary(found[i]) for i in keep], pa.binary())})


def _ask_counts(ranges: int):
    """The suspects of a chunk by digest, with the number of documents and the largest doc_id, for their ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, g = _halves(r["keys"])
                doc = np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int32))
                some = np.isin(h, np.frombuffer(b"".join(r["told"]), U8))
                h, g, doc = h[some], g[some], doc[some]
                order = np.lexsort((doc, g, h))
                h, g, doc = h[order], g[order], doc[order]
                edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
                last = np.append(edge[1:], len(h)) - 1
                n, most, h, g = last - edge + 1, doc[last] if len(h) else doc, h[edge], g[edge]
                got = [(b, r["chunk"], binary(np.stack([h[p], g[p]], axis=1)), binary(n[p].astype(np.int64)), binary(most[p])) for b, p in _deal(h % U8(ranges), ranges)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["range", "chunk", "keys", "n", "most"])

    return rows


def _confirm(least_docs: int):
    """For each chunk those of its digests that enough documents hold, and the document that keeps the line."""

    def count(table: pa.Table) -> pa.Table:
        keys = table.column("keys").to_pylist()
        h, g = _halves(b"".join(keys))
        n, most = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("n", "most"))
        order = np.lexsort((g, h))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        edge = np.flatnonzero(fresh)
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(fresh) - 1
        often = (np.add.reduceat(n[order], edge) >= least_docs)[group]
        keeper = np.maximum.reduceat(most[order], edge)[group]
        chunk, out, at = table.column("chunk").to_pylist(), [], 0
        for c, k in zip(chunk, keys):
            own = np.arange(at, at + len(k) // 16)
            at += len(own)
            own = own[often[own]]
            if len(own):
                out.append((c, binary(np.stack([h[own], g[own]], axis=1)), binary(keeper[own])))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "keys", "keepers"])

    return count


def _drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the digests of the lines that go, for the documents of a chunk that lose lines."""
    for batch in batches:
        for r in batch.to_pylist():
            keeper = {}
            for a in r["told"]:
                k = a["keys"]
                keeper.update(zip((k[i : i + 16] for i in range(0, len(k), 16)), np.frombuffer(a["keepers"], np.int64).tolist()))
            keys, at = r["keys"], 0
            ids, gone = [], []
            for i, n in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["counts"], np.int32).tolist()):
                own = [k for k in (keys[j : j + 16] for j in range(at, at + 16 * n, 16)) if keeper.get(k, i) != i]
                at += 16 * n
                if own:
                    ids.append(i)
                    gone.append(b"".join(own))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.binary())], names=["_id", "drops"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        row, first, end, _ = line_keys(data, offsets)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        drops = rows.column(rows.schema.get_field_index("drops")).to_pylist()
        texts, lines, dropped = [], [], []
        whole = data.tobytes()
        for i, gone in enumerate(drops):
            text = whole[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
            own = slice(cuts[i], cuts[i + 1])
            k = 0
            if gone:
                gone = {gone[j : j + 16] for j in range(0, len(gone), 16)}
                keep = [x not in gone for x in digests(data[offsets[i] : offsets[i + 1]], first[own] - offsets[i], end[own] - offsets[i])]
                text = "\n".join(t for t, ok in zip(text.split("\n"), keep) if ok)
                k = len(keep) - sum(keep)
            texts.append(text)
            lines.append(int(cuts[i + 1] - cuts[i]))
            dropped.append(k)
        sums = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("row")), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums, pa.string())], names=["row", *OUTPUTS])


def _one_document_per_id(named: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id as one text with the lines of all."""
    again = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return named
    joined = named.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_set("text")).alias("text"))
    return named.join(again, "doc_id", "left_anti").unionByName(joined)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row of ``docs`` with kept_text, n_lines (before), n_dropped and kept_sha256.

    A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys of
    at least ``least_chars`` code points that at least ``least_docs`` documents hold lose all their
    lines except in the largest doc_id that holds them. Keys are told apart by a 128-bit digest. Null
    and empty texts are one empty line. Rows without doc_id are kept whole and don't count; rows that
    repeat a doc_id are one document for the counts, each with its own result. Of ``columns`` those
    named like a result, and text, are left out; columns beside them are ignored.
    """
    spark = docs.sparkSession
    stash, ranges = Stash(spark), buckets_for(spark, 1)
    named = _one_document_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null"))
    chunks = stash.put_bucketed(named.mapInArrow(_chunks(least_chars), _CHUNK), "lines", "chunk", ranges)
    asked = chunks.select("chunk", "keys").mapInArrow(_ask_hashes(ranges), "range int, chunk long, hashes binary")
    suspects = asked.groupBy("range").applyInArrow(_suspects, "chunk long, hashes binary")
    told = suspects.groupBy("chunk").agg(F.collect_list("hashes").alias("told"))
    asked = chunks.join(told, "chunk").mapInArrow(_ask_counts(ranges), "range int, chunk long, keys binary, n binary, most binary")
    confirmed = asked.groupBy("range").applyInArrow(_confirm(least_docs), "chunk long, keys binary, keepers binary")
    told = confirmed.groupBy("chunk").agg(F.collect_list(F.struct("keys", "keepers")).alias("told"))
    gone = stash.put(chunks.join(told, "chunk").mapInArrow(_drops, "_id long, drops binary"), "drops")
    kept = [c for c in columns if c not in ("text", *OUTPUTS)]
    wide = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("_key"), F.col("text").cast("string").alias("text"))
    told = wide.join(gone, F.col("_key") == F.col("_id"), "left").select("row", "text", "drops")
    schema = StructType([wide.schema["row"], StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])
    return told.mapInArrow(_rewrite, schema).select("row.*", *OUTPUTS)
