"""Token ids of documents in binary files, as a Spark data source.

``token_ids`` is a format for ``DataFrame.write`` and ``spark.read``: a folder of shards and a manifest.
A shard holds the ids of a run of documents, one after another, in 16 bits each if the vocabulary allows
or else 32, then the documents' ends and doc_ids as Elias-Fano sequences and a footer. Shards are written
by tasks under names of their own; the manifest, written last, says which count and in which order, so a
task that runs twice or is lost leaves nothing that readers see. Readers take runs of documents, whose
bytes they find by select.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tagloom.llm.common import binary, buckets_for, slices
from tagloom.llm.elias_fano import EliasFano
from tagloom.llm.word_pieces import TextEncoder

MAGIC = b"TLID"
#: width of an id in bytes, documents, ids, documents without doc_id (they come first), least doc_id, bytes of the two sequences
_FOOTER = struct.Struct("<BQQQqQQ4s")
MANIFEST = "manifest.json"
#: A reader's task takes about so many bytes of ids.
SPLIT_BYTES = 32 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (``file:/a``, ``hdfs://...``, ``s3://...`` or plain)."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    order: int
    name: str
    documents: int
    ids: int


class TokenWriter(DataSourceArrowWriter):
    """Encodes the texts of one task's rows, which come in the order of their doc_ids, and writes them as a shard."""

    def __init__(self, path: str, definition: str, end_id: int, text_at: int, id_at: int) -> None:
        self.path, self.definition, self.end_id, self.text_at, self.id_at = path, definition, end_id, text_at, id_at

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        encoder = TextEncoder.of(self.definition)
        kind = np.dtype("<u2" if max(encoder.largest, self.end_id) < 1 << 16 else "<u4")
        store, root = file_system(self.path)
        order = TaskContext.get().partitionId()
        name = f"shard-{order:06d}-{uuid.uuid4().hex}.ids"
        sizes, ids, nulls = [], [], 0
        try:
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(MAGIC)
                for batch in iterator:
                    pair = pa.RecordBatch.from_arrays([batch.column(self.id_at), batch.column(self.text_at)], names=["doc_id", "text"])
                    for rows, data, offsets in slices(iter([pair])):
                        tokens, size = encoder.encode(data, offsets)
                        ends = np.cumsum(size + 1)
                        whole = np.empty(int(ends[-1]), kind)
                        whole[ends - 1] = self.end_id
                        inside = np.ones(len(whole), bool)
                        inside[ends - 1] = False
                        whole[inside] = tokens
                        out.write(binary(whole))
                        sizes.append(size + 1)
                        known = rows.column(0).drop_null()
                        nulls += len(rows.column(0)) - len(known)
                        ids.append(known.to_numpy(zero_copy_only=False).astype(np.int64))
                self._end(out, kind.itemsize, np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.int64), *ids]), nulls)
        except BaseException:
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                store.delete_file(f"{root}/{name}")
            raise
        n = sum(map(len, sizes))
        if not n:
            store.delete_file(f"{root}/{name}")
        return Written(order, name, n, int(sum(s.sum() for s in sizes)))

    @staticmethod
    def _end(out: pa.NativeFile, width: int, sizes: np.ndarray, ids: np.ndarray, nulls: int) -> None:
        if (ids[1:] < ids[:-1]).any():
            raise ValueError("rows have to come in ascending order of doc_id")
        total = int(sizes.sum())
        ends = EliasFano.encode(np.cumsum(sizes), total + 1)
        least = int(ids[0]) if len(ids) else 0
        keys = EliasFano.encode(ids.astype(np.uint64) - np.uint64(least % (1 << 64)), int(ids[-1]) - least + 1 if len(ids) else 1)
        out.write(ends + keys + _FOOTER.pack(width, len(sizes), total, nulls, least, len(ends), len(keys), MAGIC))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        shards = [{"name": m.name, "documents": m.documents, "ids": m.ids} for m in sorted((m for m in messages if m and m.documents), key=lambda m: m.order)]
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}.new", compression=None) as out:
            out.write(json.dumps({"shards": shards}).encode())
        store.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        for m in messages:
            if m and m.documents:
                store.delete_file(f"{root}/{m.name}")


class Shard:
    """A shard's boundaries; ids are read when asked for."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        self.width, self.n, self.total, self.nulls, self.least, ends, keys, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = size - _FOOTER.size - ends - keys
        tail = np.frombuffer(file.read_at(ends + keys, at), np.uint8)
        self.ends, self.keys = EliasFano(tail[:ends]), EliasFano(tail[ends:])

    def bounds(self, first: int, stop: int) -> np.ndarray:
        """The offsets of documents first to stop, and the end of the last one."""
        return np.concatenate([[0] if first == 0 else [], self.ends.decode(max(0, first - 1), stop).astype(np.int64)]).astype(np.int64)

    def doc_ids(self, first: int, stop: int) -> pa.Array:
        a, z = (max(0, x - self.nulls) for x in (first, stop))
        ids = (self.keys.decode(a, z) + np.uint64(self.least % (1 << 64))).view(np.int64)
        return pa.concat_arrays([pa.nulls(stop - first - (z - a), pa.int64()), pa.array(ids)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


@dataclass
class Run(InputPartition):
    name: str
    first: int
    stop: int
    before: int  # ids of all shards before


def _column(name: str, shard: Shard, first: int, stop: int, bounds: np.ndarray, before: int, ids: np.ndarray) -> pa.Array:
    if name == "doc_id":
        return shard.doc_ids(first, stop)
    if name == "start":
        return pa.array(before + bounds[:-1])
    if name == "n_tokens":
        return pa.array(np.diff(bounds))
    own = bounds - bounds[0]
    if name == "ids_crc32":
        return pa.array([zlib.crc32(ids[a:z].tobytes()) for a, z in zip(own, own[1:])], pa.int64())
    if name == "ids":
        return pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(ids.astype(np.int32)))
    raise ValueError(f"no column {name}; there are {', '.join(TokenIds.COLUMNS)}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[Run]:
        store, root = file_system(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}", compression=None) as file:
            shards = json.loads(file.read())["shards"]
        runs, before = [], 0
        for s in shards:
            parts = max(1, -(-4 * s["ids"] // SPLIT_BYTES))
            cuts = sorted({s["documents"] * i // parts for i in range(parts + 1)})
            runs += [Run(s["name"], a, z, before) for a, z in zip(cuts, cuts[1:])]
            before += s["ids"]
        return runs or [Run("", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.name:
            return
        store, root = file_system(self.path)
        with store.open_input_file(f"{root}/{run.name}") as file:
            shard, at = Shard(file), run.first
            while at < run.stop:  # batches of at most 4 M ids, or one document
                bounds = shard.bounds(at, min(run.stop, at + 4096))
                n = max(1, int(np.searchsorted(bounds, bounds[0] + (1 << 22), side="right")) - 1)
                bounds = bounds[: n + 1]
                ids = shard.ids(int(bounds[0]), int(bounds[-1])) if {"ids", "ids_crc32"} & {*self.columns} else np.zeros(0, "<u4")
                yield pa.RecordBatch.from_arrays([_column(c, shard, at, at + n, bounds, run.before, ids) for c in self.columns], names=self.columns)
                at += n


class TokenIds(DataSource):
    """The format ``token_ids``. Options to write: path, tokenizer (a file), end_id; columns of rows: doc_id and text."""

    COLUMNS = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>", "ids_crc32": "long"}

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        store, root = file_system(self.options["path"])
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            raise FileExistsError(f"{root} holds token ids")
        store.create_dir(root, recursive=True)
        with open(self.options["tokenizer"], encoding="utf-8") as file:
            return TokenWriter(self.options["path"], file.read(), int(self.options["end_id"]), schema.names.index("text"), schema.names.index("doc_id"))


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of all texts of ``docs`` (doc_id, text) to the new folder ``path`` in ascending order of doc_id.

    Each document's ids end with ``end_id``. Null texts are empty, so that their only id is that one.
    Rows without doc_id come first; rows that repeat a doc_id stand beside each other, each for itself,
    in the order of a hash of their texts, so that one id with many rows can be divided among shards. An
    empty table gives a manifest without shards. Other columns don't matter.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ordered = wide.repartitionByRange(buckets_for(spark, 1), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.write.format("token_ids").option("tokenizer", tokenizer).option("end_id", str(end_id)).mode("append").save(path)


def read_token_ids(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents of a folder that ``write_token_ids`` made: doc_id, start (ids of all documents before it), n_tokens, ids, or ids_crc32 of the ids as 32-bit numbers."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").schema(", ".join(f"{c} {TokenIds.COLUMNS[c]}" for c in columns)).load(path)
