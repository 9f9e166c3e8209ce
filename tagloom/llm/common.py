"""What the text operators share: tables in the cluster's shared folder, Arrow text batches, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once (one longer text is taken whole).
SLICE_BYTES = 2 << 20

U8 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stash:
    """Intermediate tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tagloom-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def put_bucketed(self, frame: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table of the shared folder bucketed by ``key``, so that joins by it leave its rows in place. The catalog forgets it at once."""
        self.count += 1
        table = f"tagloom_{uuid.uuid4().hex}"
        frame.write.option("compression", "zstd").option("path", f"{self.root}/{self.count:03d}-{name}").bucketBy(max(1, buckets), key).saveAsTable(table)
        found = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables of this stash that no later step reads."""
        for frame in frames:
            for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
                if path.split("://")[-1].lstrip("/").startswith(self.root.split(":")[-1].lstrip("/")):
                    target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def other_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column has it (Spark's names ignore case)."""
    taken = [c.lower() for c in taken]
    while name.lower() in taken:
        name += "_"
    return name


def buckets_for(spark: SparkSession, per_partition: int = 2) -> int:
    """Into how many groups packed rows are dealt: a multiple of the shuffle partitions, which follow the data."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def one_row_per_id(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows without a key go; of rows that repeat a key the one with the greatest text stays (null is least)."""
    frame = frame.where(F.col(key).isNotNull())
    again = frame.groupBy(key).count().where("count > 1")
    if again.isEmpty():
        return frame
    keep = frame.join(again.select(key), key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*frame.columns), F.coalesce(F.col(text), F.lit(""))).alias("_row"))
    return frame.join(again.select(key), key, "left_anti").select(*frame.columns).unionByName(keep.select("_row.*"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about SLICE_BYTES of UTF-8 text; null texts count as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        rows = len(column)
        if not rows:
            continue
        _, off, data = column.buffers()
        ends = np.frombuffer(off, np.int64)[column.offset : column.offset + rows + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            to = min(to, rows)
            yield batch.slice(at, to - at), whole[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def _fixed_random(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a rule (the splitmix64 sequence)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U8) * U8(0x9E3779B97F4A7C15) + U8(seed)) | U8(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U8(30))
        x = x * U8(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U8(27))
        x = x * U8(0x94D049BB133111EB)
        return x ^ (x >> U8(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _fixed_random(256, 11)
_BASE = U8(0xD6E8FEB86659FD93)
_BASE_INVERSE = U8(pow(int(_BASE), -1, 1 << 64))
_MULT = _fixed_random(64, 23)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([np.ones(1, U8), np.full(size - 1, base, U8)]))
        if size <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes outside ``[\\x20\\x09-\\x0D]``, or of those that are ``inside``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data] if inside is None else inside
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end[:-1] &= ~word[1:] | cut[1:-1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(offsets, first, side="right") - 1


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    total = np.zeros(n + 1, U8)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
        return mix((total[end] - total[first]) * _power(_BASE_INVERSE, n + 1)[first] + (end - first).astype(U8) * _MULT[60])


def window_hashes(tokens: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first token) of each run of ``size`` tokens within a row."""
    at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.full(len(at), size, U8)
        for j in range(size):
            total += tokens[at + j] * _MULT[j]
    return mix(total), at


def release(out: pa.Table | None = None) -> pa.Table | None:
    """``out``; a worker's free memory, which allocators otherwise keep for the next task, goes back before."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # numpy's memory; only glibc has it
        trim(0)
    return out


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
