"""Pairs within a time window whose number is far above that of the rows: found and told run by run in a task, never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.sources.sinks import settle

#: About how many pairs are held at a time.
PAIRS = 1_000_000


def _blocks(x: DataFrame, y: DataFrame, by: list[str], who: str, earlier: int, later: int) -> DataFrame:
    """Rows of x and y (``by``, who, ...) for each pair of their blocks by ``who``, of about ``earlier`` and ``later`` rows."""
    count = lambda f, size, name: f.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    n = count(x, earlier, "_x").join(count(y, later, "_y"), by)
    own = lambda c: F.pmod(F.xxhash64(who), F.col(c)).cast("int")
    other = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x, y = x.join(n, by).withColumn("xb", own("_x")).withColumn("yb", other("_y")), y.join(n, by).withColumn("xb", other("_x")).withColumn("yb", own("_y"))
    return x.drop("_x", "_y").withColumn("left", F.lit(True)).unionByName(y.drop("_x", "_y").withColumn("left", F.lit(False)))


def _runs(counts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that make about PAIRS pairs, cut at ``ends`` only."""
    total, start = np.cumsum(counts), 0
    while start < len(counts):
        before = total[start - 1] if start else 0
        at = np.searchsorted(total, before + PAIRS, "right")
        at = ends[min(np.searchsorted(ends, max(at, start + 1)), len(ends) - 1)]
        yield start, at
        start = at


def _places(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i all j of low[i] <= j < high[i]."""
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _follow(gap: int):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        section, kind = t["section"][0], t.schema.field("who").type
        left, who, at = (t[c].to_numpy() for c in ("left", "who", "at"))
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = x[np.argsort(who[x], kind="stable")], y[np.argsort(at[y], kind="stable")]
        reader, other, start = who[x], who[y], at[y]
        low, high = np.searchsorted(start, at[x], "right"), np.searchsorted(start, at[x] + gap, "right")
        ends = np.flatnonzero(np.append(reader[1:] != reader[:-1], True)) + 1
        for a, z in _runs(high - low, ends):  # a reader's rows are in one run, so that each pair is told once
            i, j = _places(low[a:z], high[a:z])
            names, code = np.unique(reader[a:z], return_inverse=True)
            others, place = np.unique(other[j], return_inverse=True)
            pairs = np.unique(code[i] * len(others) + place)
            p, q = names[pairs // max(len(others), 1)], others[pairs % max(len(others), 1)]
            p, q = p[p != q], q[p != q]
            yield pa.RecordBatch.from_arrays([pa.array(p, kind), pa.array(q, kind), pa.repeat(section, len(p))], names=["a_user", "b_user", "section"])

    return group


def followers(spans: DataFrame, minutes: int = 20, block: int = 400_000) -> DataFrame:
    """a_user, b_user, section, distinct: another's span (user_id, section, a, z) starts within ``minutes`` after one of a user ended."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at")
    t = settle(spans.select(F.col("user_id").alias("who"), "section", "a", "z").where("user_id is not null and section is not null"))
    met = _blocks(t.select("section", "who", micros("z")), t.select("section", "who", micros("a")), ["section"], "who", block, block)
    kind = spans.schema["user_id"].dataType.simpleString()
    return met.groupBy("section", "xb", "yb").applyInArrow(_follow(minutes * 60_000_000), f"a_user {kind}, b_user {kind}, section string")


def _go_on(least: int):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        kind, ids = t.schema.field("id").type, t["id"].combine_chunks()
        left, first, last = (t[c].to_numpy() for c in ("left", "first", "last"))
        sets: dict[tuple, int] = {}
        code = np.array([sets.setdefault(tuple(m), len(sets)) for m in t["majors"].to_pylist()], np.int64)
        kinds = [(len(m), set(m) - {None}) for m in sets]
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        y = y[np.argsort(first[y], kind="stable")]
        low, high = np.searchsorted(first[y], first[x], "right"), np.searchsorted(first[y], last[x], "right")
        high = np.maximum(low, high)
        cx, cy = np.unique(code[x]), np.unique(code[y])
        common = np.array([[len(kinds[a][1] & kinds[b][1]) for b in cy] for a in cx], np.int64).reshape(len(cx), len(cy))
        enough = np.array([kinds[a][0] for a in cx], np.int64)[:, None]
        told = (common > 0) & ((common >= least) | (common == enough))
        xc, yc = np.searchsorted(cx, code[x]), np.searchsorted(cy, code[y])
        for a, z in _runs(high - low, np.arange(1, len(x) + 1)):
            i, j = _places(low[a:z], high[a:z])
            u, v = xc[a:z][i], yc[j]
            keep = told[u, v]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[a:z][i[keep]])), ids.take(pa.array(y[j[keep]])), pa.array(common[u[keep], v[keep]])], names=["earlier", "later", "hits"])

    return group


def going_on(earlier: DataFrame, later: DataFrame, least: int = 3, block: int = 20_000) -> DataFrame:
    """earlier, later, hits: of later threads (id, first, last, majors) that start after an earlier one's first and up to its last, those with ``least`` common majors, or all of the earlier one's.

    Times are microseconds. Threads with the same majors are compared once.
    """
    one = lambda f: f.where("first is not null and last is not null and id is not null and majors is not null").withColumn("all", F.lit(0))
    kind = earlier.schema["id"].dataType.simpleString()
    return _blocks(one(earlier), one(later), ["all"], "id", block, 5 * block).groupBy("xb", "yb").applyInArrow(_go_on(least), f"earlier {kind}, later {kind}, hits long")
