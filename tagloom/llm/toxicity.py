"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else, labelled harmless or not labelled at all,
is unlabelled. With the class prior p the risk of a classifier f is
``p * R+(f on positives) + max(0, R-(f on unlabelled) - p * R-(f on positives))``; when the second
part falls below zero the step goes the other way, so that it can't overfit. The classifier is
linear in the presence of words and of the first bytes of longer ones, fitted in numpy on a bounded
sample. Which of them tell most is counted on the executors; the driver gets one bit for each of
those and each sampled text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, U8, Stash, binary, slices, span_hashes

BITS = 20
#: Of words longer than so many bytes their beginnings count as well.
PREFIXES = (4, 5, 6, 7)
#: A word is a run of ASCII letters and bytes of longer UTF-8 characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of letters."""
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | cut[1:-1]
    end[:-1] &= ~letter[1:] | cut[1:-1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(offsets, first, side="right") - 1


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each lower-cased run of letters."""
    if not len(data):
        return np.zeros(0, U8), np.zeros(0, np.int64)
    first, end, row = _spans(data, offsets)
    return span_hashes(LOWER[data], first, end), row


def word_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of the words and beginnings of words of each row, in the order of rows."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    first, end, row = _spans(data, offsets)
    starts, ends, rows = [first], [end], [row]
    for n in PREFIXES:
        long = end - first > n
        starts.append(first[long])
        ends.append(first[long] + n)
        rows.append(row[long])
    hashes = span_hashes(LOWER[data], np.concatenate(starts), np.concatenate(ends))
    # a word and an equal beginning of a longer one are told apart
    hashes ^= np.repeat(np.array([0] + [1] * len(PREFIXES), U8) << U8(63), [len(x) for x in starts])
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return (hashes >> U8(64 - BITS)).astype(np.int32)[order], rows[order]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        bins, row = word_bins(data, offsets)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        packed = [binary(np.unique(bins[cuts[i] : cuts[i + 1]])) for i in range(len(offsets) - 1)]
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("positive")), pa.array(packed, pa.binary())], names=["positive", "bins"])


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sampled texts of either side have each bin."""
    for batch in batches:
        total = np.zeros((2, 1 << BITS), np.int64)
        for positive, bins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[int(positive)][np.frombuffer(bins, np.int32)] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[1][used]), pa.array(total[0][used])], names=["bin", "p", "u"])


def _chosen(used: np.ndarray):
    """One bit for each of the chosen bins."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [binary(np.packbits(np.isin(used, np.frombuffer(b, np.int32), assume_unique=True))) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["positive", "bits"])

    return rows


def nn_pu_fit(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative PU risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    owner, column = np.nonzero(x)
    start = np.searchsorted(owner, np.arange(len(x) + 1))

    def batch(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(columns, row in the batch) of the set features of some rows, and how many rows they are."""
        k = rng.choice(side, min(len(side), 1024), replace=False)
        n = start[k + 1] - start[k]
        at = np.repeat(start[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return column[at], np.repeat(np.arange(len(k)), n), len(k)

    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        (cp, rp, kp), (cu, ru, ku) = batch(p), batch(u)
        sp, su = (1 / (1 + np.exp(-np.clip(np.bincount(r, weights=w[c], minlength=k) + b, -30, 30))) for c, r, k in ((cp, rp, kp), (cu, ru, ku)))
        gp, gu = sp * (1 - sp) / kp, su * (1 - su) / ku
        negative = su.mean() - prior * sp.mean()
        up, uu = (np.append(np.bincount(c, weights=g[r], minlength=len(w)), g.sum()) for c, r, g in ((cp, rp, gp), (cu, ru, gu)))
        out = uu - prior * up
        grad = out - prior * up if negative >= 0 else -out
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = 3000, unlabelled: int = 9000, features: int = 3072, prior: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(bins of the used words, weights, bias).

    At most ``positives`` confirmed toxic and ``unlabelled`` other texts are fitted, taken by a hash of
    doc_id from the rows where ``learn`` holds; ``prior`` is by default the toxic share of the labels.
    The ``features`` words and beginnings whose frequency differs most between the two are used.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    marked = labels.where(learn & F.col("doc_id").isNotNull())
    share = marked.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("p")).first()["p"]
    prior = min(0.9, max(1e-4, share or 0.0)) if prior is None else prior
    sure = marked.where("toxic = 1").select("doc_id", order.alias("_o")).distinct().orderBy("_o").limit(positives).select("doc_id", F.lit(True).alias("_sure"))
    total = docs.count()
    some = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < int(min(1.0, unlabelled / max(total, 1)) * (1 << 30))
    rows = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(sure), "doc_id", "left")  # at most `positives` ids
    rows = rows.where(F.col("_sure") | some).select("text", F.coalesce("_sure", F.lit(False)).alias("positive"))
    none = np.zeros(0, np.int64), np.zeros(0), -20.0
    sampled = Stash(docs.sparkSession).put(rows.mapInArrow(_sample_rows, "positive boolean, bins binary"), "sample")
    sides = {r["positive"]: r["count"] for r in sampled.groupBy("positive").count().collect()}
    if len(sides) < 2:
        return none
    counts = sampled.mapInArrow(_bin_counts, "bin int, p long, u long").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    gap = F.abs(F.sqrt(F.col("p") / sides[True]) - F.sqrt(F.col("u") / sides[False]))
    used = np.sort(np.array([r["bin"] for r in counts.orderBy(F.desc(gap), "bin").limit(features).collect()], np.int32))
    seen = sampled.mapInArrow(_chosen(used), "positive boolean, bits binary").collect()
    positive = np.array([r["positive"] for r in seen], bool)
    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in seen), np.uint8).reshape(len(seen), -1), axis=1)[:, : len(used)].astype(bool)
    return (used, *nn_pu_fit(x, positive, prior))


def _score(used: np.ndarray, weights: np.ndarray, bias: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch, data, offsets in slices(batches):
            bins, row = word_bins(data, offsets)
            at = place[bins]
            flags = np.zeros((len(offsets) - 1, len(used)), bool)
            flags[row[at >= 0], at[at >= 0]] = True
            score = 1 / (1 + np.exp(-np.clip(flags @ weights + bias, -30, 30)))
            keep = [c for c in batch.schema.names if c not in ("text", "score")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(score)], names=[*keep, "score"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teach where ``learn`` holds. Null and empty texts are scored as texts
    without words; without a confirmed toxic text every score is next to 0. Every row gives a row,
    repeated ones too; null doc_ids stay null.
    """
    model = fit(docs, labels, learn, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(*model), f"doc_id {kind}, score double")
