"""Quality classification by co-training.

Two logistic classifiers see different views of a document: its text (histograms of character
classes and common words, repetition, line shape) and its metadata (source, language, stated
length). Over some rounds each labels the pool of unlabelled documents, and those it is sure of join
the training rows *of the other*. Both are then calibrated on labelled rows that neither was
fitted to, the calibrated views are combined there, and all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import binary, slices
from tagloom.llm.quality_rules import base_counts, histograms

SOURCE_BINS, LANG_BINS, LENGTH_BINS = 64, 16, 24


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    chars, common = histograms(data, offsets)
    n = base_counts(data, offsets)
    words, size = np.maximum(n["n_words"], 1), np.maximum(chars.sum(axis=1), 1)
    lines = chars[:, 4] + 1
    shape = [np.log1p(n["n_words"]) / 5, n["n_repeat_words"] / words, n["n_dup_lines"] / lines, np.minimum(n["n_symbols"] / words, 3), np.minimum(n["word_chars"] / words, 30) / 10, np.minimum(lines / words, 1)]
    return np.concatenate([np.sqrt(chars / size[:, None]), np.sqrt(common / np.maximum(common.sum(axis=1, keepdims=True), 1)), np.stack(shape, axis=1)], axis=1).astype(np.float32)


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    source, lang, size = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source", "lang", "n_chars"))
    out = np.zeros((len(source), SOURCE_BINS + LANG_BINS + LENGTH_BINS), np.float32)
    for i, (s, l, n) in enumerate(zip(source, lang, size)):
        out[i, 0 if s is None else 1 + crc32(str(s).encode()) % (SOURCE_BINS - 1)] = 1
        out[i, SOURCE_BINS + (0 if l is None else 1 + crc32(str(l).encode()) % (LANG_BINS - 1))] = 1
        out[i, SOURCE_BINS + LANG_BINS + (0 if n is None else 1 + min(max(int(n), 0).bit_length(), LENGTH_BINS - 2))] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method with an L2 penalty on all but the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class CoTrained:
    """Both classifiers, their calibration (slope and shift) and the weights that combine them."""

    def __init__(self, views: list[np.ndarray], label: np.ndarray, rounds: int, grow: int, sure: float) -> None:
        """views: text and metadata of all rows; label: 1, 0 or -1 where it isn't known."""
        self.mean = [v.mean(axis=0) for v in views]
        self.scale = [v.std(axis=0) + 1e-3 for v in views]
        views = [(v - m) / s for v, m, s in zip(views, self.mean, self.scale)]
        known = np.flatnonzero(label >= 0)
        held = known[::4] if len(known) >= 40 else known
        learn = np.setdiff1d(known, held) if len(known) >= 40 else known
        rows = [learn.copy(), learn.copy()]
        marks = [label[learn].astype(float), label[learn].astype(float)]
        pool = [np.flatnonzero(label < 0), np.flatnonzero(label < 0)]
        both = len(np.unique(label[learn])) == 2
        self.weights = [fit_logistic(views[k][rows[k]], marks[k]) for k in (0, 1)]
        for _ in range(rounds if both else 0):
            for k in (0, 1):
                other = 1 - k
                p = 1 / (1 + np.exp(-np.clip(_logit(views[k][pool[other]], self.weights[k]), -30, 30)))
                good, bad = np.flatnonzero(p >= sure), np.flatnonzero(p <= 1 - sure)
                good, bad = good[np.argsort(-p[good], kind="stable")[:grow]], bad[np.argsort(p[bad], kind="stable")[: max(1, grow // 4)]]
                rows[other] = np.concatenate([rows[other], pool[other][good], pool[other][bad]])
                marks[other] = np.concatenate([marks[other], np.ones(len(good)), np.zeros(len(bad))])
                pool[other] = np.delete(pool[other], np.concatenate([good, bad]))
            self.weights = [fit_logistic(views[k][rows[k]], marks[k]) for k in (0, 1)]
        y = label[held].astype(float)
        self.calibration = [fit_logistic(_logit(views[k][held], self.weights[k])[:, None], y, 1e-2) for k in (0, 1)]
        self.mix = fit_logistic(np.stack([_logit(_logit(views[k][held], self.weights[k])[:, None], self.calibration[k]) for k in (0, 1)], axis=1), y, 1e-2)

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        logits = [_logit(_logit((v - m) / s, w)[:, None], c) for v, m, s, w, c in zip(views, self.mean, self.scale, self.weights, self.calibration)]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, _logit(np.stack(logits, axis=1), self.mix)))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        a, b = text_view(data, offsets), metadata_view(batch)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array([binary(x) for x in a], pa.binary()), pa.array([binary(x) for x in b], pa.binary())], names=["label", "text_view", "metadata_view"])


def _score_rows(model: CoTrained | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            n = len(offsets) - 1
            found = model.score([text_view(data, offsets), metadata_view(batch)]) if model else (np.full(n, 0.5),) * 3
            keep = [c for c in batch.schema.names if c not in ("text", "source", "lang", "n_chars")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(x) for x in found], names=[*keep, "p_text", "p_metadata", "score"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, learn: Column, labelled: int = 6000, pool: int = 6000, rounds: int = 5, grow: int = 200, sure: float = 0.95) -> CoTrained | None:
    """A model from at most ``labelled`` labelled rows and about ``pool`` others, by a hash of doc_id, where ``learn`` holds."""
    marks = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64(F.col("doc_id"), F.lit(13))).limit(labelled)
    total = docs.count()
    some = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) < int(min(1.0, pool / max(total, 1)) * (1 << 30))
    rows = docs.where(learn & F.col("doc_id").isNotNull()).join(F.broadcast(marks), "doc_id", "left")  # `labelled` rows at most
    rows = rows.where(F.col("label").isNotNull() | some).select("text", "source", "lang", "n_chars", F.coalesce("label", F.lit(-1)).alias("label"))
    seen = rows.mapInArrow(_sample_rows, "label int, text_view binary, metadata_view binary").collect()
    label = np.array([r["label"] for r in seen], int)
    if not (label >= 0).any():
        return None
    return CoTrained([np.array([np.frombuffer(r[c], np.float32) for r in seen]) for c in ("text_view", "metadata_view")], label, rounds, grow, sure)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, keep_from: float = 0.5, **options) -> DataFrame:
    """doc_id, p_text, p_metadata, score and kept (score >= keep_from) for each row of ``docs``.

    ``docs`` has doc_id, text, lang, source, n_chars; ``labels`` (doc_id, quality 0 or 1) teach where
    ``learn`` holds. Null metadata are values of their own; null texts are empty. Without labels every
    probability is 0.5. Every row gives a row, repeated ones too; null doc_ids stay null; more columns
    are ignored.
    """
    slim = docs.select("doc_id", "text", "source", "lang", "n_chars")
    model = fit(slim, labels, learn, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(_score_rows(model), f"doc_id {kind}, p_text double, p_metadata double, score double")
    return found.withColumn("kept", F.col("score") >= keep_from)
