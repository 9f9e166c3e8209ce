"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel is the blended spectrum of lengths 1 to 3 over characters, by presence: two texts are as
similar as the share of n-grams that both contain, ``|X and Y| / sqrt(|X| |Y|)``. Landmarks span the
feature space (Nyström), one ridge regression for each language against the rest is solved there,
and texts are scored in batches by matrix products. The kernel is linear in the presence vector, so
landmarks, their inverse root and the regression fold into one matrix (n-grams x languages).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tagloom.llm.common import binary, slices

#: Bits of the hash of n-grams of length 1, 2 and 3.
BITS = (12, 13, 14)
BINS = sum(1 << b for b in BITS)
UNKNOWN = "und"
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter (no letters lie above)."""
    found = np.zeros(0x33480, np.uint32)
    for i in range(len(found)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            found[i] = ord(low) if len(low) == 1 else i
    return found


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BINS presence of n-grams, whether a row has a letter)."""
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(lead[offsets]))
    table = _letters()
    low = table[np.minimum(points, len(table) - 1)]
    flags = np.zeros(rows * BINS, bool)
    letters = np.bincount(row, weights=low > 0, minlength=rows) > 0
    base = row * BINS
    with np.errstate(over="ignore"):
        gram, shift = low * _A, 0
        for n, bits in enumerate(BITS):
            if n:
                gram = gram[:-1] * _B + low[n:] * _C
                gram ^= gram >> np.uint32(15)
            bins = ((gram * _A) >> np.uint32(32 - bits)).astype(np.int64) + base[: len(gram)] + shift
            flags[bins[row[n:] == row[: len(row) - n]] if n else bins] = True
            shift += 1 << bits
    return flags.reshape(rows, BINS), letters


def _sample_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        flags, letters = presence(data, offsets)
        bits = [binary(np.packbits(f)) if ok else None for f, ok in zip(flags, letters)]
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in ("lang", "h")] + [pa.array(bits, pa.binary())], names=["lang", "h", "bits"])


def fitted_rows(known: DataFrame, counts: dict[str, int], each: int) -> DataFrame:
    """lang, h and bits of about 1.5 x ``each`` + 16 rows of ``known`` for each language, those with the least hash of doc_id and text.

    Rows that are alike are one, so neither copies nor many rows without doc_id make it more.
    """
    limits = known.sparkSession.createDataFrame([(l, min(1 << 30, int((1.5 * each + 16) / n * (1 << 30)) + 1)) for l, n in counts.items()], "lang string, upto long")
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # of each language half as many rows again as are fitted, and some, as the hash is uneven in small numbers
    thin = hashed.join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("upto")).groupBy("lang", "h").agg(F.max("text").alias("text"))
    return thin.mapInArrow(_sample_bits, "lang string, h long, bits binary").where("bits is not null")


def _unit_rows(packed: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, :BINS].astype(np.float32)
    return x / np.sqrt(x.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, learn: Column, landmarks: int = 240, fit_rows: int = 2400, ridge: float = 0.5, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """(languages, BINS x languages matrix) from the rows of ``docs`` where ``learn`` holds.

    About ``fit_rows`` rows are fitted, dealt evenly to the languages by a hash of doc_id and text (at least
    four of each; rows that are alike are one), of which ``landmarks`` span the space (at least one of each language); languages are
    counted over all rows. The ``max_languages`` with the most rows are learned; a table with more
    needs a larger bound, which the size of the matrix on the driver grows with.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BINS, 0), np.float32)
    each = max(4, fit_rows // len(langs))
    seen = sorted(fitted_rows(known, counts, each).collect(), key=lambda r: (r["h"] % (1 << 30), r["h"]))
    by = {l: [r["bits"] for r in seen if r["lang"] == l][:each] for l in langs}
    langs = [l for l in langs if by[l]]
    packed = [bits for l in langs for bits in by[l]]
    y = np.repeat(np.arange(len(langs)), [len(by[l]) for l in langs])
    take = max(1, landmarks // len(langs))
    mark = np.concatenate([np.flatnonzero(y == k)[:take] for k in range(len(langs))])
    z = _unit_rows([packed[i] for i in mark])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    values = np.maximum(values, 1e-6 * values[-1])
    root = vectors / np.sqrt(values)
    mapped = np.concatenate([_unit_rows(packed[i : i + 200]) @ z.T for i in range(0, len(packed), 200)]) @ root
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y)[y][:, None]
    weight *= len(y) / weight.sum()
    solved = np.linalg.solve(mapped.T @ (mapped * weight) + ridge * np.eye(len(mark)), mapped.T @ (target * weight))
    return langs, (z.T @ (root @ solved)).astype(np.float32)


def _score(langs: list[str], fold: np.ndarray):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            flags, letters = presence(data, offsets)
            found, score = [UNKNOWN] * len(flags), np.zeros(len(flags))
            if langs:
                margin = np.concatenate([(f := flags[i : i + 64].astype(np.float32)) @ fold / np.sqrt(np.maximum(f.sum(axis=1, keepdims=True), 1)) for i in range(0, len(flags), 64)])
                best = margin.argmax(axis=1)
                top = np.sort(np.concatenate([margin, np.full((len(margin), 1), -1, margin.dtype)], axis=1), axis=1)[:, -2:].astype(np.float64)
                score = np.where(letters, 1 / (1 + np.exp(-4 * (top[:, 1] - top[:, 0]))), 0.0)
                found = [langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            rows = batch.column(batch.schema.get_field_index("row"))
            yield pa.RecordBatch.from_arrays([rows, pa.array(found, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return predicted


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row of ``docs`` with lang_pred and score, by a fitted model; of ``columns`` those two are left out."""
    kept = [c for c in columns if c not in ("lang_pred", "score")]
    wide = docs.select(F.struct(*kept).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([wide.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return wide.mapInArrow(_score(*model), schema).select("row.*", "lang_pred", "score")


def identify_languages(docs: DataFrame, learn: Column, columns: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``columns`` of each row of ``docs`` with lang_pred and score (0 to 1).

    score is the logistic of four times the lead of the best language over the next (over the margin of
    a wrong one, -1, if there is no other), so it doesn't depend on how many there are. ``docs`` has
    doc_id, text and lang; the model is learned where ``learn`` holds and lang is known, from text
    alone. Texts without a letter, empty and null ones are ``und`` with score 0; so are all if no
    language can be learned. Every row gives a row, repeated ones too; null doc_ids stay null.
    """
    return predict(docs, fit(docs, learn, **options), columns)
