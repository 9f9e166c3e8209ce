"""Quality rules with distribution divergence.

A document's histograms of character classes and of common words are held against references of its
language by the Jensen-Shannon distance. A reference is the Hellinger mean (the square of the mean
root) of the histograms of all documents that are long enough, so that what a few documents are full
of hardly shows. Both tests have a guard: a text below a minimum length is too short to tell and passes.
So does a text of a language with too few texts over that guard for a reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACE, U8, mix, slices, span_hashes, window_hashes, words
from tagloom.llm.toxicity import letter_words

#: Common words of four languages, whose counts make the word histogram (all others count as one more).
COMMON_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from or have by not but what all were we when "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par au sur pas plus avec ce se ne sont il ou son aux "
    "el que los del las por con no una su para es al lo como más o pero sus ya este sí porque esta entre cuando muy sin"
).split()
SYMBOLS = b"#*$%&|<>"
#: Classes of characters; bytes that continue a character have none.
CLASSES = 12


def _classes() -> np.ndarray:
    kind = np.full(256, 11, np.int8)
    for i in range(128):
        c = chr(i)
        kind[i] = 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 6 if c in ".,;:!?" else 7 if c in SYMBOLS.decode() else 8 if c.isprintable() else 9
    kind[0x80:0xC0] = CLASSES
    kind[0xC2:0xE0] = 10
    return kind


_CLASS = _classes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    listed = list(dict.fromkeys(COMMON_WORDS))
    text = " ".join(listed).encode()
    data = np.frombuffer(text, np.uint8)
    first, end, _ = words(data, np.array([0, len(data)]))
    hashes = span_hashes(data, first, end)
    order = np.argsort(hashes)
    return hashes[order], order


def histograms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x classes, rows x common words and one for all others)."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    chars = np.bincount(row * (CLASSES + 1) + _CLASS[data], minlength=rows * (CLASSES + 1)).reshape(rows, CLASSES + 1)[:, :CLASSES]
    known, order = _word_table()
    hashes, at = letter_words(data, offsets)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    word = np.where(known[place] == hashes, order[place], len(known))
    return chars, np.bincount(at * (len(known) + 1) + word, minlength=rows * (len(known) + 1)).reshape(rows, len(known) + 1)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(offsets) - 1
    first, end, row = words(data, offsets)
    n = np.bincount(row, minlength=rows)
    lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
    chars = np.bincount(row, weights=lead[end] - lead[first], minlength=rows).astype(np.int64)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    with np.errstate(over="ignore"):
        own = mix(np.arange(rows, dtype=U8) + U8(1))
        cuts = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
        starts = starts[starts < len(data)]
        ends = np.minimum(np.append(starts[1:], len(data)), len(data))
        at = np.searchsorted(offsets, starts, side="right") - 1
        ends = ends - (data[ends - 1] == 10) if len(starts) else ends
        solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
        full = solid[ends] > solid[starts]
        starts, ends, at = starts[full], ends[full], at[full]
        lines = span_hashes(data, starts, ends) ^ own[at]
        _, unique = np.unique(lines, return_index=True)
        dup = np.bincount(at, minlength=rows) - np.bincount(at[unique], minlength=rows)
        windows, pos = window_hashes(span_hashes(data, first, end), row, 5)
        windows ^= own[row[pos]]
    order = np.argsort(windows)
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(first) + 6, np.int64)
    np.add.at(cover, pos[again], 1)
    np.add.at(cover, pos[again] + 5, -1)
    covered = np.cumsum(cover)[: len(first)] > 0
    return {"n_words": n, "word_chars": chars, "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]], "n_dup_lines": dup, "n_repeat_words": np.bincount(row[covered], minlength=rows)}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2: 0 to 1) of the rows of two tables of counts; 1 if only one is empty."""
    p, q = (x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300) for x in (p.astype(float), q.astype(float)))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q)) / 2
    return np.sqrt(np.clip(total, 0, 1))


def _langs(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("lang")).cast(pa.string()).to_pylist()]


def _sums(guards: tuple[int, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch, data, offsets in slices(batches):
            langs = np.array(_langs(batch), object)
            for kind, table in enumerate(histograms(data, offsets)):
                size = table.sum(axis=1, keepdims=True)
                root = np.rint(1e6 * np.sqrt(table / np.maximum(size, 1))).astype(np.int64)
                for lang in set(langs):
                    part = root[(langs == lang) & (size[:, 0] >= guards[kind])]
                    part = np.append(part.sum(axis=0), len(part))
                    have = total.setdefault(lang, [0, 0])
                    have[kind] = have[kind] + part
        for lang, tables in total.items():
            for kind, sums in enumerate(tables):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums)), pa.array([kind] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["lang", "kind", "at", "n"])

    return rows


_OUT = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("class_distance", "double"), ("word_distance", "double"), ("kept", "boolean"))


def _judge(reference: tuple[dict[str, np.ndarray], dict[str, np.ndarray]], limits: dict[str, float]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            count = base_counts(data, offsets)
            chars, common = histograms(data, offsets)
            langs = _langs(batch)
            class_d, word_d = (np.array([np.nan] * len(langs)) for _ in (0, 1))
            for table, own, d in ((chars, reference[0], class_d), (common, reference[1], word_d)):
                known = np.array([x in own for x in langs], bool)
                if known.any():
                    d[known] = js_distance(table[known], np.array([own[x] for x in langs if x in own]))
            n = count["n_words"]
            failed = (n < 10) | (100 * count["n_repeat_words"] > 20 * n)
            odd = (chars.sum(axis=1) >= limits["min_chars"]) & (class_d > limits["class_limit"])
            odd |= (common.sum(axis=1) >= limits["min_words"]) & (word_d > limits["word_limit"])
            found = count | {"base_failed": failed, "class_distance": class_d, "word_distance": word_d, "kept": ~failed & ~odd}
            keep = [c for c in batch.schema.names if c not in ("text", "lang")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(found[c].astype({"long": np.int64, "boolean": bool, "double": float}[t]), from_pandas=True) for c, t in _OUT], names=[*keep, *(c for c, _ in _OUT)])

    return rows


def judge_quality(docs: DataFrame, min_chars: int = 100, class_limit: float = 0.175, min_words: int = 60, word_limit: float = 0.45, min_language_texts: int = 20) -> DataFrame:
    """doc_id with base counts, both distances and ``kept`` for each row of ``docs`` (doc_id, text, lang).

    base_failed: fewer than 10 words, or more than 20 % of them in 5-word windows that occur twice.
    kept: not base_failed, and each distance is within its limit or the text is shorter than the
    guard (``min_chars`` characters, ``min_words`` words). References are means over all rows of a
    language that the test's guard lets in; where a language has under ``min_language_texts`` of them, that distance is
    null and its test passes. Null and empty texts have no words and fail; null languages are one language. Every row gives a row, repeated ones too.
    """
    wide = docs.select("doc_id", "text", "lang")
    sums = wide.select("text", "lang").mapInArrow(_sums((min_chars, min_words)), "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).collect()
    # the last entry is the number of texts
    shape = CLASSES + 1, len(dict.fromkeys(COMMON_WORDS)) + 2
    roots: tuple[dict[str, np.ndarray], dict[str, np.ndarray]] = ({}, {})
    for r in sums:
        roots[r["kind"]].setdefault(r["lang"], np.zeros(shape[r["kind"]]))[r["at"]] += r["n"]
    reference = tuple({k: v[:-1] ** 2 for k, v in x.items() if v[-1] >= max(1, min_language_texts)} for x in roots)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return wide.mapInArrow(_judge(reference, {"min_chars": min_chars, "class_limit": class_limit, "min_words": min_words, "word_limit": word_limit}), f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in _OUT))
