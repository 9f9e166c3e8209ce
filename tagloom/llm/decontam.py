"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that a document contains with at most k edits shares at least
``m + 1 - q (k + 1)`` of its q-grams with it, on diagonals that drift by at most k. So the shared
q-grams are counted in diagonal bands that overlap by k + 1, only bands that reach this bound are
retained, and each retained region is verified by a banded alignment. q is 8, or for short passages
the largest that leaves the bound at 1 or more, so no passage within the edit budget is missed.
Passages of fewer than ``Q`` characters, which have no edits to spare and stand in many words, are
looked for as whole words. Text is compared lower-cased, with everything but letters and digits as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import U8, Stash, slices

Q = 8
#: So many (hit, place in an item) entries are expanded at once.
ENTRIES = 1 << 19
_SIEVE_BITS = 22
_FACTOR = U8(0x9E3779B97F4A7C15)


@cache
def _fold() -> np.ndarray:
    """By code point: lower case of letters and digits, a space for all others."""
    found = np.full(0x33480, 32, np.uint32)
    for i in range(len(found)):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            found[i] = ord(low) if len(low) == 1 else i
    return found


def normalise(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, their places) with one space for each run of others, none at the start of a row."""
    table = _fold()
    low = table[np.minimum(points, len(table) - 1)]
    blank = low == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1] & (row[1:] == row[:-1])
    at = np.flatnonzero(keep)
    return low[at], at


def _grams(low: np.ndarray, q: int) -> np.ndarray:
    """The q-grams of folded text as 64-bit numbers (characters beyond one byte are mixed into one)."""
    n = len(low) - q + 1
    if n <= 0:
        return np.zeros(0, U8)
    one = (low ^ (low >> np.uint32(8)) * np.uint32(31)).astype(np.uint8)
    if q == 8:
        two = one[:-1].astype(np.uint16) | one[1:].astype(np.uint16) << np.uint16(8)
        four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
        return four[:-4].astype(U8) | four[4:].astype(U8) << U8(32)
    out = np.zeros(n, U8)
    for j in range(q):
        out |= one[j : j + n].astype(U8) << U8(8 * j)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def banded_distance(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int]:
    """(least edits, end) of item within region, along the diagonals from -budget on; over the budget: budget + 1."""
    whole = region.tobytes().find(item.tobytes())
    while whole % 4 and whole > 0:
        whole = region.tobytes().find(item.tobytes(), whole + 1)
    if whole >= 0:
        return 0, whole // 4 + len(item)
    low, high = -budget, max(len(region) - len(item), 0) + budget
    width = high - low + 1
    place = np.arange(width)
    far = budget + 1 + len(item)
    start = place + low
    line = np.where((start >= 0) & (start <= len(region)), 0, far).astype(np.int64)
    padded = np.full(len(region) + 2 * (len(item) + width) + 4, 0xFFFFFFFF, np.uint32)
    base = len(item) + width
    padded[base : base + len(region)] = region
    for i, c in enumerate(item, 1):
        at = i + start
        same = padded[base + at - 1] == c
        step = np.minimum(line + ~same, np.append(line[1:], far) + 1)
        step = np.where((at >= 0) & (at <= len(region)), step, far)
        line = np.minimum(np.minimum.accumulate(step - place) + place, far)
    best = int(line.argmin())
    return (int(line[best]), len(item) + best + low) if line[best] <= budget else (budget + 1, -1)


def folded(text: str | None) -> np.ndarray:
    points = _points(text or "")
    low, _ = normalise(points, np.zeros(len(points), np.int64))
    return low[: len(low) - 1] if len(low) and low[-1] == 32 else low


class Passages:
    """Items with the same q: folded text, edit budgets, and their q-grams by value and item."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float) -> None:
        self.q = q
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.floor(rate * self.size).astype(np.int64)
        self.bound = self.size + 1 - q * (self.budget + 1)
        grams = [_grams(t, q) for t in self.texts]
        flat = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.lexsort((item, flat))
        self.item, self.at = item[order], at[order]
        self.gram, where = np.unique(flat[order], return_inverse=True)
        self.key = where.astype(np.int64) * len(self.ids) + self.item
        self.reach = int((self.size + self.budget).max())

    def entries(self, near: np.ndarray, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the entries of items first to stop for each gram of ``near``."""
        n = len(self.ids)
        start = np.searchsorted(self.key, near * n + first)
        return start, np.searchsorted(self.key, near * n + stop) - start

    def sieve(self) -> np.ndarray:
        found = np.zeros(1 << _SIEVE_BITS, bool)
        with np.errstate(over="ignore"):
            found[(self.gram * _FACTOR) >> U8(64 - _SIEVE_BITS)] = True
        return found


def sort_items(items: list[tuple[int, str]], rate: float) -> tuple[list[Passages], dict[str, list[tuple[int, str]]]]:
    """(items by their q, items of fewer than Q characters by their first word)."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    short: dict[str, list[tuple[int, str]]] = {}
    for i, text in items:
        low = folded(text)
        if len(low) >= Q:
            by.setdefault(max(1, min(Q, len(low) // (int(np.floor(rate * len(low))) + 1))), []).append((i, low))
        elif len(low):
            word = low.tobytes().decode("utf-32-le")
            short.setdefault(word.split()[0], []).append((i, word))
    return [Passages(own, q, rate) for q, own in sorted(by.items())], short


def _bands(p: Passages, row: np.ndarray, hit: np.ndarray, near: np.ndarray, first: int, stop: int) -> Iterator[np.ndarray]:
    """(row, item, band) keys that reach their item's bound; what is expanded at once is bounded by halving items, then text."""
    start, many = p.entries(near, first, stop)
    total = int(many.sum())
    if total > ENTRIES and stop - first > 1:
        middle = (first + stop) // 2
        yield from _bands(p, row, hit, near, first, middle)
        yield from _bands(p, row, hit, near, middle, stop)
        return
    if total > ENTRIES and len(hit) and hit[-1] - hit[0] > 4 * p.reach:
        middle = (int(hit[0]) + int(hit[-1])) // 2
        for some in (hit < middle + p.reach, hit >= middle - p.reach):
            yield from _bands(p, row, hit[some], near[some], first, stop)
        return
    if not total:
        return
    entry = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
    item, at, d = p.item[entry], p.at[entry], np.repeat(hit, many)
    # an occurrence lies in two neighbouring stretches of the text, which hold its bound of hits
    stretch = d // p.reach
    stretch -= stretch.min()
    counts = _counts(stretch, item - first, int(stretch.max()) + 3, stop - first)
    some = np.maximum(counts(stretch) + counts(stretch + 1), counts(stretch - 1) + counts(stretch)) >= p.bound[item]
    item, at, d = item[some], at[some], d[some]
    if not len(d):
        return
    band = (d - at) // (p.budget[item] + 1)
    base = int(band.min()) - 1
    span = int(band.max()) - base + 2
    group = (row[d].astype(np.int64) * len(p.ids) + item) * span
    keys, count = np.unique(_distinct(np.concatenate([group + band - base, group + band - 1 - base]), np.concatenate([at, at])), return_counts=True)
    which = (keys // span) % len(p.ids)
    keys = keys[count >= p.bound[which]]
    yield np.stack([keys // span // len(p.ids), (keys // span) % len(p.ids), keys % span + base], axis=1)


def _find(groups: list[Passages], short: dict[str, list[tuple[int, str]]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [p.sieve() for p in groups]
        for batch, data, offsets in slices(batches):
            points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(lead))
            low, place = normalise(points, row)
            row = row[place]
            starts = np.searchsorted(row, np.arange(len(offsets)))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}

            def keep(r: int, i: int, edits: int, a: int, z: int) -> None:
                found = (edits, int(place[a] - lead[r]), int(place[z - 1] - lead[r]) + 1)
                best[r, i] = min(found, best.get((r, i), found))

            for p, sieve in zip(groups, sieves):
                grams = _grams(low, p.q)
                with np.errstate(over="ignore"):
                    hit = np.flatnonzero(sieve[(grams * _FACTOR) >> U8(64 - _SIEVE_BITS)])
                hit = hit[row[hit] == row[hit + p.q - 1]]
                near = np.minimum(np.searchsorted(p.gram, grams[hit]), len(p.gram) - 1)
                true = p.gram[near] == grams[hit]
                hit, near = hit[true], near[true]
                least = int(p.bound.min())
                dense = np.searchsorted(hit, hit + p.reach, side="right") - np.searchsorted(hit, hit - p.reach) >= least
                for keys in _bands(p, row, hit[dense], near[dense], 0, len(p.ids)):
                    for r, i, b in keys.tolist():
                        e = int(p.budget[i])
                        a = max(int(starts[r]), b * (e + 1) - e)
                        z = min(int(starts[r + 1]), (b + 2) * (e + 1) + int(p.size[i]) + e)
                        edits, end = banded_distance(p.texts[i], low[a:z], e)
                        if edits <= e and edits <= best.get((r, p.ids[i]), (e,))[0]:
                            _, length = banded_distance(p.texts[i][::-1], low[a : a + end][::-1], e)
                            keep(r, p.ids[i], edits, a + end - max(length, 1), a + end)
            if short:
                for r in range(len(offsets) - 1):
                    text = low[starts[r] : starts[r + 1]].tobytes().decode("utf-32-le")
                    held = f" {text} "
                    for word in set(text.split()) & short.keys():
                        for i, whole in short[word]:
                            at = held.find(f" {whole} ")
                            if at >= 0:
                                keep(r, i, 0, int(starts[r]) + at, int(starts[r]) + at + len(whole))
            if best:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                found = [(ids[r], i, *v) for (r, i), v in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "item_id", "edits", "start", "stop"])

    return rows


def _distinct(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The key of each distinct pair of key and place."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    return key[np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])])]


def _counts(stretch: np.ndarray, item: np.ndarray, stretches: int, items: int):
    """Hits by stretch (from -1 on) and item, as a function of the stretches of the same hits."""
    if stretches * items <= 1 << 24:
        table = np.bincount((stretch + 1) * items + item, minlength=stretches * items)
        return lambda s: table[(s + 1) * items + item]
    keys, n = np.unique((stretch + 1) * items + item, return_counts=True)

    def look(s: np.ndarray) -> np.ndarray:
        want = (s + 1) * items + item
        near = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[near] == want, n[near], 0)

    return look


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, edits, start and stop (code points of the document) of each benchmark item in a document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. An item is found if the document
    contains it with at most ``rate`` of its folded characters as edits (rounded down), items of fewer
    than Q characters as whole words; of several places the one with the fewest edits is told, then the
    first. The benchmark is dealt to blocks of about ``block_chars`` characters by a hash; one block at a
    time goes to the executors and is held against all documents.

    Null texts are empty; items without a letter or digit and empty documents match nothing. Rows of
    documents without doc_id are left out. Repeated rows and items give one result for each pair of
    ids, that with the fewest edits.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits long, start long, stop long"
    sized = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    chars = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-2 * chars // block_chars) if chars > block_chars else 1
    stash, out = Stash(spark) if blocks > 1 else None, None
    for b in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        groups, short = sort_items([(r["item_id"], r["text"]) for r in block.collect()], rate)  # about half of block_chars, or all if less than that
        if groups or short:
            found = wide.mapInArrow(_find(groups, short), schema)
            if stash:
                found = stash.put(found, f"leaks{b}")
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "stop")).alias("m"))
    return best.select("doc_id", "item_id", "m.edits", "m.start", "m.stop")
