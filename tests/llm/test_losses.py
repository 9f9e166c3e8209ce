"""Nothing is lost to rounding, to short benchmark items or to wide numbers."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import decontam
from tagloom.llm.decontam import find_leaks, folded
from tagloom.llm.line_dedup import Filter, drop_repeated_lines
from tagloom.llm.lm_katz import START, UNKNOWN, Unigrams, _count_pairs, _count_words, _from_planes, _planes, counts_of, number_words
from tagloom.llm.mixing import mix_sources


@pytest.mark.parametrize(("sources", "each"), [(3, 40), (3, 1), (7, 5), (1, 3), (13, 2)])
def test_natural_shares_keep_every_document(spark, sources, each):
    rows = [(s * 1000 + k, "three short words", f"s{s}") for s in range(sources) for k in range(each)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(r.doc_id for r in mix_sources(docs).collect())
    assert got == {i: 1 for i, *_ in rows}


def test_small_source_beside_a_large_one(spark):
    rows = [(k, "word " * 400, "large") for k in range(200)] + [(900, "just one text", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(r.doc_id for r in mix_sources(docs, entropy_share=None, max_repeats=None).collect())
    assert got == {i: 1 for i, *_ in rows}


def least_edits(item, text):
    """Of the best substring of text, by the full table."""
    line = np.zeros(len(text) + 1, int)
    place = np.arange(len(text) + 1)
    for c in item:
        step = np.append(line[0] + 1, np.minimum(line[1:] + 1, line[:-1] + (text != c)))
        line = np.minimum.accumulate(step - place) + place
    return int(line.min())


@pytest.mark.parametrize("entries", [decontam.ENTRIES, 50])
def test_leaks_are_exactly_those_within_the_budget(spark, entries, monkeypatch):
    monkeypatch.setattr(decontam, "ENTRIES", entries)
    rng = random.Random(entries)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n)).strip() or "a"
    items = [(i, text(rng.choice([8, 9, 13, 14, 16, 20, 25, 26, 30, 38, 60, 120]))) for i in range(30)]
    items += [(100, "which of the following is right one"), (101, "which of the following is wrong two")]
    rows = []
    for n in range(120):
        _, t = rng.choice(items)
        s = list(t)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["z"], [s[p], "y"]])
            s = s or ["q"]
        rows.append((n, f"{text(60)} {''.join(s)} {text(60)}"))
    rows += [(300, "which of the following " * 60), (301, "aaaa" * 500)]
    want = set()
    for n, t in rows:
        for i, u in items:
            a, b = folded(u), folded(t)
            say = lambda x: f" {x.tobytes().decode('utf-32-le').strip()} "
            if least_edits(a, b) <= int(0.08 * len(a)) if len(a) >= 8 else say(a) in say(b):
                want.add((n, i))
    got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == want and len(want) > 40
    assert all(e <= int(0.08 * len(folded(dict(items)[i]))) for (_, i), e in got.items())


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "Oh yes!"), (2, "yesterday"), (3, "a NO-way b"), (4, ""), (5, None), (6, "no ways")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Yes"), (2, "no way"), (3, "?!"), (4, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.start, r.stop) for r in find_leaks(docs, bench).collect())
    assert got == [(1, 1, 0, 3, 6), (3, 2, 0, 2, 8)]


def test_blocks_give_the_same_leaks(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    items = [(i, text(60)) for i in range(20)]
    docs = spark.createDataFrame([(n, text(50) + items[n % 20][1] + text(50)) for n in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    read = lambda **o: sorted(map(tuple, find_leaks(docs, bench, **o).collect()))
    assert read() == read(block_chars=300) and len(read()) == 60


def test_word_numbers_hold_wide_counts():
    counts = np.array(sorted([1, 1, 1, 2, 3, 3, 2**31, 2**32 + 5, 2**32 + 5, 2**43 + 12345], reverse=True), np.int64)
    numbers = number_words(15_999, counts)
    assert len(set(numbers.tolist())) == len(counts) and (numbers < START).all()
    assert counts_of(numbers, 7).tolist() == counts.tolist()
    assert counts_of(np.array([START, UNKNOWN], np.uint64), 5_000_000_000).tolist() == [5_000_000_000, 0]


def test_counts_beyond_32_bits():
    """Chunks with up to 2^32 of a word or pair each add up to more."""
    most = np.array([2**32 - 1, 1], np.uint32)
    grams = np.array([11, 12], np.uint64)
    asked = pa.table({"bucket": pa.array([3, 3], pa.int32()), "chunk": [0, 1], "grams": [grams.tobytes()] * 2, "counts": [most.tobytes()] * 2})
    model, *told = _count_words(asked).to_pylist()
    numbers = _from_planes(told[0]["grams"])
    assert counts_of(numbers, 0).tolist() == [2 * (2**32 - 1), 2] and np.frombuffer(model["extra"], np.int64)[-2] == 2 * 2**32
    uni = Unigrams(np.frombuffer(model["extra"], np.int64), 16)
    pairs = asked.select(["bucket", "chunk"]).append_column("counts", pa.array([_planes(most.astype(np.int64))] * 2)).append_column("contexts", pa.array([_planes(numbers)] * 2)).append_column("runs", pa.array([_planes(np.ones(2, np.int64))] * 2)).append_column("grams", pa.array([_planes(numbers[::-1])] * 2))
    model, *told = _count_pairs(uni)(pairs).to_pylist()
    assert _from_planes(model["counts"]).tolist() == [2 * (2**32 - 1), 2] or _from_planes(model["counts"]).tolist() == [2, 2 * (2**32 - 1)]
    assert all(_from_planes(r["counts"]).tolist() == [2 * (2**32 - 1), 2] for r in told if r["chunk"] >= 0)


def test_filters_know_what_they_hold():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    found = Filter(1 << 19)
    found.add(h[:10_000])
    assert found.has(h[:10_000]).all() and found.has(h[10_000:]).mean() < 0.01


def test_lines_of_repeated_ids_count_once(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, f"{line}\nmore"), (2, f"x\n{line}"), (None, line), (3, None)]
    got = sorted((r.doc_id or 0, r.kept_text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, line, 1, 0), (1, line, 1, 0), (1, f"{line}\nmore", 2, 0), (2, f"x\n{line}", 2, 0), (3, "", 1, 0)]
    rows.append((9, line))
    got = sorted((r.doc_id or 0, r.kept_text, r.n_dropped) for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, line, 0), (1, "", 1), (1, "more", 1), (2, "x", 1), (3, "", 0), (9, line, 0)]


def test_a_very_long_text_of_many_lines(spark):
    lines = [f"line number {i} of a very long text" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:30_000])), (3, "\n".join(lines[:10]))]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60_000, 10), 2: (30_000, 10), 3: (10, 0)}
