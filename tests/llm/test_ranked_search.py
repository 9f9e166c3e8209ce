"""Ranked search against a version that scores every document."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm.common import Stash
from tagloom.llm.ranked_search import Shard, build_index, query_terms, ranked_search, search_documents, _build

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, rank int, score string, item_id string, shard int"
ITEMS = "item_id long, text string, doc_id string, terms int"


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k=50):
    held = [(i, collections.Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for *_, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    texts = {}
    for i, t, *_ in items:
        if i is not None:
            texts[i] = max(texts.get(i, ""), t or "")
    out = []
    for item, text in texts.items():
        scores = []
        for doc, c, length in held:
            m = 100 - 50 + (50 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & c.keys())
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if no else doc, -s) for r, (s, no, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed=8, n=500):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñß0129") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["the"]
    say = lambda m: " ".join("the" if rng.random() < 0.3 else vocab[min(int(rng.paretovariate(0.7)), 149)] for _ in range(m))
    docs = [(i * 3, say(rng.randint(0, 80))) for i in range(n)]
    docs += [(10_000 + i, docs[i % 2][1].upper()) for i in range(n // 3)]  # a third are copies of two texts
    docs += [(50_000, None), (50_001, ""), (50_002, "-_-.:"), (50_003, say(40_000)), (None, docs[4][1]), (None, docs[4][1]), (12, docs[5][1]), (12, docs[6][1]), (50_004, "x\x00y\x7fz É日本語。٣")]
    rng.shuffle(docs)
    items = [(i, say(rng.randint(1, 40))) for i in range(30)] + [(100, "the"), (101, "THE the The"), (102, "unknownword"), (103, ""), (104, None), (None, "the"), (105, "the"), (105, "É日本語。٣ z"), (106, docs[7][1])]
    return [(i, t, "en", 1, "s", "x", 3) for i, t in docs], [(i, t, "d", 2) for i, t in items]


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize(("k", "shard_bytes", "block_chars"), [(50, 1 << 20, 2 << 20), (5, 2000, 2 << 20), (1, 1, 300), (10_000, 5000, 2 << 20)])
def test_equals_brute_force(spark, k, shard_bytes, block_chars):
    docs, items = corpus()
    index = Stash(spark).put(build_index(spark.createDataFrame(docs, DOCS).repartition(3), shard_bytes), "index")
    assert got(ranked_search(index, spark.createDataFrame(items, ITEMS), k, block_chars)) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus(n=20)
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert got(search_documents(none, spark.createDataFrame(items, ITEMS))) == []
    assert got(search_documents(spark.createDataFrame(docs, DOCS), nothing)) == []
    blank = spark.createDataFrame([(1, "..", "", 1, "", "", 1), (2, None, "", 1, "", "", 1)], DOCS)
    assert got(search_documents(blank, spark.createDataFrame(items, ITEMS))) == []


def test_terms():
    assert query_terms(["A a-B_c É1x", None, "", "\x00\x7f"]) == [[b"a", b"b", b"c", "É1x".encode()], [], [], []]


def test_reading_stops_early_and_keeps_ties():
    rng = random.Random(1)
    rare = [" ".join(["common"] * rng.randint(1, 30) + ["rare"] * (i % 97 == 0) + ["filler"] * rng.randint(0, 60)) for i in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20_000)), "text": rare})
    import pyspark

    class Task:
        partitionId = staticmethod(lambda: 0)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task))
        built = list(_build(1 << 30)(iter([batch])))
    row = {c: v[0].values if isinstance(v[0], pa.ListScalar) else v[0].as_py() for c, v in zip(built[0].schema.names, built[0].columns)}
    shard = Shard(row, pa.array([b"common", b"rare"], pa.binary()), row["documents"], row["occurrences"])
    weight = np.array([3, 5000])
    docs, score, met = shard.best(np.array([0, 1]), weight, 20)
    full = np.zeros(20_000, np.int64)
    np.add.at(full, np.repeat(np.arange(20_000), shard.row_ends - shard.row_starts), weight[shard.term] * shard.impact)
    order = np.lexsort((np.arange(20_000), -full))[:20]
    assert docs.tolist() == order.tolist() and score.tolist() == full[order].tolist()
    assert met < 2000
