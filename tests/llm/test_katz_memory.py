"""What a worker holds while it scores texts with the Katz model."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagloom.llm import common, lm_katz


def test_a_task_gets_one_chunk_at_a_time(spark, monkeypatch):
    """12 chunks in 8 partitions: some task has several, and each comes alone with its own answers."""

    def count(*_):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def rows(chunk, told):
            alone = set(told["chunk"].to_pylist()) == set(chunk["chunk"].to_pylist())
            return pa.table([[chunk["chunk"][0].as_py()], [alone], [chunk.num_rows], [0], [0], [0.0], [0.0]], names=names)

        return rows

    monkeypatch.setattr(lm_katz, "_scores", count)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} end") for i in range(120)], "doc_id long, text string").repartition(12)
    got = lm_katz.katz_scores(docs, F.col("doc_id") % 7 == 2).collect()
    assert len({r.doc_id for r in got}) == len(got) == 12 and {(r.n_tokens, r.held_out) for r in got} == {(1, True)}


def test_numbering_tokens_takes_few_copies():
    tokens = np.random.default_rng(5).integers(0, 50_000, 400_000).astype(np.uint64)
    tracemalloc.start()
    try:
        values, place = lm_katz.distinct(tokens)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want, where = np.unique(tokens, return_inverse=True)
    assert (values == want).all() and (place == where).all()
    assert most < 32 * len(tokens)  # np.unique takes 42 bytes for each
    for few in ([], [3], [3, 3]):
        assert [x.tolist() for x in lm_katz.distinct(np.array(few, np.uint64))] == [sorted(set(few)), [0] * len(few)]


def test_free_memory_goes_back():
    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    blocks = [np.ones(100_000, np.uint8) for _ in range(1500)]
    kept = blocks[::20]  # what lies between them stays with the allocator
    blocks.clear()
    before = held()
    assert common.release(kept) is kept
    assert before - held() > 75_000_000
