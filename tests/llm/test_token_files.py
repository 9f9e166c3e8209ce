"""Token files: exact round trips against the tokenizers library on whole texts, and Elias-Fano coding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm.elias_fano import EliasFano
from tagloom.llm.token_files import read_token_ids, write_token_ids
from tagloom.llm.word_pieces import TextEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, start string, ids string, h string, n_tokens int"


def plain(texts, path=WORDS):
    tokenizer = Tokenizer.from_file(path)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def by_pieces(texts, path=WORDS):
    with open(path, encoding="utf-8") as file:
        encoder = TextEncoder.of(file.read())
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, size = encoder.encode(data, np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


ODD = ["", " ", "\n\t\x0b\x0c\r", "don't 'tis ''s .'s I'LL we'Ve x'y 'S", "a1b22c ٣٤ x²½", "é Éa ́x á̧ 1́ .́", "İstanbul İ ΣΑΣ ß ǅ", "<|endoftext|>a<|startoftext|> B <|ENDOFTEXT|>", "日本語。テスト 123", "a b c d \u0085e", "x\x00y\x1f z\x7f", "(a)(b)[c]{d}...!!?? --a-- _b_ $1,000.50", "😀a😀 👨‍👩‍👧 ’s ‘t “quote”", "ÅB å", "﻿a", "'" * 9 + "re", "a'b'c're"]


def test_pieces_give_the_ids_of_whole_texts(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD + [" ".join(ODD), "".join(ODD)]
    assert by_pieces(texts) == plain(texts)
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert by_pieces(ODD, other) == plain(ODD, other)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n'.aSéÉ́̇1٣x-<|> "), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_pieces_of_any_text(texts):
    assert by_pieces(texts) == plain(texts) if texts else True


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=900), st.integers(0, 60), st.integers(1, 1000))
def test_elias_fano(values, shift, more):
    values = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    universe = (int(values[-1]) if len(values) else 0) + more
    coded = EliasFano.encode(values, universe)
    sequence = EliasFano(np.frombuffer(coded, np.uint8))
    assert (sequence.decode(0, len(values)) == values).all()
    for i in range(0, len(values), 37):
        assert sequence.select(i) == int(values[i])
        assert (sequence.decode(i, min(len(values), i + 300)) == values[i : i + 300]).all()
    n = max(1, len(values))
    assert 8 * len(coded) <= n * (3 + max(0, np.log2(universe / n))) + 32 * (n / 256 + 1) + 8 * 20


def documents():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdeéñ.,'1") for _ in range(rng.randint(1, 9))) for _ in range(n))
    rows = [(rng.randint(-(1 << 62), 1 << 62) if i % 2 else i, say(rng.randint(0, 60))) for i in range(200)]
    rows += [(77, f"same id {i % 5}") for i in range(120)] + [(None, "no id"), (None, None), (None, "no id")]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, say(60_000)), (-(1 << 63), "least"), ((1 << 63) - 1, "most")] + [(2 * 10**6 + i, t) for i, t in enumerate(ODD)]
    rng.shuffle(rows)
    return [(i, t, "en", "s", "x", "y", 3) for i, t in rows]


@pytest.mark.parametrize("tokenizer", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, tmp_path, tokenizer):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    path = public_tokenizers.path(tokenizer)
    write_token_ids(frame, f"{tmp_path}/ids", path)
    got = sorted(read_token_ids(spark, f"{tmp_path}/ids", ("doc_id", "start", "n_tokens", "ids", "ids_crc32")).collect(), key=lambda r: r.start)
    at = 0
    for r in got:  # offsets follow each other over all shards
        assert (r.start, r.n_tokens, r.ids[-1]) == (at, len(r.ids), 1)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    coded = plain([r[1] for r in rows], path)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((r[0], [*c, 1]) for r, c in zip(rows, coded)), key=repr)


def test_empty_table_existing_folder_and_lost_shard(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    write_token_ids(none, f"{tmp_path}/none", WORDS)
    assert read_token_ids(spark, f"{tmp_path}/none").collect() == []
    rows = spark.createDataFrame([(1, "a b", "en", "s", "x", "y", 3)], SCHEMA)
    write_token_ids(rows, f"{tmp_path}/one", WORDS)
    (tmp_path / "one" / "shard-000000-orphan.ids").write_bytes(b"left by a lost task")
    assert [tuple(r) for r in read_token_ids(spark, f"{tmp_path}/one").collect()] == [(1, 0, 3, [*plain(["a b"])[0], 1])]
    with pytest.raises(Exception, match="holds token ids"):
        write_token_ids(rows, f"{tmp_path}/one", WORDS)


def test_long_shards_are_read_in_runs(spark, tmp_path, monkeypatch):
    from tagloom.llm import token_files

    monkeypatch.setattr(token_files, "SPLIT_BYTES", 4000)
    rows = [(i, "word " * (i % 50), "en", "s", "x", "y", 3) for i in range(700)]
    write_token_ids(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/ids", WORDS)
    runs = token_files.TokenReader(f"{tmp_path}/ids", ["ids"]).partitions()
    assert len(runs) > 20
    files = [b for run in runs for b in token_files.TokenReader(f"{tmp_path}/ids", ["doc_id", "start", "n_tokens", "ids"]).read(run)]
    table = pa.Table.from_batches(files).to_pylist()
    assert [r["doc_id"] for r in table] == list(range(700))
    assert [r["ids"] for r in table] == [[*x, 1] for x in plain([r[1] for r in rows])]
    assert [r["start"] for r in table] == np.cumsum([0] + [r["n_tokens"] for r in table])[:-1].tolist()


def test_query_over_a_table(spark):
    from tagloom.llm.queries import op12_token_files

    got = {r.doc_id: tuple(r)[1:] for r in op12_token_files(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    at = 0
    for (doc_id, _), ids in zip(docs, plain([d.text for d in docs])):
        assert got[doc_id] == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += len(ids) + 1
    assert len(got) == len(docs)
