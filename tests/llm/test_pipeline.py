"""The pipeline's stages on odd rows, and against plain versions."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_brute import brute_groups, low

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, drops string, kept_text string, n_lines string, row string, component_id string"
WORDS = {"en": "the of and to in is that it was for on are house tree water people".split(), "fr": "le la les des une est pour qui dans avec sur être maison arbre".split()}
LINE = "a line that many texts of this table hold"


def odd_rows():
    rng = random.Random(6)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    texts = [(say(l, rng.randint(20, 60)), l) for _ in range(40) for l in WORDS]
    texts += [(t, l) for t, l in texts[:6]] + [(f"{t}\n{LINE}", l) for t, l in texts[6:12]]
    texts += [(None, "en"), ("", None), ("123 !!", "fr"), (say("en", 20_000), "en"), (say("fr", 30), None)]
    rows = [(i, t, l, ["a", "b", None][i % 3], len(t or ""), "s", 7, "d", "k", "n", "r", "c") for i, (t, l) in enumerate(texts)]
    return rows + [(None, *rows[0][1:]), (None, *rows[1][1:]), rows[3], rows[3], (5, say("en", 40), *rows[5][2:])]


@pytest.fixture()
def folder(spark, tmp_path):
    def write(rows, items=()):
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def read(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_stages_keep_columns_and_clean_rows(spark, folder):
    rows = odd_rows()
    passage = next(t for i, t, *_ in rows if i == 9)
    path = folder(rows, [(1, passage), (2, "the"), (3, None), (4, "")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {name: stage(spark, docs, path) for name, stage in corpus_pipeline.STAGES}
    assert all(out[name].columns == docs.columns for name, _ in corpus_pipeline.STAGES[:-1])
    has_letter = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert read(out["language_id"]) == sorted(has_letter, key=repr)

    text = lambda t: "\n".join(x for x in (t or "").split("\n") if x != LINE)
    keeper = max(r[0] or 0 for r in rows if r[1] and LINE in r[1])
    want = [r if r[0] == keeper else (r[0], text(r[1]), *r[2:4], len(text(r[1])), *r[5:]) for r in rows]
    assert read(out["line_dedup"]) == sorted(want, key=repr)

    single = {}
    for r in rows:
        if r[0] is not None and (r[0] not in single or (r[1] or "") > (single[r[0]][1] or "")):
            single[r[0]] = r
    groups = brute_groups(single.values())
    want = [r for i, r in single.items() if groups[i][1] == i] + [r for r in rows if r[0] is None]
    assert read(out["near_duplicates"]) == sorted(want, key=repr) and len(want) < len(single)

    leaked = {r[0] for r in rows if passage in (r[1] or "") and r[0] is not None}
    assert 9 in leaked and read(out["decontamination"]) == sorted((r for r in rows if r[0] not in leaked), key=repr)
    mixed = {r.doc_id for r in out["source_mixing"].collect()}
    assert mixed and mixed <= {r[0] for r in rows}


def test_no_language_known_and_empty_tables(spark, folder, tmp_path):
    rows = [(1, "some text here", None, "a", 14, *"s", 7, *"dknrc"), (2, "!!", None, "a", 2, "s", 7, *"dknrc"), (3, None, None, None, None, "s", 7, *"dknrc")]
    path = folder(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, path).collect()] == [1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).collect() == []


def test_run_is_its_stages_in_order(spark, folder):
    rows = odd_rows()
    passage = next(t for i, t, *_ in rows if i == 9)
    path = folder(rows, [(1, passage)])
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    docs = {r[0]: r for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert 9 not in got and got <= set(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mixing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    seen = [low(docs[i][1] or "") for i in got if i is not None]
    assert len(set(seen)) == len(seen)
