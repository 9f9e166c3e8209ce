"""The learned operators and the quality verdict against dense versions on small tables."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import langid
from tagloom.llm.langid import identify_languages
from tagloom.llm.quality_cotrain import CoTrained, fit_logistic, metadata_view, score_quality, text_view
from tagloom.llm.quality_rules import COMMON_WORDS, judge_quality
from tagloom.llm.toxicity import nn_pu_fit, score_toxicity, word_bins

WORDS = {"en": "the of and to in is that it was for on are".split(), "fr": "le la les des une est pour qui dans avec sur être".split(), "de": "der die und das nicht ein für ist auf über mit sich".split()}


def blob(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_language_kernel_against_sets_of_grams(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[l] + ["x1", "Zoo!"]) for _ in range(rng.randint(3, 25))), l) for i in range(90) for l in [list(WORDS)[i % 3]]]
    rows += [(100, "The OF and", None), (101, "über être the", None), (102, None, "en"), (103, " 7 ", "fr"), (104, "", None)]

    def grams(t):
        low = [c.lower() if c.isalpha() else " " for c in t or ""]
        return {(n, *low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1)}

    known = [(grams(t), l) for _, t, l in rows if l and t and any(c.isalpha() for c in t)]
    langs = sorted(WORDS)
    k = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0
    kernel = np.array([[k(x, y) for y, _ in known] for x, _ in known])
    values, vectors = np.linalg.eigh(kernel)
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values[-1]))
    mapped = kernel @ root
    y = np.array([langs.index(l) for _, l in known])
    weight = 1 / np.bincount(y)[y]
    weight = (weight * len(y) / weight.sum())[:, None]
    solved = np.linalg.solve(mapped.T @ (mapped * weight) + 0.5 * np.eye(len(y)), mapped.T @ (np.where(y[:, None] == np.arange(3), 1.0, -1.0) * weight))
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), landmarks=10_000).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        margin = np.array([k(grams(t), z) for z, _ in known]) @ root @ solved
        top = np.sort(margin)[-2:]
        score = 1 / (1 + math.exp(-4 * (top[1] - top[0])))
        assert abs(got[i].score - score) < 0.05
        if score > 0.55:
            assert got[i].lang_pred == langs[int(margin.argmax())]


def test_languages_beyond_the_bound_are_left_out(spark):
    rows = [(i, f"{chr(97 + i % 5) * 6} word", f"l{i % 5}") for i in range(60)] + [(i, "zzzz rare", "rare") for i in range(60, 63)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = lambda n: {r.lang_pred for r in identify_languages(docs, F.lit(True), max_languages=n).collect()}
    assert "rare" in seen(6) and "rare" not in seen(5)


def dense_pu(x, positive, prior, steps, rate=0.05, decay=1e-4, seed=7):
    rng = np.random.default_rng(seed)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for t in range(1, steps + 1):
        xp, xu = (x[rng.choice(k, min(len(k), 1024), replace=False)] for k in (p, u))
        sp, su = (1 / (1 + np.exp(-k @ w)) for k in (xp, xu))
        gp, gu = xp.T @ (sp * (1 - sp)) / len(sp), xu.T @ (su * (1 - su)) / len(su)
        # risk: prior * mean(1 - sp) + max(0, mean(su) - prior * mean(sp))
        grad = gu - 2 * prior * gp if su.mean() >= prior * sp.mean() else prior * gp - gu
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def test_pu_learning_against_dense_steps():
    rng = np.random.default_rng(3)
    positive = rng.random(400) < 0.2
    x = rng.random((400, 30)) < np.where(positive[:, None] & (np.arange(30) < 4), 0.6, 0.15)
    w, b = nn_pu_fit(x, positive, 0.2, steps=80)
    dw, db = dense_pu(x.astype(float), positive, 0.2, 80)
    assert np.allclose(w, dw, atol=1e-6) and b == pytest.approx(db, abs=1e-6)


def test_toxicity_scores_are_sums_over_words_and_beginnings(spark):
    rng = random.Random(9)
    rows = [(i, " ".join([rng.choice("plain common words here".split()) for _ in range(8)] + ([rng.choice(["vilexyz", "vileabc"])] if i % 4 == 0 else []))) for i in range(200)] + [(900, None), (901, ""), (902, "vilenew word"), (903, "Vile" + "q" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels, F.lit(True)).collect()}
    # a beginning that only toxic words have tells of words that were never seen
    assert min(got[902], got[903]) > 0.7 > max(got[900], got[901]) and all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200))
    one, row = word_bins(*blob("vilexyz plain"))
    other, _ = word_bins(*blob("Plain, VILEXYZ"))
    assert sorted(one) == sorted(other) and set(row) == {0} and len(one) == 2 + 3 + 1
    # without any toxic label, and with nothing else
    none = {r.score for r in score_toxicity(docs, labels.where("toxic = 0"), F.lit(True)).collect()}
    assert max(none) < 0.01


def test_cotraining_is_that_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS["en"]) for _ in range(30)) if i % 2 else "#$ %% " * rng.randint(5, 30), ["en", "fr", None][i % 3], f"s{i % 6}", i * 7 % 900) for i in range(240)]
    marks = [(i, i % 2) for i in range(0, 240, 1) if i % 5 != 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in score_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True)).collect()}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"source": s, "lang": l, "n_chars": n} for _, _, l, s, n in rows])
    views = [np.concatenate([text_view(*blob(t)) for _, t, *_ in rows]), metadata_view(batch)]
    label = np.array([dict(marks).get(i, -1) for i, *_ in rows])
    model = CoTrained(views, label, 5, 200, 0.95)
    # which rows are held for calibration depends on the order they come in, the verdict of clear rows doesn't
    for k, (i, *_) in enumerate(rows):
        want = model.score([v[k : k + 1] for v in views])[2][0]
        assert got[i].kept == (want >= 0.5) == (i % 2 == 1)
    # one class only, and no labels at all
    same = [r.score for r in score_quality(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"), F.lit(True)).collect()]
    assert all(0 <= s <= 1 for s in same) and min(same) > 0.5
    assert {r.score for r in score_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).collect()} == {0.5}


def test_logistic_fit_is_at_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0.3).astype(float)
    w = fit_logistic(x, y, ridge=2.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 2 * w[:-1]).max() < 1e-4 and abs((p - y).sum()) < 1e-3


def classes(text):
    """Counts of the classes of characters, from the definition."""
    out = np.zeros(12)
    for c in text:
        b = c.encode()
        if len(b) == 1:
            k = 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 6 if c in ".,;:!?" else 7 if c in "#*$%&|<>" else 8 if c.isprintable() else 9
        else:
            k = 10 if 0xC2 <= b[0] < 0xE0 else 11
        out[k] += 1
    return out


def words_of(text):
    listed = list(dict.fromkeys(COMMON_WORDS))
    low = "".join(c.lower() if ord(c) < 128 else c for c in text)
    found = collections.Counter("".join(c if c.isalpha() or ord(c) > 127 else " " for c in low).split())
    return np.array([*(found[w] for w in listed), sum(n for w, n in found.items() if w not in listed)], float)


def divergence(p, q):
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, min(1.0, (part(p) + part(q)) / 2)))


def test_distances_and_verdicts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS[l] + ["house", "Baum", "été", "3"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(30, 160))), l) for i in range(90) for l in ["en", "fr"][i % 2 :][:1]]
    rows += [(500, "x9#" * 200, "en"), (501, "q w e r t " * 3 + "!" * 200, "fr"), (502, "short text here", "en"), (503, None, "en"), (504, "Lorem, ipsum dolor; " * 20, None)]
    got = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for kind, of, guard, limit in (("class_distance", classes, 100, 0.175), ("word_distance", words_of, 60, 0.45)):
        tables = {i: of(t or "") for i, t, _ in rows}
        for lang in ("en", "fr"):
            fit = [tables[i] for i, _, l in rows if l == lang and tables[i].sum() >= guard]
            assert len(fit) >= 20
            reference = sum(np.sqrt(x / x.sum()) for x in fit) ** 2
            for i, _, l in rows:
                if l == lang:
                    want = divergence(tables[i], reference)
                    assert getattr(got[i], kind) == pytest.approx(want, abs=1e-4)
                    if tables[i].sum() >= guard and want > limit + 1e-4:
                        assert not got[i].kept
    for i, _, l in rows:
        r = got[i]
        n, w = classes(rows[[x[0] for x in rows].index(i)][1] or "").sum(), words_of(rows[[x[0] for x in rows].index(i)][1] or "").sum()
        odd = (r.class_distance is not None and n >= 100 and r.class_distance > 0.175) or (r.word_distance is not None and w >= 60 and r.word_distance > 0.45)
        assert r.kept == (not r.base_failed and not odd)
    assert not got[500].kept and got[504].class_distance is None


def test_language_sample_is_bounded(spark):
    """Many rows without doc_id, or with one, or with one text, are no larger a sample than others."""
    for doc_id, text in (("CAST(NULL AS LONG)", "concat('les mots ', id)"), ("CAST(7 AS LONG)", "concat('the words ', id)"), ("id", "'one text'"), ("CAST(NULL AS LONG)", "'one text'"), ("id", "concat('der ', id)")):
        docs = spark.range(30_000).selectExpr(f"{doc_id} AS doc_id", f"{text} AS text", "IF(id % 3 = 0, 'a', 'b') AS lang")
        got = langid.fitted_rows(docs, {"a": 10_000, "b": 20_000}, 100).groupBy("lang").count().collect()
        assert all(r["count"] <= 1.5 * 166 + 60 for r in got)
    model = langid.fit(docs, F.lit(True))
    again = langid.fit(docs.repartition(7), F.lit(True))
    assert model[0] == again[0] and (model[1] == again[1]).all()
