"""The text operators against brute-force versions on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm.decontam import find_leaks, normalise, _points
from tagloom.llm.html_main import extract_main_text, main_text
from tagloom.llm.langid import identify_languages
from tagloom.llm.line_dedup import drop_repeated_lines
from tagloom.llm.lm_katz import REST, TOP, discounts, katz_scores
from tagloom.llm.mixing import mix_sources
from tagloom.llm.ngram_join import ngram_jaccard_groups
from tagloom.llm.quality_cotrain import score_quality
from tagloom.llm.quality_rules import judge_quality
from tagloom.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, short, empty and null ones; extra columns with clashing names."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 160))))
    for t in texts[:25]:
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    line = "a line that many texts of this table hold"
    texts += [f"{rng.choice(vocab)}\n  {line.title()} \r\n{rng.choice(vocab)}\n{line}" for _ in range(30)]
    texts += ["", None, "   \n\t ", "one", "one", "ONE two", "x " * 3000, line, "\n", "ends\n"]
    rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], ["a", "b", "c", None, "a", "a"][i % 6], len(t or ""), "s", "n") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def brute_groups(rows, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_groups(spark.createDataFrame(corpus, SCHEMA)).collect()}
    assert got == brute_groups(corpus)


def test_ngram_join_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", None, None, None, None, None), (1, "a b c d e f", None, None, None, None, None), (None, "a b", None, None, None, None, None), (2, "a b c d e f", None, None, None, None, None), (3, None, None, None, None, None, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_ngram_join_large_group(spark):
    """Near copies of one text link through it, with few comparisons, and chains are followed."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"c{k}" for k in range(i, i + 60))) for i in range(0, 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_katz(spark, corpus):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in katz_scores(spark.createDataFrame(corpus, SCHEMA), held).collect()}
    token = {i: [*WORD.findall(low(t or "")), None] for i, t, *_ in corpus}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in token}
    uni, pair, context = (collections.Counter() for _ in range(3))
    for i, w in token.items():
        if not out[i]:
            uni.update(w)
            pair.update(zip(["<s>", *w[:-1]], w))
            context.update(["<s>", *w[:-1]])
    total = sum(uni.values())
    du, dp = (discounts(np.bincount(np.minimum(list(c.values()), TOP + 2), minlength=TOP + 3)) for c in (uni, pair))
    left = lambda c, d: (d[c] if c <= TOP else 1 - REST) * c
    p1 = {w: left(c, du) / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    taken, under = collections.Counter(), collections.Counter()
    for (h, w), c in pair.items():
        taken[h] += left(c, dp) / context[h]
        under[h] += p1[w]

    def p(h, w):
        if (h, w) in pair:
            return left(pair[h, w], dp) / context[h]
        return p1.get(w, unknown) * ((1 - taken[h]) / (1 - under[h]) if h in context else 1)

    for h in ["<s>", *list(uni)[:5]]:
        if h is not None:
            assert sum(p(h, w) for w in uni) + p(h, "never seen") == pytest.approx(1)
    for i, w in token.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(x in uni for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (total + len(uni) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w[:-1]], w)))


def test_line_dedup(spark, corpus):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in drop_repeated_lines(spark.createDataFrame(corpus, SCHEMA)).collect()}
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t, *_ in corpus:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    for i, t, *_ in corpus:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        assert got[i] == (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    assert any(v[1] for v in got.values())


def test_quality_counts(spark, corpus):
    for r in judge_quality(spark.createDataFrame(corpus, SCHEMA)).join(spark.createDataFrame(corpus, SCHEMA).select("doc_id", "text"), "doc_id").collect():
        w = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_leaks_with_edits(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)]
    fold = lambda t: "".join(map(chr, normalise(_points(t), np.zeros(len(_points(t)), int))[0])).strip()
    rows, want = [], set()
    for n in range(80):
        i, t = rng.choice(items)
        s = list(t)
        for _ in range(rng.randint(0, len(t) // 10)):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["z"], [s[p], "y"]])
        rows.append((n, f"{text(30)} {''.join(s).upper()}. {text(20)}"))
        a, b = fold(t), fold("".join(s))
        line = list(range(len(b) + 1))
        for x, c in enumerate(a, 1):
            row = [x]
            for y, d in enumerate(b, 1):
                row.append(min(line[y] + 1, row[-1] + 1, line[y - 1] + (c != d)))
            line = row
        if line[-1] <= int(0.08 * len(a)):
            want.add((n, i))
    rows += [(200, None), (201, ""), (None, items[0][1]), (202, text(300))]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "ab")], "item_id long, text string")).collect()}
    assert want <= got and all(n < 200 for n, _ in got)


def test_main_text():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies</div>'
        "<article><h1>Head &amp; line</h1><p>First   paragraph with <b>bold</b>\n words &lt;here&gt; and enough of them to count.</p><p>Second.<br>part<p>Third unclosed"
        '<form>name <input></form></article><aside>side</aside><div id="comments"><p>A reader says something that is fairly long, too.</p></div><footer>&copy; x</footer></body></html>'
    )
    assert main_text(page) == "Head & line\n\nFirst paragraph with bold words <here> and enough of them to count.\n\nSecond. part\n\nThird unclosed"
    assert main_text(None) == main_text("") == main_text("<script>var a = '<p>text</p>'</script>") == ""
    plain = "<div class=menu><a>x</a><a>y</a></div><div><p>" + "long text " * 10 + "</p><p>more text here</p></div><div class='footer'>foot</div>"
    assert main_text(plain) == ("long text " * 10).strip() + "\n\nmore text here"


def test_main_text_table(spark):
    rows = [(1, "u", "<p>Some text that is here</p>"), (2, None, None), (None, "v", "")]
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == [(0, "v", "", 0), (1, "u", "Some text that is here", 22), (2, None, "", 0)]


def test_mixing(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    rows = mix_sources(docs, entropy_share=0.98, max_repeats=3.0, block_docs=8).collect()
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in corpus)
    spent = collections.Counter()
    for r in rows:
        spent[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    entropy = -sum(w * math.log2(w) for w in weight.values())
    assert entropy >= 0.98 * math.log2(len(weight)) - 1e-4
    size = collections.Counter()
    for _, t, _, s, *_ in corpus:
        size[s] += len(WORD.findall(t or ""))
    for s, w in weight.items():
        assert spent[s] <= w * total + 1 and w * total / size[s] <= 3.001
    seen = collections.Counter((r.doc_id, r.epoch) for r in rows)
    assert max(seen.values()) == 1
    assert len({r.place for r in rows}) == len(rows)


LANGS = {"en": "the of and to in is that it was for on are".split(), "fr": "le la les des une est pour qui dans avec sur être".split(), "de": "der die und das nicht ein für ist auf über mit sich".split()}


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(LANGS[l]) for _ in range(12)), l) for i in range(300) for l in [list(LANGS)[i % 3]]]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "fr"), (903, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = {r.doc_id: r for r in identify_languages(docs, ~held).collect()}
    assert len(got) == len(rows) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "en"
    right = [got[i].lang_pred == l for i, _, l in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_and_cotraining(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [rng.choice(plain) for _ in range(40)]
        if bad:
            w[3] = rng.choice(["vile", "nasty"])
        junk = i % 3 == 0
        rows.append((i, (" | ".join if junk else " ".join)(w), "en", f"s{i % 4 + 4 * junk}", 100))
        if i % 2 == 0:
            labels.append((i, int(not junk), int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", "en", "s0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    tox = {r.doc_id: r.score for r in score_toxicity(docs, marks, learn).collect()}
    assert len(tox) == 602 and all(0 <= s <= 1 for s in tox.values())
    right = [(tox[i] >= 0.7) == (i % 5 == 0) for i in range(600)]
    assert sum(right) / 600 > 0.97 and tox[1000] < 0.7 and tox[1001] < 0.7
    good = {r.doc_id: r for r in score_quality(docs, marks, learn).collect()}
    right = [good[i].kept == (i % 3 != 0) for i in range(600)]
    assert sum(right) / 600 > 0.97 and len(good) == 602


@pytest.mark.parametrize("job", ["join", "katz", "lines", "rules", "leaks", "pages", "mix", "lang", "tox", "quality"])
def test_empty_tables(spark, job):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = {
        "join": lambda: ngram_jaccard_groups(docs), "katz": lambda: katz_scores(docs, held), "lines": lambda: drop_repeated_lines(docs), "rules": lambda: judge_quality(docs),
        "leaks": lambda: find_leaks(docs, spark.createDataFrame([], "item_id long, text string")), "pages": lambda: extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")),
        "mix": lambda: mix_sources(docs), "lang": lambda: identify_languages(docs, ~held), "tox": lambda: score_toxicity(docs, labels, ~held), "quality": lambda: score_quality(docs, labels, ~held),
    }[job]()
    assert out.collect() == []


def test_main_text_of_layout_wrappers():
    words = "A sentence of the article that has words enough to count as its text."
    body = f"<h1>Title</h1><p>{words}</p><p>Second.</p>"
    want = f"Title\n\n{words}\n\nSecond."
    for attributes in ('class="content" style="overflow:hidden"', 'class="overflow-hidden"', 'class="layout with-sidebar"', 'class="has-sidebar"', 'class="no-sidebar has-comments"', 'class="row sidebar"', "data-hidden=x", 'class="col col--with-ads"'):
        assert main_text(f"<body><nav>Home</nav><div {attributes}><article>{body}</article></div><footer>x</footer></body>") == want
        if "row" not in attributes:
            assert main_text(f"<body><nav>Home</nav><div {attributes}><div>{body}</div></div><footer>x</footer></body>") == want
    for attributes in ("hidden", 'hidden=""', 'style="color:red; display: none"', 'aria-hidden="true"', 'class="main-sidebar"', 'id="comments"', 'class="cookie-notice with-border"'):
        assert main_text(f"<body><div {attributes}><p>{words} Not of it.</p></div><article>{body}</article></body>") == want
    comments = f'<section id="comments"><article><p>{words} {words} A comment.</p></article></section>'
    assert main_text(f"<body><article>{body}{comments}<p>End.</p></article></body>") == want + "\n\nEnd."
    assert main_text(f'<body><form id="f"><div><article>{body}</article></div></form></body>') == want


def test_main_text_implied_ends():
    words = "A sentence of the article that has words enough to count as its text."
    assert main_text(f'<body><div><p class="notice">Note<p>{words}<p>B</div></body>') == f"{words}\n\nB"
    assert main_text(f'<body><div><p class="notice">Note</div><div><p>{words}<p>B</div></body>') == f"{words}\n\nB"
    assert main_text(f'<body><ul><li class="menu-item">x<li class="menu-item">y</ul><div><p>{words}</p><ul><li>one<li>two</ul></div></body>') == f"{words}\n\none\n\ntwo"
    assert main_text(f'<body><table><tr><td class="ad">x<td><p>{words}<tr><td>B</table></body>') == f"{words}\n\nB"
    assert main_text(f'<body><div class="ad"><div>x</div><p>y</div><p>{words}</p></body>') == words
    assert main_text(f'<body><ul><li class="menu-item">x<ul><li>y<li>z</ul>w<li>{words}</ul></body>') == words


def test_main_text_goes_on_behind_skipped_parts():
    a, b = "The first half of an article, with words enough to count as a text.", "The second half of it, which has just as many words as the first one."
    for gap in ('<div class="ad">x</div>', "<aside>x</aside>", "<form>x</form>", "<button>x</button>", '<p class="notice">x', "<nav><ul><li>x</ul></nav>"):
        for page in (
            f"<div><p>{a}</p>{gap}<p>{b}</p></div>",
            f"<p>{a}</p>{gap}<p>{b}</p>",
            f"<div id=c><section><p>{a}</p></section>{gap}<section><p>{b}</p></section></div>",
            f"<div id=c><div>{a}</div>{gap}<div>{b}</div></div>",
        ):
            assert main_text(f"<body><nav>Home</nav>{page}<footer>foot</footer></body>") == f"{a}\n\n{b}"
        assert main_text(f"<body><div><h1>Head</h1><p>By N.</p><p>One</p><p>Two</p><p>{a}</p>{gap}<p>Short.</p>{gap}<p>{b}</p>{gap}<p>End.</p></div></body>") == f"Head\n\nBy N.\n\nOne\n\nTwo\n\n{a}\n\nShort.\n\n{b}\n\nEnd."
        assert main_text(f"<body><div><p>Home</p></div>{gap}<div><p>{a}</p>{gap}<p>{b}</p></div></body>") == f"{a}\n\n{b}"
        assert main_text(f"<body><p>One</p>{gap}<p>Two</p></body>") == "One\n\nTwo"


def test_quality_references_by_language(spark):
    rng = random.Random(5)
    text = lambda letters, n, long: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(*long))) for _ in range(n))
    other = [chr(k) for k in range(0x4E00, 0x4E80)]
    en = [(i, text("abcdefghilmnorstu", 120, (2, 7)), "en") for i in range(60)]
    few_words = [(1000 + i, text(other, 20, (10, 30)), "zh") for i in range(25)]
    short = [(2000 + i, text("бвгджзклмнопрст", 40, (3, 8)), "ru") for i in range(25)]
    rare = [(3000 + i, text("αβγδεζηθικλ", 120, (3, 8)), "el") for i in range(19)]
    junk = [(4000, "a=1;b>2 " * 4 + text("0123456789{}[]<>", 90, (2, 9)), "en"), (4001, text("0123456789{}[]<>", 90, (2, 9)), "zh")]
    rows = en + few_words + short + rare + junk
    schema = "doc_id long, text string, lang string"
    got = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, schema)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {4000, 4001}
    assert all(got[i].class_distance is not None and got[i].word_distance is None for i, *_ in few_words + short)
    assert all(got[i].class_distance is None and got[i].word_distance is None for i, *_ in rare)
    assert all(got[i].class_distance is not None and got[i].word_distance is not None for i, *_ in en)
    # the same texts of a small table
    assert all(r.kept for r in judge_quality(spark.createDataFrame(en + few_words[:5] + short[:5] + rare[:5], schema)).collect())


@pytest.mark.parametrize("small", [0, 200_000])
def test_components_by_broadcast_and_by_shuffle(spark, monkeypatch, small):
    from tagloom.llm import graph
    from tagloom.llm.common import Stash

    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (500, 400), (400, 500)]
    least = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in range(len(least)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Stash(spark)).collect()
    assert {r.id: r.component for r in got} == least and len(got) == len(least)
