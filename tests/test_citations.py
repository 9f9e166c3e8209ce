"""Citations against one regular expression for each outlet."""

import random
import re

import regex

from tagloom.operators import citations as C

SF = "/root/testdata/sf0.001"
OUTLETS = [
    ("econ", ["經濟日報", "Economic Daily"], ["香港", "深圳"]), ("hkecon", ["香港經濟日報"], []), ("weekly", ["今周刊", "今周刊網"], None), ("reuters", ["路透社", "Reuters", "路透"], []), ("cna", ["中央社"], []),
    ("bbc", ["BBC", "BBC News"], []), ("xinhua", ["新华社", "新華社"], []), ("people", ["人民日报"], []), ("empty", [], []), ("none", None, None), ("dot", ["A.B+C"], []),
]
PLANTED = [
    "據經濟日報報導，明日有雨", "據香港經濟日報報導指出，明日有雨", "深圳經濟日報報道，有事", "Reuters報導稱", "xReuters報導稱", "reuters的報導說話", "Reuters2報導，", "路透社2日報導，", "2路透社報導，", "BBC News（倫敦）報導：事", "BBCs報導，事",
    "圖片來源：路透社", "照片來源：據BBC", "來源：路透社", "（資料來源：路透社、「BBC」、今周刊網）", "根据新华社、人民日报和BBC等媒体报道，事", "轉載自《今周刊》", "今周刊網授權轉載", "據BBC援引消息人士報導，事", "據路透社消息指出，事",
    "BBC3月4日刊登評論，事", "人民日报星期三在一篇评论文章中，事", "有人看BBC", "A.B+C報導，x", "AXB+C報導，x", "（中央社記者王小明台北5日電）", "路透社路透報導，", "經濟日報" + "（" + "字" * 50 + "）報導，", "引述" + "「" * 50 + "BBC", "BBC " * 60 + "報導，",
]


def brute(rows, outlets=OUTLETS):
    says = lambda p, t: regex.search(p, t) is not None
    names = {}
    for m, aliases, _ in outlets:
        for a in aliases or []:
            names.setdefault(a.lower(), set()).add(m)
    out = {}
    for i, media, body in rows:
        if i is None or body is None:
            continue
        own = {m for m, aliases, _ in outlets if media and media.strip().lower() in [m.lower(), *(a.lower() for a in aliases or [])]} or {media}
        found = []
        for m, p in C.OPENINGS:
            if says(p, body):
                found.append((-1, 0, 0, regex.search(p, body)[0], m))
        for at, s in enumerate(re.split(C.SENTENCE_ENDS, body)):
            for rule, p, cut in ((1, C.LISTED, C.LIST_PARTS), (2, C.JOINT, C.JOINT_PARTS)):
                if got := regex.search(p, s):
                    for k, label in enumerate(re.split(cut, got[1])):
                        label = re.sub("^[「『《“\"]|[」』》”\"]$", "", label.strip())
                        found += [(at, rule, k, got[0], m) for m in names.get(label.lower(), ())]
            for m, aliases, prefixes in outlets:
                if not aliases:
                    continue
                alias = "|".join(re.escape(a) + ("(?![A-Za-z_])" if C._HAN.search(a) else "(?![A-Za-z0-9_])") for a in sorted(aliases, key=len, reverse=True))
                guard = "".join(f"(?<!{re.escape(p)})" for p in prefixes or [])
                for x in re.finditer(f"(?<![A-Za-z0-9_]){guard}(?:{alias})", s, re.I):
                    before, after = s[max(0, x.start() - 45) : x.start()], s[x.end() : x.end() + 90]
                    according = says(C.ACCORDING, before)
                    if not says(C.PICTURE, before) and (says(C.REPORTS, after) or says(C.CREDITED, before) or says(C.LICENSED, after) or according and (says(C.INFORMED, after) or says(C.MESSAGE, after)) or says(C.COMMENTARY, after)):
                        a = max(0, x.start() - 45)
                        found.append((at, 3, x.start(), s[a : max(x.end(), a + 160)], m))
        for at, rule, start, text, m in sorted(found):
            if m not in own and (i, m) not in out:
                out[i, m] = (("opening", "list", "joint", "mention")[rule], re.sub(r"\s+", " ", text).strip()[:160])
    return out


def outlets(spark):
    return spark.createDataFrame(OUTLETS, "media string, aliases array<string>, prefixes array<string>")


def got(frame):
    return {(r.id, r.source): (r.rule, r.evidence) for r in frame.collect()}


def test_planted(spark):
    rng = random.Random(3)
    rows = [(i, "x", p) for i, p in enumerate(PLANTED)]
    rows += [(100 + i, rng.choice(["bbc", "路透社", "REUTERS ", None, "x"]), rng.choice(["。", "\n", "!"]).join(rng.sample(PLANTED, 4))) for i in range(150)]
    rows += [(900, "x", None), (None, "x", PLANTED[0]), (901, "x", ""), (902, "x", "。。\n"), (903, "x", PLANTED[0] + "。" + "字" * 300_000 + "。" + PLANTED[3]), (1, "x", PLANTED[13])]
    frame = spark.createDataFrame([(*r, 1, "s", "e") for r in rows], "id long, media string, body string, start int, sentence string, evidence string")
    want = brute([r for r in rows if r[0] != 1])
    found = got(C.citations(frame, outlets(spark)))
    assert {k: v for k, v in found.items() if k[0] != 1} == want
    assert {k for k in found if k[0] == 1} == {(1, "hkecon"), (1, "reuters")}
    cited = lambda i: {m for k, m in want if k == i}
    assert cited(0) == {"econ"} and cited(2) == set() and cited(4) == set() and cited(11) == set() and cited(14) == {"reuters", "bbc", "weekly"} and cited(15) == {"xinhua", "people", "bbc"}
    assert want[25, "cna"][0] == "opening"


def test_blocks_of_names_and_empty_tables(spark):
    rows = [(i, "x", p) for i, p in enumerate(PLANTED)]
    sentences = spark.createDataFrame([(i, p) for i, _, p in rows], "id long, sentence string")
    one, many = (sorted(map(tuple, C.mentions(sentences, outlets(spark), n).collect())) for n in (1 << 20, 12))
    assert one == many and one
    frame = spark.createDataFrame(rows, "id long, media string, body string")
    assert got(C.citations(frame, outlets(spark).limit(0))).keys() <= {(25, "cna")}
    assert got(C.citations(frame.limit(0), outlets(spark))) == {}


def test_planted_in_documents(spark):
    docs = [(r.doc_id, r.source, f"{r.text}\n{PLANTED[r.doc_id % len(PLANTED)]}" if r.doc_id % 2 else r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = spark.createDataFrame(docs, "id long, media string, body string")
    want = brute(docs)
    assert got(C.citations(frame, outlets(spark))) == want and len(want) > 50
