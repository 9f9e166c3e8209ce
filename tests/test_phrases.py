"""Conversion by phrases against a version that tries every phrase at every place."""

import random

from tagloom.operators.phrases import Phrases, converted

#: Simplified and traditional forms whose phrases override their characters.
TABLE = [("后", "後"), ("皇后", "皇后"), ("发", "發"), ("头发", "頭髮"), ("理发", "理髮"), ("头", "頭"), ("里", "裡"), ("公里", "公里"), ("台", "臺"), ("面", "面"), ("面条", "麵條"), ("条", "條"), ("干", "乾"), ("干部", "幹部"), ("干部门", "幹部門"), ("a", "bb"), ("aa", "a"), ("aab", "")]


def plain(text, table=TABLE):
    known, out, at = dict(table), "", 0
    while at < len(text):
        size = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in known), 0)
        out += known[text[at : at + size]] if size else text[at]
        at += size or 1
    return out


def test_longest_phrase_first():
    p = Phrases(TABLE)
    assert p.convert("皇后后来在公里里理发，头发干，干部门") == "皇后後來在公里裡理髮，頭髮乾，幹部門".replace("來", "来")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("后皇发头理里公干部门面条ab台x") for _ in range(rng.randint(0, 12)))
        assert p.convert(t) == plain(t)
    assert Phrases([]).convert("后") == "后"


def test_rows(spark):
    rows = spark.createDataFrame([(1, "头发", "头发"), (2, None, "x"), (3, "", None), (4, "后" * 200_000 + "皇后", "y")], "id int, body string, phrase string")
    table = spark.createDataFrame([*TABLE, ("头", "z"), ("", "q"), (None, "q"), ("x", None)], "phrase string, other string")
    got = {r.id: (r.body, r.phrase) for r in converted(rows, table, "body").collect()}
    assert got == {1: ("頭髮", "头发"), 2: (None, "x"), 3: ("", None), 4: ("後" * 200_000 + "皇后", "y")}
    assert converted(rows, table.limit(0), "body").count() == 4
