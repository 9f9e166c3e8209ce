"""Which outlets a text cites: all names in one pass over its sentences, then rules on what stands around each.

Sentences are rows. One automaton over the names of all outlets finds mentions; a mention's sides decide
by regular expressions whether it is a citation. Lists of sources and joint reports are split and joined
to the names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a mention that its rules see, and of the evidence.
BEFORE, AFTER, EVIDENCE = 45, 90, 160

_CLOSE = r"[\s」』》”\"）)]*"
_OPEN = r"[「『《“\"]*"
#: What follows or precedes the name of a cited outlet, and of one that only gave a picture.
REPORTS = rf"^{_CLOSE}(?:[（(][^()（）]{{1,45}}[）)]{_CLOSE})?(?:的)?(?:報導|報道|报道)(?:指出|稱|称|表示|說|说|提到|透露|引述|分析|，|,|：|:|$)"
CREDITED = rf"(?:來源|来源|出處|出处|轉載自|转载自|摘自|編譯自|编译自|編譯[：:／/]|编译[：:／/]|引述|引用|援引|授權自|授权自|授權來源|授权来源)\s*[：:／/]?\s*{_OPEN}\s*$"
LICENSED = rf"^{_CLOSE}(?:授權|授权)(?:刊登|轉載|转载|提供|發布|发布)"
PICTURE = rf"(?:圖片|图片|照片|攝影|摄影|影像|圖|图)\s*(?:來源|来源|出處|出处)\s*[：:]?\s*(?:(?:據|据|根據|根据)\s*)?{_OPEN}\s*$"
ACCORDING = rf"(?:據|据|根據|根据)\s*{_OPEN}\s*$"
INFORMED = rf"^{_CLOSE}援引(?:消息人士|知情人士)(?:報導|報道|报道)(?:稱|称)?(?=[，,:：]|$)"
MESSAGE = rf"^{_CLOSE}(?:的)?消息(?:指出|指|稱|称|表示)[，,:：]"
COMMENTARY = r"^(?:今[（(][0-9]{1,2}[）)]日|[0-9]{1,2}月[0-9]{1,2}日)(?:刊登(?:評論|评论)(?=[，,])|引述)|^星期[一二三四五六日天]在一篇(?:評論|评论)文章中(?=[，,])"
#: A sentence that lists sources, the opening of a joint report, and what parts their names.
LISTED = r"^\s*[（(]?(?:資料來源|参考来源|參考來源|來源|来源)[:：]\s*([^（）()]{2,150})[）)]?\s*$"
JOINT = r"^\s*(?:据|據|根據|根据)(.{2,70}?)等(?:媒体|媒體)(?:報導|報道|报道)(?=[，,:：]|$)"
LIST_PARTS, JOINT_PARTS = r"\s*[,，、]\s*", r"\s*(?:[、，,]|以及|和|與|与|及)\s*"
#: Openings of a body that say whose copy it is.
OPENINGS = (("cna", r"^\s*[（(]\s*中央社(?:記者|记者)[\p{L}·．\s]{2,50}(?:[0-9]{1,2}|[一二三四五六七八九十廿]{1,3})日(?:電|电)\s*[）)]"),)
#: White space of all scripts counts as such.
UNICODE = "(?U)"
SENTENCE_ENDS = r"[。！？!?；;\n]+"

_HAN = re.compile("[㐀-䶿一-鿿豈-﫿〇々]")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _fold(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Names:
    """The names of outlets as one automaton."""

    def __init__(self, outlets: list[tuple[str, list[str], list[str]]]) -> None:
        self.media = [m for m, *_ in outlets]
        self.prefixes = [tuple(_fold(p) for p in prefixes or () if p) for *_, prefixes in outlets]
        owners: dict[str, list[int]] = {}
        for i, (_, aliases, _) in enumerate(outlets):
            for alias in {_fold(a) for a in aliases or () if a}:
                owners.setdefault(alias, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for alias, who in owners.items():
            self.automaton.add_word(alias, (len(alias), bool(_HAN.search(alias)), who))
        if owners:
            self.automaton.make_automaton()

    def mentions(self, sentence: str) -> list[tuple[int, int, int]]:
        """(outlet, start, stop) of each mention: of an outlet's names at a place the longest, none that overlaps an earlier one of the same outlet.

        A name stands alone between letters and digits; one in Han script may follow a digit and precede one.
        After one of its prefixes it is part of another outlet's name.
        """
        if not len(self.automaton):
            return []
        text, hits = _fold(sentence), []
        for end, (size, han, who) in self.automaton.iter(text):
            start, stop = end + 1 - size, end + 1
            if start and text[start - 1] in _WORD:
                continue
            if stop < len(text) and text[stop] in _WORD and not (han and text[stop].isdigit()):
                continue
            hits += [(i, start, -stop) for i in who if not text.endswith(self.prefixes[i], 0, start) or not self.prefixes[i]]
        found, last = [], (-1, 0)
        for i, start, stop in sorted(hits):
            if last[0] != i or start >= last[1]:
                found.append((i, start, -stop))
                last = (i, -stop)
        return found


def _mentions(names: list[tuple[str, list[str], list[str]]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(names)
        for batch in batches:
            row, media, start, stop = [], [], [], []
            for r, sentence in enumerate(batch.column(batch.schema.get_field_index("sentence")).to_pylist()):
                for i, a, z in known.mentions(sentence):
                    row.append(r)
                    media.append(known.media[i])
                    start.append(a)
                    stop.append(z)
            taken = [c.take(pa.array(row, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(media, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=[*batch.schema.names, "source", "start", "stop"])

    return rows


def mentions(sentences: DataFrame, outlets: DataFrame, block_chars: int = 1 << 20) -> DataFrame:
    """Rows of ``sentences`` (with a column sentence) for each mention of one of ``outlets`` (media, aliases, prefixes): source, start, stop.

    Outlets are dealt by a hash to blocks of about ``block_chars`` characters of names; one automaton at a time goes to the executors.
    """
    sized = outlets.where("media IS NOT NULL").select("media", "aliases", "prefixes")
    chars = sized.agg(F.sum(F.length(F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "")))).first()[0] or 0
    blocks = -(-2 * chars // block_chars) if chars > block_chars else 1
    schema = ", ".join(f"`{n}` {t}" for n, t in sentences.dtypes) + ", source string, start int, stop int"
    out = None
    for b in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("media"), F.lit(blocks)) == b).orderBy("media").collect()  # about half of block_chars, or all if less than that
        found = sentences.mapInArrow(_mentions([tuple(r) for r in block]), schema)
        out = found if out is None else out.unionAll(found)
    return out


def cites(before: Column, after: Column) -> Column:
    """Whether what stands before and after a name makes it a citation; the credit of a picture is none."""
    says = lambda c, p: F.rlike(c, F.lit(UNICODE + p))
    according = says(before, ACCORDING)
    told = says(after, REPORTS) | says(before, CREDITED) | says(after, LICENSED) | (according & says(after, INFORMED)) | (according & says(after, MESSAGE)) | says(after, COMMENTARY)
    return ~says(before, PICTURE) & told


def _evidence(text: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(text, UNICODE + r"\s+", " ")), F.lit(EVIDENCE))


def citations(texts: DataFrame, outlets: DataFrame) -> DataFrame:
    """id, source, rule and evidence of the first citation of each outlet in ``texts`` (id, media, body), but of the text's own.

    ``outlets`` are rows (media, aliases, prefixes); a text's own outlet is the one that has its media as
    its id or as a name. Rules: *opening* before all, then by sentence *list*, *joint* and *mention*.
    Texts without id and null bodies cite nothing; rows that repeat an id are told together; of outlets that
    share a name each is cited. A null media is no outlet's.
    """
    single = outlets.where("media IS NOT NULL").groupBy("media").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("prefixes", F.array().cast("array<string>"))))).alias("prefixes"))
    names = single.select(F.col("media").alias("source"), F.explode(F.array_distinct(F.transform("aliases", lambda a: F.lower(a)))).alias("name")).where("name <> ''")
    rows = texts.select("id", "media", "body").where("id IS NOT NULL AND body IS NOT NULL")
    sentences = rows.select("id", F.posexplode(F.split("body", SENTENCE_ENDS)).alias("at", "sentence")).where("sentence <> ''")
    found = mentions(sentences, single)
    before = F.substring("sentence", F.greatest(F.col("start") - BEFORE, F.lit(0)) + 1, F.least(F.col("start"), F.lit(BEFORE)))
    after = F.substring("sentence", F.col("stop") + 1, F.lit(AFTER))
    from_ = F.greatest(F.col("start") - BEFORE, F.lit(0))
    shown = F.substring("sentence", from_ + 1, F.greatest(F.col("stop"), from_ + EVIDENCE) - from_)
    mentioned = found.where(cites(before, after)).select("id", "source", "at", F.lit(3).alias("rule"), "start", shown.alias("evidence"))
    parts = []
    for rule, pattern, between in ((1, LISTED, LIST_PARTS), (2, JOINT, JOINT_PARTS)):
        listed = sentences.where(F.rlike("sentence", F.lit(UNICODE + pattern))).select("id", "at", F.regexp_extract("sentence", UNICODE + pattern, 0).alias("evidence"), F.posexplode(F.split(F.regexp_extract("sentence", UNICODE + pattern, 1), UNICODE + between)).alias("start", "label"))
        label = F.regexp_replace(F.trim(F.regexp_replace("label", UNICODE + r"^\s+|\s+$", "")), "^[「『《“\"]|[」』》”\"]$", "")
        parts.append(listed.withColumn("name", F.lower(label)).join(names, "name").select("id", "source", "at", F.lit(rule).alias("rule"), "start", "evidence"))
    for media, pattern in OPENINGS:
        opened = rows.where(F.rlike("body", F.lit(UNICODE + pattern))).select("id", F.lit(media).alias("source"), F.lit(-1).alias("at"), F.lit(0).alias("rule"), F.lit(0).alias("start"), F.regexp_extract("body", UNICODE + pattern, 0).alias("evidence"))
        parts.append(opened)
    every = mentioned
    for p in parts:
        every = every.unionByName(p)
    own_names = names.unionByName(single.select(F.col("media").alias("source"), F.lower("media").alias("name"))).distinct()
    own = rows.select("id", "media", F.lower(F.trim("media")).alias("name")).distinct().join(own_names, "name", "left").select("id", F.coalesce("source", "media").alias("source")).distinct()
    first = F.min(F.struct("at", "rule", "start", "evidence")).alias("x")
    rule = F.element_at(F.array(*map(F.lit, ("opening", "list", "joint", "mention"))), F.col("x.rule") + 1)
    return every.join(own, ["id", "source"], "left_anti").groupBy("id", "source").agg(first).select("id", "source", rule.alias("rule"), _evidence(F.col("x.evidence")).alias("evidence"))
