"""Pages as a table of elements and texts, so that extraction is joins and aggregates.

A row is an element or a text in document order. ``node`` counts from 0, ``stop`` is the number after the
last row inside, ``path`` has the elements around it from the outside in. ``para``, ``form`` and ``link``
are the innermost p, form and a around a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end, elements that end an open p, and which open ones the start of an element ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which an end tag or the start of a like element doesn't reach.
SCOPE = frozenset(("table", "ul", "ol", "dl", "select"))

SCHEMA = "node int, stop int, tag string, attributes map<string,string>, path array<int>, para int, form int, link int, text string"
_ROW = pa.struct([
    ("node", pa.int32()), ("stop", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("path", pa.list_(pa.int32())),
    ("para", pa.int32()), ("form", pa.int32()), ("link", pa.int32()), ("text", pa.string()),
])


class _Rows(HTMLParser):
    """The rows of one page; its elements end where HTML ends them, and all at the end of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def _add(self, tag: str, attributes: dict | None, text: str | None) -> int:
        around = {tag: n for n in self.open for tag in [self.rows[n]["tag"]]}  # the innermost of each tag
        self.rows.append({"node": len(self.rows), "stop": 0, "tag": tag, "attributes": attributes, "path": [*self.open], "para": around.get("p"), "form": around.get("form"), "link": around.get("a"), "text": text})
        return len(self.rows) - 1

    def _close(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.rows[n]["stop"] = len(self.rows)
        del self.open[depth:]

    def _innermost(self, tags: tuple[str, ...]) -> int | None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.rows[self.open[depth]]["tag"]
            if tag in tags:
                return depth
            if tag in SCOPE:
                return None
        return None

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        like = ("p",) if tag in ENDS_P else ENDS_LIKE.get(tag, ())
        while (depth := self._innermost(like)) is not None:
            self._close(depth)
        node = self._add(tag, {k: v or "" for k, v in reversed(attributes)}, None)
        if tag in VOID:
            self.rows[node]["stop"] = node + 1
        else:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        depth = self._innermost((tag,))
        if depth is not None:
            self._close(depth)

    def handle_data(self, data: str) -> None:
        node = self._add("#text", None, data)
        self.rows[node]["stop"] = node + 1

    def close(self) -> None:
        super().close()
        self._close(0)


def page_rows(html: str | None) -> list[dict]:
    """The rows of one page; null is empty."""
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a page's rows leave memory before the next page is read
            rows = [r | {"attributes": None if r["attributes"] is None else list(r["attributes"].items())} for r in page_rows(batch.column(1)[i].as_py())]
            table = pa.array(rows, _ROW)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type), *table.flatten()], names=["page_id", *(f.name for f in _ROW)])


def elements(pages: DataFrame) -> DataFrame:
    """The elements and texts of ``pages`` (page_id, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_parse, f"page_id {kind}, {SCHEMA}")


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def keys(tag: Column, attributes: Column) -> Column:
    """What simple selectors name an element by: tag, ``#id``, ``.class``, ``[name]`` and ``[name=value]``."""
    classes = F.transform(F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))
    ids = F.transform(F.filter(F.array(attributes["id"]), lambda i: i.isNotNull()), lambda i: F.concat(F.lit("#"), i))
    named = F.flatten(F.transform(F.map_entries(attributes), lambda e: F.array(F.concat(F.lit("["), e["key"], F.lit("]")), F.concat(F.lit("["), e["key"], F.lit("="), e["value"], F.lit("]")))))
    return F.array_distinct(F.concat(F.array(tag), classes, ids, named))


#: White space, as a character class of regular expressions (fixed values: the ECMAScript set), and characters without width.
WHITE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ZERO_WIDTH = r"[\u200b-\u200d\ufeff]"


def plain(text: Column) -> Column:
    """Text without zero-width characters, with one space for each run of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), f"[{WHITE}]+", " "))


def content_length(text: Column) -> Column:
    """Code points other than white space."""
    return F.length(F.regexp_replace(text, f"[{WHITE}]", ""))
