"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element is a line, whose length is that of its text outside
links. Lengths are summed over sliding windows of lines: a *surge* is where a sum rises to the
threshold, a *dive* where the sums fall below it again. The text between a surge and its dive is
text of the page's body; where several containers hold such text, the one with nearly all of it
is the main text, from its first line to its last. Tags and class words do two things only: they
take out the parts that never belong to an article (menus, footers, adverts, forms, reader comments
and the like) and break ties between containers.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that never hold text of an article, containers beside it, elements that start a line, elements without an end.
NEVER = frozenset("script style noscript template svg iframe button select textarea object canvas head dialog menu map audio video".split())
BESIDE = frozenset("nav footer aside form header".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr td th caption section article main body html blockquote pre figure figcaption address header hr details summary center".split())
VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
#: Block elements that are text of the container they lie in; elements that are text themselves.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr center".split())
PHRASES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th span a b i em strong small label time abbr".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
_ALL_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Class words and ids of parts beside an article; those that also name what isn't; reader comments.
_SURE = r"ad|ads|advert\w*|adsense|adslot|banner|sponsor\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|pagination|contentinfo|complementary"
_MAYBE = r"promo\w*|overlay|share|sharing|social|related|recommend\w*|subscription|signup|login|search|toolbar|pager|widget|alert"
_READERS = r"comments?|comment-?list|disqus|repl(?:y|ies)"
_AFTER = r"(?:[-_]+(?:container|wrapper|wrap|box|bar|block|list|section|area|links?|buttons?|items?|top|bottom|left|right|inner|outer|slot|unit|form|message|text|panel|content|thread|body|\d+|" + f"{_SURE}|{_MAYBE}|{_READERS}))*"
_WORD = re.compile(rf"(?:[a-z0-9]+[-_]+){{0,3}}?(?:({_READERS})|({_SURE})|({_MAYBE})){_AFTER}", re.I)
#: A layout wrapper says so of what it holds beside other text: with-sidebar, has-comments, no-ads.
_MODIFIED = re.compile(r"(?:^|[_-])(?:with|without|has|have|no|non|not)[_-]", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)/?>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements that end an open p as they start; what keeps an end tag or an item from reaching further out.
_ENDS_P = (BLOCKS | {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "dir", "search", "hgroup"}) - {"html", "body", "thead", "tbody", "tr", "td", "th", "caption", "summary"}
_SCOPE = ("table", "td", "th", "caption", "object", "html")
_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "thead": ("thead", "tbody", "tfoot", "caption"), "tbody": ("thead", "tbody", "tfoot", "caption"), "tfoot": ("thead", "tbody", "tfoot", "caption")}
_LIST = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_HEAD = frozenset("head title meta link base script style noscript template".split())
WINDOW = 3
#: What an element may be besides plain: no text ever, a container by its tag, by class words that are sure or only may say so, comments.
PLAIN, GONE, TAG, SURE, MAYBE, READERS = range(6)


def mark_of(name: str, attributes: str, inside: bool = False) -> int:
    """What tag, class words, id, role or the hidden attribute make of an element; ``inside``: of one in an article.

    A heading's words say what it is about, not what it is. So does the id of a section in an article, unless
    it is one of reader comments or an advert.
    """
    topic = name in _ALL_HEADINGS
    if name in NEVER:
        return GONE
    found = TAG if name in BESIDE else PLAIN
    if found or name in ("body", "html") or not attributes or attributes.isspace():
        return found
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" and values[0].lower() != "false":
            return GONE
        if key in ("class", "id", "role") and not found:
            for word in (values[0] or values[1] or values[2]).split():
                m = _WORD.fullmatch(word)
                about = topic or inside and name == "section" and key == "id" and m and not m[1] and not word.lower().startswith("ad")
                if m and not about and not _MODIFIED.search(word):
                    found = READERS if m[1] else found or (SURE if m[2] else MAYBE)
    if name in ("article", "main") and found != READERS:
        return PLAIN
    return found


class Page:
    """The lines of a page and the tree of its elements. Start and end tags end what HTML lets them end.

    Inline elements are kept only where a mark makes them, or an element around them, a part that may go.
    """

    def __init__(self, page: str) -> None:
        self.kinds, self.parents, self.marks, self.ended = [""], [0], [PLAIN], [True]
        self.text: list[str] = []
        self.plain: list[int] = []
        self.place: list[int] = []
        self.title = ""
        self.names: list[str] = []
        self.ids: list[int] = []
        self.at: dict[str, list[int]] = {}
        self._read(page)

    def push(self, name: str, mark: int) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.kinds.append(name)
        self.parents.append(self.ids[-1] if self.ids else 0)
        self.marks.append(mark)
        self.ended.append(False)
        self.names.append(name)
        self.ids.append(len(self.kinds) - 1)

    def cut(self, size: int) -> None:
        while len(self.names) > size:
            self.at[self.names.pop()].pop()
            self.ids.pop()

    def last(self, *names: str) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def start(self, name: str) -> None:
        """End what the start tag of ``name`` ends."""
        if name not in _HEAD and (k := self.last("head")) >= 0:
            self.cut(k)
        if name in _ITEM and (k := self.last(*_ITEM[name])) > self.last("table", *_LIST.get(name, ())):
            self.cut(k)
        if name in _ENDS_P and (k := self.last("p")) > self.last(*_SCOPE):
            self.cut(k)

    def end(self, name: str) -> None:
        if (k := self.last(name)) >= 0 and (name in _SCOPE or name in _ITEM and name not in _LIST or k > self.last(*_SCOPE)):
            self.ended[self.ids[k]] = True
            self.cut(k)

    def _read(self, page: str) -> None:
        parts: list[str] = []
        at = linked = 0
        link = False
        marked: list[int] = []  # open elements outside each open marked one

        def close() -> None:
            nonlocal linked
            if parts:
                raw = "".join(parts)
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text:
                    self.text.append(text)
                    self.plain.append(max(0, len(text) - linked))
                    self.place.append(self.ids[-1] if self.ids else 0)
                parts.clear()
            linked = 0

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                parts.append(page[at : m.start()])
                if link:
                    linked += m.start() - at
            at = m.end()
            name = m[4]
            if name is None:
                if m[1] and m[1].lower() == "title" and not self.title:
                    self.title = " ".join(html.unescape(m[2]).split())
                continue
            name, closing = name.lower(), bool(m[3])
            block = name in BLOCKS
            if name == "a":
                link = not closing
            elif name == "br":
                parts.append(" ")
            if block or name in BESIDE or name in NEVER or (closing and marked and self.names[marked[-1]] == name):
                close()
            if closing:
                self.end(name)
            else:
                self.start(name)
                if name not in VOID and not m[5].rstrip().endswith("/"):
                    mark = mark_of(name, m[5], self.last("article", "main") >= 0)
                    if mark == TAG and name == "header" and self.last("article", "main") >= 0:
                        mark = PLAIN
                    if mark:
                        close()
                        marked.append(len(self.names))
                    if mark or marked or block or name in _SCOPE:
                        self.push(name, mark)
            while marked and len(self.names) <= marked[-1]:
                marked.pop()
        if at < len(page):
            tail = page[at:]
            parts.append(tail[: tail.rfind("<")] if re.search(r"<[/a-zA-Z!?][^>]*\Z", tail) else tail)
        close()


def _gone(page: Page) -> list[bool]:
    """Whether each element is, or lies in, a part that is no text of an article.

    A marked container goes unless it holds the page's text: as long as what lies outside all marked
    parts (four times as long where an article is there) and with an article, a heading or two long lines in it.
    """
    n = len(page.kinds)
    nearest, article = [0] * n, [0] * n
    for e in range(1, n):
        nearest[e] = e if page.marks[e] else nearest[page.parents[e]]
    size, longest, plain, has, head = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for text, free, e in zip(page.text, page.plain, page.place):
        k = nearest[e]
        size[k] += len(text)
        plain[k] += free
        longest[k] += free >= 80
    for e in range(1, n):
        has[nearest[e]] |= page.kinds[e] in ("article", "main")
        head[nearest[e]] |= page.kinds[e] == "h1"
    # an article in parts of parts counts for all around it
    for e in range(n - 1, 0, -1):
        if page.marks[e] and page.marks[e] != GONE:
            article[e] |= has[e]
            up = nearest[page.parents[e]]
            article[up] |= article[e]
    outside, lead = size[0], has[0]
    gone = [False] * n
    for e in range(1, n):
        mark = page.marks[e]
        if gone[page.parents[e]] or mark == GONE:
            gone[e] = True
        elif mark:
            name = page.kinds[e]
            big = size[e] > (4 * outside if lead else outside)
            if mark == TAG and name != "form":
                stays = not lead and (article[e] or not page.ended[e]) and (big or article[e] and not size[e])
            else:
                stays = (big and (article[e] or head[e] or longest[e] >= 2)) or (not lead and article[e] and not size[e])
                if mark == READERS and outside >= 200:
                    stays = False
                if not page.ended[e] and name not in PHRASES and name not in _ITEM and big:
                    stays = True
            if mark == MAYBE and name in PHRASES and 2 * plain[e] > size[e]:
                stays = True
            if stays:
                outside += size[e]
                lead = lead or has[e]
            gone[e] = not stays
    return gone


def _regions(length: list[int], threshold: int) -> list[tuple[int, int]]:
    """(first, stop) lines between each surge of the window sums to the threshold and the dive below it."""
    sums = [sum(length[i : i + WINDOW]) for i in range(len(length))]
    found, start = [], None
    for i, s in enumerate(sums):
        if s >= threshold:
            start = i if start is None else start
        elif start is not None:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(sums)))
    return found


def main_text(page: str | None, threshold: int = 40) -> str:
    """The main text of a page; empty without one. Block texts are joined by an empty line."""
    tree = Page(page or "")
    gone = _gone(tree)
    kept = [i for i, e in enumerate(tree.place) if not gone[e]]
    if not kept:
        return ""
    # a skipped part is one line without length
    index: list[int] = []
    for i in kept:
        if index and i - 1 > index[-1]:
            index.append(-1)
        index.append(i)
    length = [0 if i < 0 else tree.plain[i] for i in index]
    inside = [False] * len(index)
    for a, b in _regions(length, threshold):
        inside[a:b] = [True] * (b - a)
    core = [i for i, ok in zip(index, inside) if ok and i >= 0] or kept
    weight = {i: tree.plain[i] for i in core}
    articles = any(k in ("article", "main") and not g for k, g in zip(tree.kinds, gone))
    if not any(weight.values()):
        if not articles:
            return ""
        weight = {i: len(tree.text[i]) for i in core}
    home = _containers(tree)
    place = _main_container(tree, home, gone, kept, weight, threshold)
    chosen = _lines_of(tree, home, kept, set(core), place)
    return "\n\n".join(tree.text[i] for i in chosen)


def _containers(tree: Page) -> list[int]:
    """The container of each element: the element itself unless it is text of the one around it. A table cell with three lines or more is a container."""
    lines = [0] * len(tree.kinds)
    for e in tree.place:
        lines[e] += 1
    for e in range(len(lines) - 1, 0, -1):
        lines[tree.parents[e]] += lines[e]
    home = [0] * len(tree.kinds)
    for e in range(1, len(home)):
        kind = tree.kinds[e]
        text = kind in TEXT and not (kind == "td" and lines[e] >= 3) or kind not in BLOCKS and kind not in BESIDE
        home[e] = home[tree.parents[e]] if text else e
    return home


def _main_container(tree: Page, home: list[int], gone: list[bool], kept: list[int], weight: dict[int, int], threshold: int) -> int:
    """The innermost container that holds nearly all of the text between surges and dives."""
    n = len(tree.kinds)
    total, direct, count = [0] * n, [0] * n, [0] * n
    for i, w in weight.items():
        k = home[tree.place[i]]
        total[k] += w
        direct[k] += w
        count[k] += 1
    headed = [False] * n
    for i in kept:
        e = tree.place[i]
        while e and tree.kinds[e] in TEXT and tree.kinds[e] not in HEADINGS:
            e = tree.parents[e]
        if tree.kinds[e] in HEADINGS:
            k = home[e]
            headed[k] |= tree.kinds[k] not in ("", "html", "body") or (tree.kinds[e] == "h1" and tree.title.startswith(tree.text[i]))
    inner: list[list[int]] = [[] for _ in range(n)]
    for e in range(n - 1, 0, -1):
        if home[e] == e:
            up = home[tree.parents[e]]
            total[up] += total[e]
            count[up] += count[e]
            if total[e]:
                inner[up].append(e)
    at = 0
    while tree.kinds[at] != "article" and inner[at]:
        best = max(inner[at], key=lambda e: (total[e], -e))
        named = [e for e in inner[at] if tree.kinds[e] in ("article", "main")]
        if named:
            first = max(named, key=lambda e: (total[e], -e))
            if 4 * total[first] >= total[at]:
                if sum(10 * total[e] >= 9 * total[first] for e in named) > 1:  # parts of one text
                    break
                if headed[at] and tree.kinds[at] not in ("", "html", "body"):
                    break
                at = first
                continue
        lone = tree.kinds[at] in ("", "html", "body") and count[best] > 1 and 2 * total[best] >= total[at] and all(count[e] == 1 for e in inner[at] if e != best)
        if direct[at] >= threshold or headed[at] or not (5 * total[best] >= 4 * total[at] or lone):
            break
        at = best
    return at


def _lines_of(tree: Page, home: list[int], kept: list[int], core: set[int], place: int) -> list[int]:
    """The lines of a container from its first to its last; of the whole page those around its core that lie in no container of their own.

    Lines before and behind the core that lie in containers of their own go where they are mostly links.
    """

    # the container, directly under ``place``, of each element; 0 if it is direct text of ``place``, -1 if it lies elsewhere
    within = [-1] * len(tree.kinds)
    within[place] = 0
    for e in range(1, len(within)):
        up = within[tree.parents[e]]
        if e != place and up >= 0:
            within[e] = up or (e if home[e] == e else 0)
    under = {i: within[tree.place[i]] for i in kept}
    own = [i for i in kept if under[i] >= 0]
    first, last = min((i for i in own if i in core), default=0), max((i for i in own if i in core), default=-1)
    free: dict[int, list[int]] = {}
    for i in own:
        size = free.setdefault(under[i], [0, 0])
        size[0] += tree.plain[i]
        size[1] += len(tree.text[i])
    whole = tree.kinds[place] in ("", "html", "body")
    article = tree.kinds[place] in ("article", "main")

    def joins(i: int) -> bool:
        if first <= i <= last or under[i] == 0 or article:
            return True
        plain, size = free[under[i]]
        return not whole and 2 * plain >= size

    return [i for i in own if joins(i)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        keep = [c for c in batch.schema.names if c not in ("html", "text", "n_chars")]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without text, give an empty text. Every row gives a row, repeated
    ones too; null ids and urls stay null; more columns are ignored. Pages of any length are read whole.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
