"""Column functions over strings, URLs, dates, arrays and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, in any case.
TRACKERS = ("utm_[a-z0-9_]+", "fbclid", "gclid", "dclid", "yclid", "igshid", "mc_cid", "mc_eid", "_ga", "spm", "rec")


def split_legacy_tags(tags: Column) -> Column:
    """'[a][b]' as an array of the tags of more than one byte."""
    return F.filter(F.split(F.replace(tags, F.lit("["), F.lit("")), "]"), lambda t: F.octet_length(t) > 1)


def join_legacy_tags(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def between(text: Column, start: str, end: str) -> Column:
    """The part after the first ``start`` up to the next ``end``; null if either is missing."""
    at = F.instr(text, start)
    rest = F.substring(text, at + len(start), F.length(text))
    to = F.instr(rest, end)
    return F.when((at > 0) & (to > 0), F.substring(rest, F.lit(1), to - 1))


def host(url: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(F.regexp_replace(url, "^[a-zA-Z]+://", ""), "/", 1), ":", 1))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_tracking(url: Column) -> Column:
    """The URL without fragment, tracking parameters and empty parts of the query."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    base = F.substring_index(bare, "?", 1)
    parts = F.split(F.substring(bare, F.length(base) + 2, F.length(bare)), "&")
    kept = F.filter(parts, lambda x: (x != "") & ~F.rlike(x, F.lit(f"(?i)^(?:{'|'.join(TRACKERS)})(?:=|$)")))
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_key(url: Column, article_id: str | None = None) -> Column:
    """What names an article: host, path without slashes at its end, and query, without scheme, default port, fragment and tracking; 512 characters at most.

    Where the pattern ``article_id`` finds an id in path and query, host and id do.
    """

    def key(less: Column) -> Column:
        place = F.regexp_extract(less, "^[^/?]*", 0)
        rest = F.substring(less, F.length(place) + 1, F.length(less))
        path = F.substring_index(rest, "?", 1)
        return F.concat(F.regexp_replace(F.lower(place), ":(?:80|443)$", ""), F.regexp_replace(path, "/+$", ""), F.substring(rest, F.length(path) + 1, F.length(rest)))

    scheme = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
    found = _with(F.regexp_replace(strip_tracking(url), scheme, ""), key)
    if article_id:
        whole = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), scheme, "")
        own = F.regexp_extract(F.regexp_replace(whole, "^[^/?]*", ""), article_id, 1)
        found = F.when(own != "", F.concat(F.regexp_extract(F.lower(whole), "^[^/?:]*", 0), F.lit("#"), own)).otherwise(found)
    return F.left(found, F.lit(512))


def absolute(href: Column, base: Column) -> Column:
    """The URL that a link names on the page ``base``: with its scheme, from the root, or beside the page; dots in the path are followed."""
    link = F.trim(href)
    bare = F.regexp_replace(base, "(?s)#.*$", "")
    origin = F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", 0)
    page = F.substring_index(bare, "?", 1)
    folder = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    joined = (
        F.when(F.rlike(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(link == "", bare)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^[^:]*:", 0), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when(F.startswith(link, F.lit("#")), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )
    dots = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)((?:/[^/?#]*)*/[.]{1,2}(?:/[^?#]*)?)(?![^?#])"

    def walked(url: Column) -> Column:
        path = F.regexp_extract(url, dots, 2)
        steps = F.split(F.regexp_replace(path, "(/[.]{1,2})$", "$1/"), "/")
        up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        kept = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.slice(steps, 1, 1), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
        return F.when(F.rlike(url, F.lit(dots)), F.concat(F.regexp_extract(url, dots, 1), F.array_join(kept, "/"), F.regexp_replace(url, dots, ""))).otherwise(url)

    return _with(joined, walked)


def strip_title_suffix(title: Column) -> Column:
    return F.regexp_replace(title, r"\s*[|–-]\s*[^|–-]{1,20}$", "")


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def shingles(text: Column, size: int = 5) -> Column:
    """The distinct runs of ``size`` characters, by one pass of a look-ahead pattern."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two sets."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def url_date(url: Column) -> Column:
    """A real date of the form /2024/01/31, /20240131 or -2024-01-31 in a URL."""
    got = [F.regexp_extract(url, p, 0) for p in (r"(?<!\d)20\d{2}/\d{2}/\d{2}(?!\d)", r"(?<!\d)20\d{6}(?!\d)", r"(?<!\d)20\d{2}-\d{2}-\d{2}(?!\d)")]
    digits = F.coalesce(*[F.when(g != "", F.regexp_replace(g, r"\D", "")) for g in got])
    return F.try_to_date(digits, "yyyyMMdd")


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def text_date(text: Column) -> Column:
    """A real date stated in text: 2024-01-31, 2024/1/31, 2024年1月31日 or Jan 31, 2024."""
    forms = ((r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)", "yyyy-MM-dd"), (r"(?<!\d)\d{4}/\d{1,2}/\d{1,2}(?!\d)", "yyyy/M/d"), (r"(?<!\d)\d{4}年\d{1,2}月\d{1,2}日", "yyyy年M月d日"), (r"\b[A-Z][a-z]{2} \d{1,2}, \d{4}(?!\d)", "MMM d, yyyy"))
    return F.coalesce(*[F.try_to_date(F.regexp_extract(text, p, 0), f) for p, f in forms])


def credit_kind(credit: Column) -> Column:
    """desk, organization, person or unknown."""
    return (
        F.when(credit == "", "unknown")
        .when(F.rlike(credit, F.lit("(?i)desk$")), "desk")
        .when(F.rlike(credit, F.lit("(?i)institute|supplier")), "organization")
        .when(F.rlike(credit, F.lit("^(By )?[A-Z][a-z]+ [A-Z]")), "person")
        .otherwise("unknown")
    )


#: What tells of a post on a platform, and who wrote it.
_POST = r"(?i)(?:posted|wrote|shared [a-z ]+) on (facebook|instagram|youtube)"
_POST_IN = r"(?i)in an? (threads|x) post"
_POSTER = r"(?:^|, )(Mayor|Singer|actor|Minister) ([A-Z][a-z]+)"


def social_post(text: Column) -> list[Column]:
    """social, platform, poster and role of a text; the last three null where it doesn't say."""
    some = lambda c: F.nullif(c, F.lit(""))
    platform = F.lower(F.concat(F.regexp_extract(text, _POST, 1), F.regexp_extract(text, _POST_IN, 1)))
    return [(platform != "").alias("social"), some(platform).alias("platform"), some(F.regexp_extract(text, _POSTER, 2)).alias("poster"), some(F.lower(F.regexp_extract(text, _POSTER, 1))).alias("role")]


def byline_names(credit: Column) -> Column:
    """The names of persons in a credit line, in order."""
    parts = F.transform(F.split(credit, " and |[/;,]"), lambda p: F.trim(F.regexp_replace(F.trim(p), "^(By|Reporter) ", "")))
    return F.filter(parts, lambda p: F.rlike(p, F.lit("^[A-Z][a-z]+ [A-Z][a-z]+$")) & ~F.rlike(p, F.lit("Desk$")))
