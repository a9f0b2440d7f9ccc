"""Main text of web pages by line-block distribution.

Markup goes first: every block element makes a line, and an element that is no part of
an article by its tag, role or name (menu, form, advert, comments ...) makes only empty
lines. Text lengths, without those of links, are summed over sliding windows of lines. A
sum over the threshold after a lower one is a surge; the sum falling to nothing, a
dive. The lines from surge to dive are the text; where they lie in an ``article`` or
``main`` element, so are its other lines, as an advert in the middle parts one article
into two peaks. Elsewhere so are all lines of the block element that holds a peak's
longest line, whatever their length, and an article too short for a surge stays beside
them. A page without a surge keeps its largest peak, in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, texts_of

WINDOW = 3
THRESHOLD = 86

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
DROPPED = {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "template", "svg",
    "canvas", "object", "audio", "video", "map", "datalist", "fieldset",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "input", "picture", "source", "link", "meta", "param", "track", "area", "base", "embed",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies",
    "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "form",
    "pagination", "pager", "widget", "toolbar", "hidden", "alert",
}
# A name that begins so says what a container has or lacks; the header of a post holds its title.
ABOUT = {"has", "with", "without", "no", "non", "not", "overflow"}
POSTS = {"post", "entry", "article", "story", "content"}
# Parts of a text; what holds them is further out.
PARTS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "hgroup", "address",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "details", "summary",
}
CONTENT = {"html", "body", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def _names_boilerplate(value: str) -> bool:
    for token in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(token)]
        if parts and parts[0] not in ABOUT and not (len(parts) == 2 and parts[0] in POSTS and parts[1] == "header") and not NAMES.isdisjoint(parts):
            return True
    return False


def _is_boilerplate(tag: str, attributes: str, names: bool) -> bool:
    if tag in CONTENT:
        return False
    if tag in DROPPED:
        return True
    if not attributes or attributes.isspace():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if names and name in ("class", "id") and _names_boilerplate(value):
            return True
        if name == "hidden" or (name == "role" and value.lower() in ROLES) or (name == "style" and _HIDDEN.search(value)):
            return True
    return False


Line = tuple[str, int, int, list[int]]


def lines(html: str) -> list[Line]:
    """Text, length without links, number of the article element (0: none) and lines (first, end) of the block element
    around it, of every line; dropped parts are empty lines.

    A page of which names leave nothing is read without regard to them.
    """
    out = _lines(html, True)
    return out if any(x[0] for x in out) else _lines(html, False)


def _lines(html: str, names: bool) -> list[Line]:
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    whole = [0, 0, 1]
    opened: list[tuple[str, bool, int, list[int]]] = []  # tag, dropped, article; first line, end, whether it has block elements
    dropped = article = articles = 0

    def around(before_child: bool) -> list[int]:
        if not opened:
            return whole
        tag, _, _, span = opened[-1]
        if tag in CONTENT or (tag not in PARTS and (before_child or span[2])):
            return span
        # a block with text alone is a paragraph, whatever its tag
        return next((x[3] for x in reversed(opened[:-1]) if x[0] not in PARTS), whole)

    def flush(before_child: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, max(0, len(text) - linked), article, around(before_child)))
        parts.clear()
        linked = 0

    def close(until: int) -> None:
        nonlocal dropped, article
        while len(opened) > until:
            _, was_dropped, before, span = opened.pop()
            span[1] = len(out)
            article = before
            if was_dropped:
                dropped -= 1
                if not dropped:
                    out.extend([("", 0, article, whole)] * WINDOW)

    at, size, last_quote = 0, len(html), html.rfind('"')
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            mark = size
        if mark > at and not dropped:
            text = unescape(html[at:mark])
            parts.append(text)
            linked += len(text) if in_link else 0
        if mark == size:
            break
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        closing = html.startswith("</", mark)
        name = _TAG.match(html, mark + 1 + closing)
        if not name:
            if html[mark + 1 : mark + 2] in ("!", "?", "/"):
                end = html.find(">", mark)
                at = size if end < 0 else end + 1
            else:  # a lone "<" is text
                if not dropped:
                    parts.append("<")
                at = mark + 1
            continue
        end = html.find(">", name.end())
        while 0 <= end < last_quote and html.count('"', name.end(), end) % 2:  # inside a quoted value
            end = html.find(">", html.find('"', end))
        end = size if end < 0 else end
        tag, attributes = name[0].lower(), html[name.end() : end]
        at = end + 1
        if closing:
            if tag not in INLINE and not dropped:
                flush()
            if tag == "a":
                in_link = 0
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] == tag:
                    close(i)
                    break
                if opened[i][0] in CONTENT and tag not in CONTENT and not opened[i][1]:
                    break
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else size
            if tag not in INLINE and not dropped:
                flush()
            continue
        if tag in CONTENT and dropped:  # an article ends what was left open before it
            first = next(i for i, x in enumerate(opened) if x[1])
            if opened[first][0] not in ("head", "form", "template", "dialog") or tag == "body":
                close(first)
        heading = tag in HEADINGS and article and dropped == 1 and opened and opened[-1][0] == "header"
        if heading:  # the title of an article may stand in its own header
            close(len(opened) - 1)
        if not dropped and tag not in INLINE:
            flush(tag not in VOID)
        if tag == "a":
            in_link = 1
        if tag in VOID or attributes.endswith("/"):
            continue
        drop = _is_boilerplate(tag, attributes, names)
        if tag in INLINE and not drop:
            continue
        if tag == "p" and opened and opened[-1][0] == "p":
            close(len(opened) - 1)
        if drop and not dropped:
            flush()
            out.extend([("", 0, article, whole)] * WINDOW)
        if opened and tag not in INLINE:
            opened[-1][3][2] = 1
        opened.append((tag, drop, article, [len(out), 0, 0]))
        dropped += drop
        if tag in ("article", "main") and not dropped:
            articles += not article
            article = article or articles
    if not dropped:
        flush()
    for span in (whole, *(x[3] for x in opened)):
        span[1] = len(out)
    return out


def main_lines(found: list[Line], window: int = WINDOW, threshold: int = THRESHOLD) -> list[str]:
    """The lines between surge and dive points, and those of the elements that hold them."""
    sums = [sum(x[1] for x in found[i : i + window]) for i in range(len(found))]
    peaks: list[tuple[int, int, int]] = []  # first line, end, largest sum
    i = 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        peaks.append((i, end, max(sums[i:end])))
        i = end
    if not peaks:
        return []
    chosen = [x for x in peaks if x[2] > threshold] or [max(peaks, key=lambda x: x[2])]
    inside = {found[k][2] for a, b, _ in chosen for k in range(a, b) if found[k][0]} - {0}
    keep = set()
    for a, b, _ in chosen:
        keep.update(range(a, min(b + window - 1, len(found))))
        keep.update(range(*found[max(range(a, min(b + window - 1, len(found))), key=lambda k: found[k][1])][3][:2]))
    if inside:
        keep = {k for k, x in enumerate(found) if x[2] in inside}
    else:
        keep.update(k for k, x in enumerate(found) if x[2])
    return [x[0] for k, x in enumerate(found) if k in keep and x[0]]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of every row.

    Null, empty and textless pages have an empty text. Blocks are joined by a line
    break; white space inside them is one space. Repeated rows give repeated rows.
    """
    rows = texts_of(pages, id_col, html_col, F.col(url_col).alias("_url"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_url"))
            for first, last, texts in chunks(batch):
                out = pa.array(["\n".join(main_lines(lines(t))) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), urls.slice(first, last - first), out], ["_id", "_url", "text"])

    url_kind = rows.schema["_url"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, _url {url_kind}, text string")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
