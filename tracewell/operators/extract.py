"""Pages to rows: every channel of a page as text items, in the order in which a source reader meets them.

A page is read into a tree first (implied head, body and end tags), then walked: elements of the body with their
attributes, comments, meta tags, the title, attributes of the head, noscript, template, SVG texts' attributes, JSON-LD,
CDATA. Scripts, styles, noscript and template give no element items. A text is kept as it was written; its key is the
form under which equal content meets. Null and empty html give no items.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.session import ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: start tags that end an open element of these tags, and the tags at which the search for one stops
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
SKIPPED = frozenset(("script", "style", "noscript", "template"))
CODE = frozenset(("pre", "code", "blockquote", "kbd", "samp"))
# Attributes that hold sentences; the last four count from three characters on.
SENTENCE_ATTRIBUTES = (
    "alt", "title", "aria-label", "aria-description", "aria-placeholder", "placeholder", "aria-roledescription", "aria-valuetext", "longdesc",
    "summary", "abbr", "label", "download",
)
SHORT_ATTRIBUTES = ("summary", "abbr", "label", "download")
# Hints that markup hides an element's text.
HINTS = ("hidden attribute", "inline display:none", "inline visibility:hidden", "sr-only class", "aria-hidden")
_PROSE = re.compile(r"[A-Za-z\u4e00-\u9fff]")
_SPACE = re.compile("[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_ZERO_WIDTH = re.compile("[\u200b-\u200d\ufeff\u2060]")
_OFF_SCREEN = re.compile(r"(^|\s)(sr-only|visually-hidden|screen-reader-only)(\s|$)")
ITEMS = "page_id long, ord int, kind string, path string, text string, tag string, in_code boolean, hints array<string>"
ANCHORS = "page_id long, ord int, href string, text string, path string, in_code boolean"


def plain(x: str) -> str:
    return _SPACE.sub(" ", _ZERO_WIDTH.sub("", x)).strip()


def looks_like_prose(x: str) -> bool:
    """Three characters or more with a blank inside and a letter."""
    x = x.strip()
    return len(x) >= 3 and bool(_SPACE.search(x)) and bool(_PROSE.search(x))


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "tags", "nth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []  # elements, texts, and comments as 1-tuples
        self.tags: dict[str, int] = {}  # children by tag
        self.nth = 1
        if parent is not None:
            parent.children.append(self)
            self.nth = parent.tags[tag] = parent.tags.get(tag, 0) + 1

    def up(self):
        node = self
        while node is not None:
            yield node
            node = node.parent

    def inside(self, tags) -> bool:
        return any(x.tag in tags for x in self.up())

    def walk(self):
        """Everything below in page order: elements, texts, comments."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                yield x
                if isinstance(x, Element):
                    stack.append(iter(x.children))
                    break
            else:
                stack.pop()

    def own_text(self) -> str:
        return "".join(x for x in self.children if isinstance(x, str))

    def all_text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def step(self) -> str:
        return f"{self.tag}:nth-of-type({self.nth})" if self.parent and self.parent.tags[self.tag] > 1 else self.tag

    def path(self, upto: str = "body") -> str:
        steps = []
        for x in self.up():
            if x.tag == upto:
                break
            steps.append(x.step())
        return " > ".join(([upto] if upto == "body" else []) + steps[::-1])


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html = Element("html", {}, None)
        self.head, self.body = (Element(t, {}, self.html) for t in ("head", "body"))
        self.at = self.head

    def _enter_body(self):
        if self.at is self.head:
            self.at = self.body

    def handle_starttag(self, tag, attrs):
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            for k, v in found.items():
                getattr(self, tag).attrs.setdefault(k, v)
            if tag != "html" and self.at is self.head:
                self.at = getattr(self, tag)
            return
        if tag not in HEAD:
            self._enter_body()
        if tag in CLOSES_P:
            self._end(("p",), ("td", "th", "button", "body", "head"))
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Element(tag, found, self.at)
        if tag not in VOID:
            self.at = node

    def _end(self, tags, stop):
        last = None
        for x in self.at.up():
            if x.tag in stop or x is self.body or x is self.head:
                break
            if x.tag in tags:
                last = x
        if last is not None:
            self.at = last.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.inside(("svg", "math")):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag == "head":
            self.at = self.body if self.at.inside(("head",)) else self.at
            return
        if tag in ("html", "body"):
            return
        for x in self.at.up():
            if x is self.body or x is self.head:
                return
            if x.tag == tag:
                self.at = x.parent
                return

    def handle_data(self, data):
        if self.at is self.head and data.strip():
            self._enter_body()
        if self.at is not self.head:
            self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append((data,))


def read_page(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def _hints(a: dict[str, str]) -> list[str]:
    style = re.sub(r"\s+", "", a.get("style", "")).lower()
    on = ("hidden" in a, "display:none" in style, "visibility:hidden" in style, bool(_OFF_SCREEN.search(a.get("class", "").lower())), a.get("aria-hidden") == "true")
    return [h for h, x in zip(HINTS, on) if x]


def _attributes(el: Element, path: str, out: list) -> None:
    a = el.attrs
    for k in SENTENCE_ATTRIBUTES:
        if v := a.get(k):
            if len(v.strip()) >= 3 if k in SHORT_ATTRIBUTES else looks_like_prose(v) or len(v.strip()) >= 12:
                out.append(("attribute", f"{path}@{k}", v, None, False, []))
    if el.tag == "input" and a.get("type", "").lower() == "hidden" and a.get("value", "").strip():
        out.append(("hidden-input-value", f"{path}@value", a["value"], None, False, []))
    for k, v in a.items():
        if k.startswith("data-") and v.strip() and (looks_like_prose(v) or len(v.strip()) >= 8):
            out.append(("data-attribute", f"{path}@{k}", v, None, False, []))


def _json_strings(raw: str, label: str) -> list:
    """Strings of eight characters or more with their paths; malformed data as a whole."""
    try:
        stack = [("", json.loads(raw))]
    except (ValueError, RecursionError):
        return [("jsonld-malformed", label, raw, None, False, [])]
    out = []
    while stack:
        at, x = stack.pop()
        if isinstance(x, str):
            if len(x.strip()) >= 8:
                out.append(("jsonld", at, x, None, False, []))
        elif isinstance(x, list):
            stack += [(f"{at}[{k}]", y) for k, y in enumerate(x)][::-1]
        elif isinstance(x, dict):
            stack += [(f"{at}.{k}" if at else k, y) for k, y in x.items()][::-1]
    return out


def page_items(html: str) -> list[tuple]:
    """(kind, path, text, tag, in_code, hints) of a page's items."""
    tree = read_page(html)
    elements = [x for x in tree.html.walk() if isinstance(x, Element)]
    in_body = [x for x in tree.body.walk() if isinstance(x, Element)]
    out: list[tuple] = []
    for el in in_body:
        if el.inside(SKIPPED):
            continue
        path, own = el.path(), el.own_text()
        if plain(own):
            out.append(("element", path, own, el.tag, el.inside(CODE), _hints(el.attrs)))
        _attributes(el, path, out)
    inert = lambda node: any(x.tag == "template" for x in node.up())
    for node in [tree.html, *elements]:
        if not inert(node):
            out += [("comment", "(HTML comment)", x[0], "#comment", False, ["HTML comment"]) for x in node.children if isinstance(x, tuple) and plain(x[0]) and not x[0].startswith("[CDATA[")]
    live = [x for x in elements if not (x.parent and inert(x.parent))]
    for el in live:
        if el.tag == "meta" and plain(el.attrs.get("content", "")):
            out.append(("meta", f'meta[name="{el.attrs.get("name") or el.attrs.get("property") or ""}"]', el.attrs["content"], "meta", False, ["meta tag"]))
    title = next((x for x in live if x.tag == "title" and not x.inside(("svg",))), None)
    if title and plain(title.all_text()):
        out.append(("title", "head > title", plain(title.all_text()), "title", False, ["document title"]))
    for el in tree.head.walk():
        if isinstance(el, Element) and not (el.parent and inert(el.parent)):
            _attributes(el, el.path("#document"), out)
    for el in live:
        if el.tag == "noscript" and plain(text := el.all_text()):
            inner = read_page(text).body.all_text()
            out.append(("noscript", el.path("#document") + " (parsed content)", inner, "noscript", False, ["noscript"]) if plain(inner) else ("noscript", el.path("#document"), text, "noscript", False, ["noscript"]))
    for el in live:
        if el.tag == "template" and plain(text := el.all_text()):
            out.append(("template", el.path("#document") + " (inert content)", text, "template", False, ["template (not rendered)"]))
    for el in live:
        if el.tag in ("title", "desc", "text") and el.inside(("svg",)):
            _attributes(el, el.path("#document"), out)
    data = [x for x in live if x.tag == "script" and x.attrs.get("type") == "application/ld+json"]
    for k, el in enumerate(data):
        if (raw := el.all_text()).strip():
            out += _json_strings(raw, 'script[type="application/ld+json"]' + (f":nth-of-type({k + 1})" if len(data) > 1 else ""))
    for k, m in enumerate(re.finditer(r"<!\[CDATA\[([\s\S]*?)\]\]>", html)):
        if plain(m[1]):
            out.append(("cdata", f"CDATA section #{k + 1}", m[1], None, False, ["CDATA section"]))
    return out


def page_anchors(html: str) -> list[tuple]:
    """(href, text, path, in_code) of a page's links."""
    tree = read_page(html)
    links = [x for x in tree.html.walk() if isinstance(x, Element) and x.tag == "a" and x.attrs.get("href", "").strip() and not x.inside(("template",))]
    return [(x.attrs["href"].strip(), plain(x.all_text()), x.path() + "@href", x.inside(CODE)) for x in links]


# Elements of an article that are segments of its own.
SEGMENTS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote td figcaption".split())


def article_segments(html: str) -> list[tuple]:
    """(path, text, in_code) of the segments of an article that a reader view has cut out: an element's own text, else all of it."""
    out = []
    for el in read_page(html).body.walk():
        if isinstance(el, Element) and el.tag in SEGMENTS:
            raw = el.own_text() or el.all_text()
            if plain(raw):
                out.append((f"reader > {el.tag}", raw, el.inside(("pre", "code", "blockquote"))))
    return out


ROWS_AT_ONCE = 2000


def _mapped(pages: DataFrame, name: str, ddl: str) -> DataFrame:
    ship_package(pages.sparkSession)
    columns = [c.split(" ")[0] for c in ddl.split(", ")]

    def run(batches):
        from tracewell.operators import extract

        fn, rows = getattr(extract, name), []
        for batch in batches:
            for page, html in zip(batch.column(0), batch.column(1)):  # one page at a time, however long
                if html.is_valid:
                    rows += [(page.as_py(), k, *x) for k, x in enumerate(fn(html.as_py()))]
                if len(rows) >= ROWS_AT_ONCE:
                    yield _batch(rows, columns)
                    rows = []
        if rows:
            yield _batch(rows, columns)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, ddl)


_TYPES = {"page_id": pa.int64(), "ord": pa.int32(), "in_code": pa.bool_(), "hints": pa.list_(pa.string())}


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES.get(c, pa.string())) for c, x in zip(columns, zip(*rows))], names=columns)


def items(pages: DataFrame) -> DataFrame:
    """All text items of pages (page_id, html) with the key under which equal content meets."""
    out = _mapped(pages, "page_items", ITEMS)
    return out.withColumns({"key": T.norm_key(F.col("text")), "invisible": T.invisible_classes(F.col("text")), "decoded": T.decode_tags(F.col("text"))})


def reader_segments(articles: DataFrame) -> DataFrame:
    """Segments of articles (page_id, html): page_id, ord, path, text, in_code."""
    return _mapped(articles, "article_segments", "page_id long, ord int, path string, text string, in_code boolean")


def links(pages: DataFrame) -> DataFrame:
    """All links of pages (page_id, html): page_id, ord, href, text, path, in_code."""
    return _mapped(pages, "page_anchors", ANCHORS)


def _scan(pages: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(group))).alias("ord", "text"))


def comments(pages: DataFrame) -> DataFrame:
    """HTML comments without a parser."""
    return _scan(pages, r"<!--([\s\S]*?)-->").withColumn("text", F.trim("text")).filter("text != ''")


def metas(pages: DataFrame) -> DataFrame:
    """Meta tags without a parser: their attributes and content."""
    found = _scan(pages, r"<meta\s([^>]*)>").withColumnRenamed("text", "attributes")
    quoted = F.coalesce(*[F.nullif(F.regexp_extract("attributes", rf"(?i)(?:^|\s)content\s*=\s*{p}", 1), F.lit("")) for p in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")])
    return found.withColumn("content", quoted)


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.norm_key(F.regexp_extract("html", r"<title[^>]*>([\s\S]*?)</title>", 1)).alias("title"))


def anchors(pages: DataFrame) -> DataFrame:
    found = _scan(pages, r"(<a\s[^>]*>[^<]*</a>)")
    return found.select("page_id", "ord", F.regexp_extract("text", r'href="([^"]*)"', 1).alias("href"), T.norm_key(F.regexp_extract("text", r">([^<]*)</a>", 1)).alias("text"))


