"""Operator 2: the main text of HTML pages, by minimum-cut labelling.

A page becomes a row of text blocks: runs of text between block-level tags, each with its open elements. A linear
classifier turns a block's evidence into log-odds of being content, between -10 and 6 but for hidden text: length,
punctuation, share of link text, and the strongest sign among its open elements (tags, roles, class and id words). They
become capacities to the two terminals. Blocks next to each other, and blocks that follow each other under one parent,
get smoothness edges that fall off with the steps between them in the tree, so that a weak block goes with those around
it: a heading or a linked line between paragraphs stays, a sentence among teasers goes. The minimum cut is the labelling
of least total cost: content is what stays with the source after max-flow.

An article element speaks for its longest block alone; its plain blocks that the classifier would refuse are undecided,
just under zero, and left to the cut. Edges don't cross an article's border. A class or id counts in full only if all
its parts are known (`related-posts`, not `related-work`), and not on html and body or around the page's largest article.

Null or empty html gives an empty text. Character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by two line feeds. Broken and cut-off markup is read as far as it goes; whole
pages are read however long. Rows of equal ids are read each for itself; a null id or url stays null; an empty table
gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: content that is no text of the page; up to their end tag nothing is markup
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math canvas audio video object select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: start tags that end an open element of the same group, and where the search for it stops
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

BOILERPLATE_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "button": 6.0, "menu": 5.0, "dialog": 6.0, "search": 6.0, "head": 20.0, "fieldset": 4.0, "label": 3.0, "header": 4.0}
#: tags that may stand around a whole page, and then say nothing
AROUND = frozenset("form header fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist cookie cookies copyright consent disclaimer "
    "disqus discussion follow footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription tagcloud tags toc toolbar "
    "topbar tracking widget widgets alert warning-bar feedback".split()
)
#: of these, what an article itself can be
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo promoted recommended related reply replies sponsor sponsored widget".split())
#: parts of a name that say nothing by themselves
NEUTRAL_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content div el elem element entry field first form global group heading inner item items "
    "last layout left link links list main module more nav outer page panel post posts primary right row secondary section site slot small thread title top unit ul wrap wrapper".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post prose story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9][a-z0-9_-]*")
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")

#: log-odds: any block, on a page of plain blocks more, a name all of known parts, a name with a known part, in a named content element
ANY, PLAIN_PAGE, NAMED, HALF_NAMED, IN_CONTENT = -1.2, 1.8, -5.0, -0.8, 1.0
#: an article's longest block, what each block of it adds to that, its plain blocks at least
SEED, SEED_EACH, UNDECIDED = 3.0, 0.01, -0.01
HIDDEN = -20.0
#: smoothness of blocks two steps apart (siblings), what is left of it a step further, steps that are looked at
NEAR, FALL, REACH = 2.0, 0.6, 8
NEXT_UNDER_PARENT, SAME_ARTICLE = 1.0, 0.3


def _named(value: str, words: frozenset) -> float:
    """What the strongest name in a class or id attribute says."""
    out = 0.0
    for name in _NAME.findall(value):
        parts = [x for x in _PART.findall(name) if len(x) > 1 or len(name) > 1]
        known = [x for x in parts if x in words]
        if name in words or known and all(x in words or x in NEUTRAL_WORDS for x in parts):
            return NAMED
        if known and parts[0] != "has":
            out = HALF_NAMED
    return out


class Node:
    __slots__ = ("tag", "parent", "depth", "own", "link", "article", "content", "around", "sign")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        # the outermost article that it is in
        self.article = parent.article if parent else None
        self.content = False
        self.around = False  # of the page's largest article
        self.sign: tuple[float, float] | None = None
        #: what it says by itself: by its tag, by its names, hidden or not
        self.own = (-BOILERPLATE_TAGS.get(tag, 0.0), 0.0, 0.0)
        if tag == "header" and self.article:
            self.own = (0.0, 0.0, 0.0)
        main = tag in ("article", "main")
        if attrs and not attrs.isspace():
            main = self._read(attrs, main)
        if main and self.own[1] > NAMED and self.article is None:
            self.article = self

    def _read(self, attrs: str, main: bool) -> bool:
        by_tag, by_name, hidden = self.own
        names = ""
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                names += " " + value
            elif name == "role":
                if value in BOILERPLATE_ROLES:
                    by_tag = min(by_tag, -6.0)
                elif value in ("main", "article"):
                    main = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                hidden = HIDDEN
        if names and self.tag not in ("html", "body"):
            by_name = _named(names, ARTICLE_WORDS if main else BOILERPLATE_WORDS)
            if main and by_name == HALF_NAMED:
                by_name = 0.0
            if not by_name:
                self.content = any(x in CONTENT_WORDS for x in _PART.findall(names))
        self.own = (by_tag, by_name, hidden)
        return main

    def signs(self) -> tuple[float, float]:
        """The strongest sign against content, and what speaks for it, among this node and what it is in."""
        chain, node = [], self
        while node is not None and node.sign is None:
            chain.append(node)
            node = node.parent
        against, speaks = node.sign if node is not None else (0.0, 0.0)
        for node in reversed(chain):
            by_tag, by_name, hidden = node.own
            if node.around:
                by_name = 0.0
                if node.tag in AROUND:
                    by_tag = 0.0
            own = min(by_tag, by_name)
            if node.article is not None and not node.around and own == HALF_NAMED:
                own = 0.0
            against = min(against, own, hidden)
            if node.content:
                speaks = IN_CONTENT
            if own < HALF_NAMED:
                speaks = 0.0
            node.sign = (against, speaks)
        return node.sign


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    root = Node("#root", "", None)
    node, out, run, linked, holder = root, [], [], 0, root
    at, n = 0, len(page)

    def flush():
        nonlocal run, linked
        if run:
            text = _SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
            if text:
                out.append(Block(text, holder, linked))
            run, linked = [], 0

    def block_parent(x: Node) -> Node:
        while x.tag in INLINE and x.parent:
            x = x.parent
        return x

    def add(text: str):
        nonlocal holder, linked
        if not run:
            if text.isspace():
                return
            holder = block_parent(node)
            if node is not holder and any(x < 0 for x in node.own):
                holder = node
        run.append(text)
        if node.link:
            linked += len(text.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if not m[4]:
            break  # a tag that the page's end cuts off
        if m[1]:
            if tag not in INLINE:
                flush()
            up = node
            while up.parent and up.tag != tag and not (up.tag in ("article", "table", "td", "body") and tag in INLINE):
                up = up.parent
            if up.parent and up.tag == tag:
                node = up.parent
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag not in INLINE:
                    flush()
                at = end.end() if end else n
            continue
        if tag == "br":
            if run:
                run.append("\n")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                up = node
                while up.parent and (up.tag in INLINE or up.tag == "p"):
                    if up.tag == "p":
                        node = up.parent
                        break
                    up = up.parent
            if tag in SIBLINGS:
                same, stop = SIBLINGS[tag]
                up, found = node, None
                while up.parent and up.tag not in stop:
                    if up.tag in same:
                        found = up
                    up = up.parent
                if found:
                    node = found.parent
        if tag in VOID:
            continue
        child = Node(tag, m[3], node)
        if not m[3].endswith("/") or tag in INLINE or tag in CLOSES_P:
            node = child
    flush()
    return out


def evidence(block: Block, any_block: float = ANY) -> float:
    """Log-odds that a block is content, by itself."""
    text, n = block.text, max(len(block.text), 1)
    against, speaks = block.node.signs()
    score = any_block + 1.2 * min(math.log1p(n / 40), 2.5) + speaks
    if text[-1] in ".!?…\"”»)":
        score += 0.6
    if block.node.tag in ("h1", "h2"):
        score += 0.5
    linked = min(block.linked / n, 1.0)
    if block.node.article is not None and not against:
        return max(score, UNDECIDED) - 0.3 * linked
    return score + against - 3.0 * linked


def scores(blocks: list[Block]) -> list[float]:
    """Log-odds of a page's blocks: around its largest article names don't count, an article speaks for its longest block."""
    size: dict[int, int] = {}
    largest, most = None, 0
    for b in blocks:
        if (a := b.node.article) is not None:
            size[id(a)] = size.get(id(a), 0) + len(b.text)
            if size[id(a)] > most:
                largest, most = a, size[id(a)]
    while largest is not None and (largest := largest.parent) is not None:
        largest.around = True
    plain = sum(2 * b.linked < len(b.text) and not b.node.signs()[0] for b in blocks)
    out = [evidence(b, ANY + PLAIN_PAGE * plain / len(blocks)) for b in blocks]
    seeds: dict[int, tuple[int, int, int]] = {}  # by article: length of its longest block, which one, blocks
    for k, b in enumerate(blocks):
        if b.node.article is not None and not b.node.signs()[0]:
            n, at, count = seeds.get(id(b.node.article), (0, k, 0))
            seeds[id(b.node.article)] = (len(b.text), k, count + 1) if len(b.text) > n else (n, at, count + 1)
    for _, k, count in seeds.values():
        out[k] += SEED + SEED_EACH * count
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut. A positive score is a capacity from the source, a negative one to the sink.

    Sources are emptied one by one along shortest paths. What an unemptied source reaches is closed: no flow can leave
    it any more, so it isn't looked at again. As paths end at the nearest sink, the time stays close to linear in rows of blocks.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    left, closed = list(scores), [False] * n
    for start in range(n):
        while left[start] > 1e-9 and not closed[start]:
            back, queue, end = {start: -1}, deque([start]), -1
            while queue and end < 0:
                x = queue.popleft()
                for y, c in near[x].items():
                    if c > 1e-9 and y not in back and not closed[y]:
                        back[y] = x
                        if left[y] < -1e-9:
                            end = y
                            break
                        queue.append(y)
            if end < 0:
                for x in back:
                    closed[x] = True
                break
            path = [end]
            while back[path[-1]] >= 0:
                path.append(back[path[-1]])
            flow = min(left[start], -left[end], *(near[b][a] for a, b in zip(path, path[1:])))
            left[start] -= flow
            left[end] += flow
            for a, b in zip(path, path[1:]):
                near[b][a] -= flow
                near[a][b] += flow
    return closed


def steps_apart(a: Node, b: Node) -> int:
    """Steps from a to b in the tree; REACH where there are more."""
    steps = 0
    while a is not b and steps < REACH:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours, and those that follow each other under one parent."""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k and blocks[k - 1].node.article is b.node.article:
            steps = steps_apart(blocks[k - 1].node, b.node)
            weight = NEAR * FALL ** max(steps - 2, 0) if steps < REACH else 0.0
            if b.node.article is not None:
                weight = max(weight, SAME_ARTICLE)
            if weight:
                edges.append((k - 1, k, weight))
        parent = b.node.parent or b.node
        before = last.get(id(parent))
        if before is not None and before < k - 1 and blocks[before].node.article is b.node.article:
            edges.append((before, k, NEXT_UNDER_PARENT))
        last[id(parent)] = k
    return edges


def label(blocks: list[Block]) -> list[bool]:
    """True for content blocks."""
    return min_cut(scores(blocks), smoothness(blocks)) if blocks else []


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks)) if keep)


def _extract(cols: dict, _state: dict) -> dict:
    text = [main_text(x) for x in cols["html"]]
    return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(x) for x in text]}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(slim, _extract, "page_id long, url string, text string, n_chars long")
