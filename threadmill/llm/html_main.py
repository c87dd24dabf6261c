"""Main text of web pages by minimum-cut labelling.

A page becomes its blocks in order. A linear classifier turns each block's tags, names, links and
words into two costs, which are the capacities to the terminals: being called boilerplate though it
is content, and the reverse. Names are such costs too, never a verdict. Only scripts, styles, forms
and what is hidden are no blocks at all. Neighbours in the page and near relatives in the DOM are
tied by smoothness edges. The minimum cut, found by maximum flow, parts content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_text, table

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>?""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)

_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup, or no text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: A start tag of the key closes an open element of the value's kinds, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body", "aside", "nav"}

#: Elements that are dropped with all that is in them.
DROPPED = {"form", "button", "select", "fieldset", "dialog"}
#: Elements that are hardly ever part of an article, and those that mark one.
OUTSIDE_TAGS = {"nav", "aside", "footer", "menu"}
INSIDE_TAGS = {"article", "main"}
#: Words in names of parts that are hardly ever part of an article, those that mark one, and words that say nothing.
OUTSIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer masthead topbar toolbar "
    "comment comments respond replies disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager tags copyright legal disclaimer contentinfo complementary dialog form".split()
)
INSIDE_NAMES = set("article content main post story entry body text prose".split())
FILLERS = set("site page global list lists box wrap wrapper container block area section bar button buttons link links item items inner outer left right top bottom primary secondary header posts bottom col row js id".split())
#: Names that only start like one of those.
OUTSIDE_STARTS = ("comment", "advert", "adsby", "sidebar", "cookie", "breadcrumb", "navbar", "navigation", "newsletter", "footer", "sponsor")
#: Smoothness: of blocks next to each other, of blocks with the same parent, of blocks with the same grandparent.
NEXT, SIBLINGS, COUSINS = 0.5, 1.0, 0.4


@dataclass
class Block:
    """A run of text between block tags and what is known of its place."""

    tag: str
    up: tuple[int, int]  # parent and grandparent of the element that holds it; -1 for none
    lean: float  # what tags and names around it say: below 0 they are no article's
    inside: bool
    header: bool
    has_article: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class _Open:
    """An open element; ``holder`` is the nearest one that is not inline, ``p`` the place of an open paragraph in reach."""

    __slots__ = ("tag", "serial", "by_tag", "by_name", "inside", "header", "link", "holder", "parent", "p")

    def __init__(self, tag: str, serial: int, by_tag: float, by_name: float, inside: bool, header: bool, link: bool, up: _Open | None, p: int):
        self.tag, self.serial, self.by_tag, self.by_name, self.inside, self.header, self.link, self.p = tag, serial, by_tag, by_name, inside, header, link, p
        self.holder = up.holder if tag in INLINE and up is not None else self
        self.parent = up.holder if up is not None else None


#: What names and tags weigh: a whole name or tag of an outside part, one word of a longer name, an inside part. Fixed values.
_OUTSIDE, _HINT, _INSIDE = -14.0, -1.5, 4.0


@lru_cache(maxsize=20_000)
def name_evidence(name: str) -> tuple[float, bool, bool]:
    """What one class, id or role says: weight, whether it marks an article, whether it marks a header.

    A name speaks for all of a part if its last word does and its other words say the same, nothing, or
    which article it belongs to. A word in a longer name of something else is a mere hint.
    """
    whole = "".join(_LETTERS.findall(name)).lower()
    words = [w.lower() for w in _PIECE.findall(name)]
    if whole in OUTSIDE_NAMES or whole.startswith(OUTSIDE_STARTS):
        return _OUTSIDE, False, False
    if whole == "header" or (words and words[-1] == "header" and all(w in FILLERS or w in INSIDE_NAMES for w in words)):
        return 0.0, any(w in INSIDE_NAMES for w in words), True
    said = [w for w in words if w not in FILLERS]
    bad = [w in OUTSIDE_NAMES or w.startswith(OUTSIDE_STARTS) for w in said]
    good = [w in INSIDE_NAMES for w in said]
    if not any(bad):
        return 0.0, any(good), False
    if bad[-1] and all(b or g for b, g in zip(bad, good)):
        return _OUTSIDE, False, False
    return _HINT * sum(bad) / len(said), any(good), False


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order. Time and memory are in proportion to the page, whatever its nesting."""
    root = _Open("html", 0, 0.0, 0.0, False, False, False, None, 0)
    stack, found, serial, at = [root], [], 0, 0
    open_ = Counter({"html": 1})  # how often each tag is open
    now: Block | None = None

    def text(piece: str) -> None:
        nonlocal now
        if not piece:
            return
        top = stack[-1]
        if now is None:
            if piece.isspace():
                return
            holder = top.holder
            parent = holder.parent
            grand = parent.parent if parent is not None else None
            now = Block(holder.tag, (parent.serial if parent is not None else -1, grand.serial if grand is not None else -1), top.by_tag + top.by_name, top.inside, top.header)
            found.append(now)
        piece = html.unescape(piece)
        now.pieces.append(piece)
        if top.link:
            now.linked += len(piece)

    def cut_to(k: int) -> None:
        for o in stack[k:]:
            open_[o.tag] -= 1
        del stack[k:]

    def close(tags: set[str], stop: set[str]) -> None:
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut_to(k)
                return
            if stack[k].tag in stop:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "wbr":
            if now is not None and tag == "br":
                now.pieces.append(" ")
            continue
        if tag not in INLINE:
            now = None
        if m[1]:
            if not open_[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag not in INLINE and stack[-1].p:
            cut_to(stack[-1].p)
        if tag in CLOSES:
            for _ in range(3):
                close(CLOSES[tag], CONTAINERS - {"div", "section"})
        attributes = m[3]
        if not attributes.rstrip().endswith("/"):
            hidden = bool(attributes) and tag not in INLINE and tag not in VOID and tag not in {"html", "body"} and _HIDDEN.search(attributes) is not None
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag in DROPPED or hidden:
                at = _end_of(page, tag, at)
                continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag in {"svg", "path"}:
            continue
        serial += 1
        up = stack[-1]
        names = [name_evidence(x) for n in _NAMES.findall(attributes) for x in n.strip("\"'").split()] if attributes.strip() else []
        marks = tag in INSIDE_TAGS
        by_tag, by_name, inside = up.by_tag, up.by_name, up.inside
        if marks:
            by_name = max(by_name, _HINT)  # an article of its own: names around it hardly count
            inside = True
        elif tag not in {"html", "body"}:
            said = sum(x[0] for x in names) if names else 0.0
            good = any(x[1] for x in names)
            by_name += max(said + (_INSIDE if good and said < 0 else 0.0), _OUTSIDE)
            inside = inside or (good and said > _OUTSIDE / 2)
        if tag in OUTSIDE_TAGS:
            by_tag += _OUTSIDE
        head = tag == "header" or (not marks and tag not in {"html", "body"} and not tag.startswith("h") and any(x[2] for x in names))
        # the header of an article may have its title; any other one is hardly ever part of it
        if head and not (up.inside and (tag == "header" or any(x[1] for x in names))):
            by_tag += _OUTSIDE
        place = len(stack) if tag == "p" else 0 if tag in CONTAINERS else up.p
        stack.append(_Open(tag, serial, by_tag, by_name, inside, up.header or head, up.link or tag == "a", up, place))
        open_[tag] += 1
    for b in found:
        b.text = " ".join("".join(b.pieces).split())
    found = [b for b in found if b.text]
    any_inside = any(b.inside and b.lean > _OUTSIDE / 2 for b in found)
    for b in found:
        b.has_article = any_inside
    return found


def _end_of(page: str, tag: str, at: int) -> int:
    """The place behind the end of an element that began before ``at``: its own end tag, or the page's end."""
    deep, comment = 1, re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE | re.DOTALL)
    if tag == "p":
        comment = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/)p(?=[\s/>])[^>]*>?|(?=<(?:p|div|ul|ol|table|section|article|aside|footer|nav|h[1-6]|form)\b)", re.IGNORECASE | re.DOTALL)
    elif tag in {"li", "option", "td", "th", "tr", "dt", "dd"}:
        comment = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/){re.escape(tag)}(?=[\s/>])[^>]*>?|(?=<(?:{re.escape(tag)}|/ul|/ol|/table|/dl|/select)(?=[\s/>]))", re.IGNORECASE | re.DOTALL)
    for m in comment.finditer(page, at):
        if m[0].startswith("<!--"):
            continue
        if not m[0] or tag in {"p", "li", "option", "td", "th", "tr", "dt", "dd"}:
            return m.end()
        deep += -1 if m[1] else 0 if m[0].rstrip(">").endswith("/") else 1
        if not deep:
            return m.end()
    return len(page)


#: Weights of the classifier. Fixed values.
_WEIGHTS = {"bias": -0.6, "inside": 4.0, "elsewhere": -3.0, "header": -6.0, "paragraph": 1.0, "heading": 0.4, "item": -0.2, "rights": -6.0, "words": 1.2, "links": -4.0, "sentence": 0.6}


#: More words say no more than this.
_MOST_BY_WORDS = 3.5


def content_score(b: Block) -> float:
    """Above 0: rather content. The cost of calling it boilerplate less that of calling it content."""
    w = _WEIGHTS
    heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
    score = w["bias"] + b.lean + min(w["words"] * math.log1p(b.text.count(" ") / 8), _MOST_BY_WORDS) + w["links"] * min(1.0, b.linked / max(1, len(b.text)))
    if b.inside:
        score += w["inside"]
    elif b.has_article:
        score += w["elsewhere"]
    if b.header and not (b.inside and heading):
        score += w["header"]
    if b.tag in ("p", "blockquote", "pre"):
        score += w["paragraph"]
    elif heading:
        score += w["heading"]
    elif b.tag in ("li", "td", "th", "dd", "dt"):
        score += w["item"]
    if _RIGHTS.match(b.text):
        score += w["rights"]
    if b.text[-1] in ".!?…:;\"'”":
        score += w["sentence"]
    return score


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks next to each other and between the last block of a parent or grandparent and the next."""
    edges: list[tuple[int, int, float]] = []
    last: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT))
        for level, weight in ((0, SIBLINGS), (1, COUSINS)):
            key = b.up[level]
            if key >= 0:
                if key in last[level]:
                    edges.append((last[level][key], i, weight))
                last[level][key] = i
    return edges


_TINY = 1e-9


def _settle(left: list[float], links: list[dict[int, float]]) -> list[bool | None]:
    """Decide the nodes whose own capacity outweighs all their edges; each changes its neighbours' capacities in turn.

    Such a node is on that side of every minimum cut. Its edges go: with the side known, an edge to it is
    a capacity of the node at its other end.
    """
    side: list[bool | None] = [None] * len(left)
    open_ = [sum(own.values()) for own in links]
    queue = deque(i for i in range(len(left)) if abs(left[i]) > open_[i] + _TINY)
    while queue:
        i = queue.popleft()
        if side[i] is not None:
            continue
        side[i] = left[i] > 0
        for j, capacity in links[i].items():
            if side[j] is None:
                del links[j][i]
                left[j] += capacity if side[i] else -capacity
                open_[j] -= capacity
                if abs(left[j]) > open_[j] + _TINY:
                    queue.append(j)
        links[i] = {}
    return side


def _blocking_flow(nodes: list[int], left: list[float], links: list[dict[int, float]]) -> set[int]:
    """Maximum flow within some nodes, by blocking flows along shortest paths; the nodes that the source still reaches."""
    while True:
        level = {i: 0 for i in nodes if left[i] > _TINY}
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            reached = reached or left[i] < -_TINY
            for j, capacity in links[i].items():
                if capacity > _TINY and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return set(level)
        untried = {i: iter(list(links[i])) for i in level}
        for source in [i for i in level if level[i] == 0]:
            path = [source]
            while path and left[source] > _TINY:
                i = path[-1]
                if left[i] < -_TINY:
                    flow = min(left[source], -left[i], *(links[a][b] for a, b in zip(path, path[1:])))
                    left[source] -= flow
                    left[i] += flow
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        links[a][b] -= flow
                        links[b][a] += flow
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if links[a][b] <= _TINY), len(path) - 1)
                    del path[full + 1 :]
                    continue
                j = next((j for j in untried[i] if links[i][j] > _TINY and level.get(j) == level[i] + 1), None)
                if j is None:
                    path.pop()
                else:
                    path.append(j)


def minimum_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source.

    ``excess`` is a node's capacity from the source less that to the sink. Most nodes are settled by
    their own capacity; what is left falls into small connected parts, each of which has a maximum flow
    of its own. Of several minimum cuts the one with the fewest nodes of the parts is taken.
    """
    n = len(excess)
    left = list(excess)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        if a != b and capacity > 0:
            links[a][b] = links[a].get(b, 0.0) + capacity
            links[b][a] = links[b].get(a, 0.0) + capacity
    side = _settle(left, links)
    for start in range(n):
        if side[start] is not None:
            continue
        part, seen = [start], {start}
        for i in part:
            for j in links[i]:
                if j not in seen:
                    seen.add(j)
                    part.append(j)
        if any(left[i] < -_TINY for i in part) and any(left[i] > _TINY for i in part):
            kept = _blocking_flow(part, left, links)
        else:
            kept = seen if any(left[i] > _TINY for i in part) else set()
        for i in part:
            side[i] = i in kept
    return [bool(x) for x in side]


def main_text(page: str | None) -> str:
    """Blocks labelled as content, joined by two line feeds; empty if there is none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = minimum_cut([content_score(b) for b in blocks], smoothness(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Per input row: the columns of ``keep``, text and n_chars (code points).

    A null or empty page, or one of boilerplate alone, has an empty text. Repeated rows are worked on
    one by one; no page is cut short: a very long or deeply nested one takes time and memory in
    proportion to its length. Broken markup is read as browsers do where that is simple: an element that
    is never closed ends with its container, or with the page. No shuffle.
    """
    keep = keep or ["page_id", "url"]
    read = pages.select(*keep, clean_text(F.col(html_col)).alias("_html"))
    schema = T.StructType([*(read.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py()) for x in part.column("_html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return read.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
