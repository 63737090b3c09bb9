"""Main text of web pages by minimum-cut labelling of blocks.

A page becomes blocks of text between block-level tags, in the tree of their
elements. A classifier's log-odds of being content are a block's terminal
capacity. Most of it is learned from the text alone (length, marks, links,
heading): a logistic regression fitted on a bounded sample of pages of the very
corpus, whose labels are the elements that say what they hold (article and main
against nav, footer, aside and the like), around a fixed prior. Two features
have fixed weights, as those labels can't teach them: which of these elements
the block is in, and whether an element around it is named as an advert, a
reader's comment, a cookie notice and so on. A name counts only if all its parts
do ('share-buttons', not 'share-price').

Smoothness edges join what lies together: neighbouring blocks, the more the
nearer they are in the tree, and blocks of one parent. Edges and terminals are
of one size, so a short line within an article is kept by its neighbours though
its text alone reads like boilerplate. The minimum cut between the terminals,
found by max-flow, labels each block.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Sequence
from html import unescape
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
#: A value without quotes runs to white space or the tag's end.
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]+)))?""")
#: Elements whose contents are no text of the page.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "textarea", "select", "option", "button", "svg", "iframe", "object", "canvas", "audio", "video"}
#: Of these, those whose contents are not markup.
RAW = {"script", "style", "title", "textarea", "iframe"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "output", "img", "input", "picture", "source", "track", "map", "area", "nobr", "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "semantics"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag ends these open ones.
CLOSES_P = {"p", "div", "article", "section", "aside", "nav", "header", "footer", "main", "form", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "fieldset", "hr", "address", "details", "menu"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "nav", "aside", "div", "body"}

CONTENT_TAGS = {"article", "main"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "toolbar"}
#: Parts of class and id names: readers' comments, what else is no article, and words that may stand beside these.
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
BOILERPLATE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "login", "toolbar", "pagination", "pager", "paywall"}
BESIDE_NAMES = {"area", "banner", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "global", "header", "holder", "icons", "inner", "items", "label", "left", "link", "links", "list", "main", "media", "message", "notice", "notices", "outer", "page", "panel", "popular", "posts", "primary", "right", "row", "section", "site", "slot", "stories", "thread", "toggle", "top", "unit", "widget", "widgets", "wrap", "wrapper"}
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Pages and blocks a page that the classifier learns from at most, and blocks of either label that it needs.
SAMPLE_PAGES, SAMPLE_BLOCKS, LEAST_BLOCKS = 1000, 64, 30
#: Capacities, in hundredths of log-odds: of the text at most; of being in content elements, in boilerplate ones, and outside
#: the content elements of a page that has some; of a name; of neighbours in the tree and of siblings further off.
MOST_TEXT, IN_CONTENT, IN_BOILERPLATE, OUTSIDE, NAMED, NEIGHBOUR, SIBLING = 190, 150, -300, -200, -400, 100, 20
#: What the classifier is before it has seen a page, and how firmly (rows that each weight counts for).
PRIOR = np.array([-1.0, 0.6, 0.6, -4.0, 0.6])
PRIOR_ROWS = 8.0


def name_kind(names: str) -> str | None:
    """'comment' or 'boilerplate' if one of the class or id names says so with all its parts, else None."""
    kind = None
    for name in names.split():
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if parts <= COMMENT_NAMES | BOILERPLATE_NAMES | BESIDE_NAMES:
            if parts & COMMENT_NAMES:
                return "comment"
            if parts & BOILERPLATE_NAMES:
                kind = "boilerplate"
    return kind


class Element:
    """An open element. ``kind`` says what the nearest clear element at or around it holds: content, boilerplate or None.

    What a boilerplate element or a reader's comment holds stays so for articles
    inside it; other names end at the next article.
    """

    __slots__ = ("tag", "parent", "depth", "kind", "named")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        named = name_kind(f"{found.get('class', '')} {found.get('id', '')}") if tag not in ("html", "body") else None
        role = found.get("role", "").lower()
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 1
        self.kind, self.named = (parent.kind, parent.named) if parent else (None, None)
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
        if self.kind is not False:
            if tag in BOILERPLATE_TAGS or hidden or role in ROLES or (tag == "header" and self.kind is None):
                self.kind = False
            elif tag in CONTENT_TAGS or role in ("main", "article"):
                self.kind = True
                if self.named == "boilerplate":
                    self.named = None
        if self.named != "comment":
            self.named = named or self.named


class Block:
    """A text, the innermost element around it and how many of its characters are in links."""

    __slots__ = ("text", "element", "link_chars")

    def __init__(self, text: str, element: Element | None, link_chars: int):
        self.text, self.element, self.link_chars = text, element, link_chars


class Stack:
    """The open elements; finding the innermost of some tags takes no walk through the others."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> Element | None:
        return self.open[-1] if self.open else None

    def push(self, tag: str, attributes: str) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(Element(tag, attributes, self.top()))

    def innermost(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()


def blocks(html: str | None) -> list[Block]:
    """Non-empty text blocks in page order; white space is single, references are decoded."""
    html, out = html or "", []
    stack = Stack()
    parts: list[tuple[str, bool]] = []
    links, at, skip = 0, 0, []

    def flush() -> None:
        text = " ".join(unescape("".join(t for t, _ in parts)).split())
        if text:
            inner = sum(len(" ".join(unescape(t).split())) for t, link in parts if link)
            out.append(Block(text, stack.top(), inner))
        parts.clear()

    while at < len(html):
        m = MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and not skip:
            parts.append((text, links > 0))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if skip:
            if closing and tag in skip:
                while skip and skip.pop() != tag:
                    pass
            elif not closing and tag in SKIPPED and tag not in RAW and not m[3].rstrip().endswith("/"):
                skip.append(tag)
            elif not closing and tag == "body" and "head" in skip:
                skip.clear()
            if skip or (closing and tag in SKIPPED):
                continue
        if tag in SKIPPED:
            if closing:
                continue
            if tag in ("noscript", "template", "head", "button", "select") or tag not in INLINE:
                parts.append((" ", False))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif not m[3].rstrip().endswith("/"):
                skip.append(tag)
            continue
        if tag == "br":
            parts.append(("\n", False))
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        links = 0
        if closing:
            place = stack.innermost({tag})
            if place >= 0:
                stack.close_from(place)
            continue
        if tag in CLOSES_P and stack.open and stack.open[-1].tag == "p":
            stack.close_from(len(stack.open) - 1)
        if tag in ENDS:
            place = stack.innermost(ENDS[tag])
            if place > stack.innermost(SCOPES - ENDS[tag]):
                stack.close_from(place)
        stack.push(tag, m[3] or "")
    flush()
    return out


HEADING = re.compile(r"h[1-6]")


def features(block: Block) -> list[float]:
    """What the classifier reads: the block's own text and tag, nothing around it."""
    text, tag = block.text, block.element.tag if block.element else ""
    return [1.0, math.log10(len(text)), float(text[-1] in ".!?…\"'”)"), min(1.0, block.link_chars / len(text)), float(HEADING.fullmatch(tag) is not None)]


def fit_classifier(rows: Sequence[tuple[Sequence[float], bool]], steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression around ``PRIOR``, by Newton's method; the prior itself for too few rows."""
    labels = Counter(bool(y) for _, y in rows)
    if min(labels[True], labels[False]) < LEAST_BLOCKS:
        return PRIOR
    x, y = np.array([r for r, _ in rows]), np.array([float(v) for _, v in rows])
    # Both labels weigh alike, so that pages of many small links don't turn everything into boilerplate.
    share = np.where(y > 0, len(y) / (2 * labels[True]), len(y) / (2 * labels[False]))
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - PRIOR_ROWS * (w - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return np.round(w, 6)


def clear_blocks(html: str | None) -> list[tuple[list[float], bool]]:
    """Features and label of the blocks under a clear element, spread evenly over the page if they are many."""
    clear = [b for b in blocks(html) if b.element and b.element.kind is not None and not b.element.named]
    step = max(1, -(-len(clear) // SAMPLE_BLOCKS))
    return [(features(b), b.element.kind) for b in clear[::step]]


def block_costs(found: Sequence[Block], weights: np.ndarray) -> list[int]:
    """The classifier's log-odds of content of each block, in hundredths: the text's within its limit, then the two fixed features."""
    any_content = any(b.element and b.element.kind for b in found)
    out = []
    for b in found:
        kind, named = (b.element.kind, b.element.named) if b.element else (None, None)
        text = int(max(-MOST_TEXT, min(MOST_TEXT, round(100 * float(np.dot(features(b), weights))))))
        place = (OUTSIDE if any_content else 0) if kind is None else IN_CONTENT if kind else IN_BOILERPLATE
        out.append(text + place + (NAMED if named else 0))
    return out


def minimum_cut(odds: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut; blocking flows over shortest paths.

    odds: positive ones are capacities from the source, negative ones to the sink.
    edges: (node, node, capacity both ways).
    """
    n = len(odds)
    source, sink = n, n + 1
    to, room, of = [], [], [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: int, back: int) -> None:
        of[a].append(len(to))
        to.append(b)
        room.append(forth)
        of[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            add(source, i, x, 0)
        elif x < 0:
            add(i, sink, -x, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for e in of[u]:
                if room[e] > 0 and to[e] not in level:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if sink not in level:
            return [i in level for i in range(n)]
        ahead, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while ahead[u] < len(of[u]):
                e = of[u][ahead[u]]
                if room[e] > 0 and level.get(to[e]) == level[u] + 1:
                    break
                ahead[u] += 1
            if ahead[u] < len(of[u]):
                path.append(of[u][ahead[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                ahead[u] += 1
            else:
                break


def _distance(a: Element | None, b: Element | None) -> int:
    """Steps from one element to the other in the tree."""
    steps = 0
    while a is not b:
        if (a.depth if a else 0) >= (b.depth if b else 0):
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(found: Sequence[Block]) -> list[tuple[int, int, int]]:
    """Edges of neighbours, whole for siblings and less with each further step in the tree, and of each block with the last one of its parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            further = max(0, _distance(found[i - 1].element, b.element) - 2)
            edges.append((i - 1, i, round(NEIGHBOUR / (1 + 3 * further))))
        parent = id(b.element.parent) if b.element else 0
        if last.get(parent, i - 1) < i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def label_blocks(odds: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """Labels of a minimum cut.

    A node whose terminal outweighs all its edges is cut the same way whatever
    the rest does, so flow is only sought among the others.
    """
    around = [0] * len(odds)
    for a, b, c in edges:
        around[a] += c
        around[b] += c
    fixed = [abs(o) > s for o, s in zip(odds, around)]
    label = [o > 0 for o in odds]
    free = [i for i, f in enumerate(fixed) if not f]
    place = {i: k for k, i in enumerate(free)}
    rest, inner = [odds[i] for i in free], []
    for a, b, c in edges:
        if not fixed[a] and not fixed[b]:
            inner.append((place[a], place[b], c))
        elif not fixed[a]:
            rest[place[a]] += c if label[b] else -c
        elif not fixed[b]:
            rest[place[b]] += c if label[a] else -c
    for i, side in zip(free, minimum_cut(rest, inner)):
        label[i] = side
    return label


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    found = blocks(html)
    return " ".join(b.text for b, keep in zip(found, label_blocks(block_costs(found, weights), smoothness(found))) if keep)


def cut_flips(html: str | None, weights: np.ndarray = PRIOR) -> tuple[int, int]:
    """Blocks of a page, and those that the edges turn: the cut labels them against their own terminal."""
    found = blocks(html)
    costs = block_costs(found, weights)
    return len(found), sum((c > 0) != x for c, x in zip(costs, label_blocks(costs, smoothness(found))))


def learn_weights(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """The classifier of a corpus: at most ``sample_pages`` pages by hash, ``SAMPLE_BLOCKS`` rows of six numbers each."""

    @pandas_udf("array<struct<x:array<double>,y:boolean>>")
    def rows(html: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in clear_blocks(h)] for h in html])

    keyed = pages.filter(F.col(html_col).isNotNull()).select(F.col(html_col).alias("h"), F.xxhash64(html_col).alias("k"))
    # Equal pages count once; only hashes are sorted, and one of them comes to the driver.
    last = keyed.select("k").distinct().orderBy("k").limit(sample_pages).agg(F.max("k")).first()[0]
    got = keyed.filter(F.col("k") <= F.lit(last).cast("long")).select("k", rows("h").alias("r")).dropDuplicates(["k"]).collect()
    return fit_classifier([(list(x.x), x.y) for row in sorted(got, key=lambda r: r.k) for x in row.r])


def main_text_column(html: Any, weights: np.ndarray = PRIOR):
    @pandas_udf(T.StringType())
    def extracted(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, weights) for h in html], dtype=object)

    return extracted(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages, and pages of boilerplate alone, have an empty text.
    Broken markup is read as far as it goes. Repeated rows come back each. An
    empty table gives no rows. Without ``weights`` the classifier is learned
    from a sample of ``pages``.
    """
    weights = learn_weights(pages, html_col) if weights is None else weights
    text = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text_column(F.col(html_col), weights).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
