"""Main text of HTML pages by minimum-cut labelling.

A page is read once into blocks of text, each with its place in the element tree. A linear classifier
gives every block evidence for content or for boilerplate, from its text and from its containers; these
become the capacities of the edges to the two terminals. Smoothness edges join blocks that follow one
another and blocks under one parent, and are stronger the closer the two are in the tree; a step into or
out of a container that is boilerplate by its nature has almost none. The maximum flow from source to sink
then separates the blocks whose residual graph the source still reaches (content) from the rest, which is
the labelling of least total cost: a block that looks like neither, or a little like the other kind, goes
with its neighbours. The content blocks, joined by line feeds, are the text.

``extract`` fits the weights of the text by logistic regression on blocks that pages label themselves: those
in ``article`` or ``main`` without a hint of boilerplate are content, those in ``nav``, ``footer``, ``form``
and the like are not. The sample is SAMPLE_PAGES distinct pages of at most SAMPLE_BYTES, by the order of a
hash; it moves the weights from TEXT_WEIGHTS as FIT_BLOCKS blocks would, so a sample without labels leaves
them. Containers count by fixed weights, of which a class name on a paragraph, or one that may as well be
the subject (``legal``, ``related``), is a weak one that text and neighbours can outvote.

Character references are decoded, white space inside a block becomes one space, blocks that are empty
are left out; nothing is capped. Broken markup is read leniently: unclosed paragraphs, list items and
cells end where a browser ends them, and an unfinished tag or reference at the end of the page is text
only if it cannot be a tag.

Defined cases: null and empty pages give an empty text of 0 characters; a page whose blocks are all
boilerplate too; repeated rows get equal results; an empty table gives an empty result; extra columns
are kept by ``extract`` and never read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import bounded_batches

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names by how they are read.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"head", "template", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "br", "img", "input", "wbr", "embed", "area", "param", "source", "track", "link", "meta", "base",
    # Embedded content: its formulas, labels and fallback texts belong to the block around.
    "audio", "canvas", "map", "object", "video",
    "math", "annotation", "annotation-xml", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics",
    "svg", "circle", "clippath", "defs", "desc", "ellipse", "foreignobject", "g", "image", "line", "lineargradient", "marker", "mask", "path", "pattern", "polygon", "polyline", "radialgradient", "rect", "stop", "symbol", "text", "textpath", "tspan", "use",
}
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "aside", "nav", "header", "footer", "form", "div", "body", "html"}
# Containers by their nature, and words of class names, ids and roles.
BOILERPLATE_TAGS = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "fieldset"}
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "recommended", "recommendations", "comment", "comments", "disqus", "replies", "respond",
    "widget", "toolbar", "pagination", "pager", "copyright", "complementary", "contentinfo", "dialog", "paywall", "teaser", "teasers", "trending", "popular", "skip",
}
DOUBTFUL_WORDS = {"legal", "disclaimer", "related", "search", "form", "discussion", "reader", "reply", "more"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "td", "th", "caption", "address"}
LAYOUT_WORDS = {"has", "with", "no", "without", "layout", "open", "closed"}
CONTENT_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

RIGHTS = re.compile(r"\xa9|\(c\)\s*\d{4}|\bcopyright\b|\ball rights reserved\b", re.I)

# Weights of the classifier; positive is evidence for content. Of the text, before fitting, and its limit:
TEXT_FEATURES = ("one", "words", "links", "sentence", "heading", "rights", "short", "digits", "item")
TEXT_WEIGHTS = (-1.0, 1.0, -4.0, 1.2, 1.0, -3.0, -0.5, -1.0, -0.3)
MOST_WORDS, FEW_WORDS, TEXT_LIMIT = 40, 4, 2.5
# Of the containers:
IN_CONTENT, OUTSIDE_CONTENT, NAMED_CONTENT = 2.0, -3.0, 1.0
IN_BOILERPLATE, DOUBTFUL, IN_HEADER, HIDDEN = -8.0, -1.5, -5.0, -12.0
# Smoothness: blocks under one parent, elsewhere, and across the border of a boilerplate container.
SAME_PARENT, NEAR, ACROSS = 2.0, 0.4, 0.02
#: The sample of pages to fit on, and the number of blocks that it counts as against the fixed weights.
SAMPLE_PAGES, SAMPLE_BYTES, FIT_BLOCKS = 200, 65_536, 200


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    depth: int
    parent: Element | None
    content: bool = False
    boilerplate: int = 0  # number of the outermost boilerplate container, 0 for none
    header: bool = False
    named: bool = False
    hidden: bool = False
    heading: bool = False
    dropped: bool = False
    doubtful: bool = False
    item: bool = False


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    links: int
    score: float = 0.0


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)
    has_content: bool = False


def _open(tag: str, attributes: str, number: int, parent: Element | None) -> Element:
    e = Element(tag, number, parent.depth + 1 if parent else 0, parent)
    if parent:
        e.content, e.boilerplate, e.header, e.named, e.hidden, e.heading, e.dropped = parent.content, parent.boilerplate, parent.header, parent.named, parent.hidden, parent.heading, parent.dropped
        e.doubtful, e.item = parent.doubtful, parent.item
    words: set[str] = set()
    role = ""
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words.update(w.lower() for w in NAME_PART.findall(value))
                role = value.lower() if name == "role" else role
            elif name == "style":
                e.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden" or value.lower() == "true":
                e.hidden = True
    if tag in CONTENT_TAGS or role in ("main", "article"):
        e.content = True
    elif words & CONTENT_WORDS and tag != "body":
        e.named = True
    # A name like has-sidebar or comments-open tells of the layout around, not of the element.
    if tag not in ("html", "body") and not words & LAYOUT_WORDS:
        named = bool(words & BOILERPLATE_WORDS)
        if named and tag not in TEXT_TAGS and tag not in INLINE:
            e.boilerplate = e.boilerplate or number
        elif named or words & DOUBTFUL_WORDS:
            e.doubtful = True
    if tag in BOILERPLATE_TAGS:
        e.boilerplate = e.boilerplate or number
    e.item |= tag in ("li", "dt", "dd", "td", "th")
    if tag == "header" or "header" in words and tag not in HEADINGS:
        e.header = True
    if tag in HEADINGS:
        e.heading = True
    if tag in DROPPED:
        e.dropped = True
    return e


def read_page(source: str) -> Page:
    """Blocks of text with the elements that hold them, in page order."""
    page = Page()
    root = _open("html", "", 1, None)
    stack, number = [root], 1
    held: Counter[str] = Counter()  # open elements by name
    pieces: list[str] = []
    links = linked = 0  # depth of open links, characters of link text in the block so far
    at = 0

    def close_block():
        nonlocal linked
        if pieces:
            joined = " ".join(html.unescape("".join(pieces)).split())
            if joined:
                owner = stack[-1]
                while owner.tag in INLINE and owner.parent:
                    owner = owner.parent
                page.blocks.append(Block(joined, owner, linked))
            pieces.clear()
        linked = 0

    def pop_to(k: int):
        nonlocal links
        for e in stack[k:]:
            held[e.tag] -= 1
            links -= e.tag == "a"
        del stack[k:]

    def text(chunk: str):
        nonlocal linked
        if chunk and not stack[-1].dropped:
            pieces.append(chunk)
            if links > 0:
                linked += len(chunk)

    search = TAG.search
    while m := search(source, at):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "br":
                text(" ")
                continue
            if tag not in INLINE:
                close_block()
            for k in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in INLINE:
            if tag == "br" or tag == "img":
                text(" ")
        else:
            close_block()
            while stack[-1].tag in INLINE and len(stack) > 1:  # a block ends unclosed inline elements
                pop_to(len(stack) - 1)
            if stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            ended = ENDED_BY.get(tag)
            if ended:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        pop_to(k)
                    elif stack[k].tag in SCOPES:
                        break
        if tag in VOID or m[3].endswith("/"):
            continue
        number += 1
        stack.append(_open(tag, m[3], number, stack[-1]))
        held[tag] += 1
        page.has_content |= stack[-1].content
        links += tag == "a"
    if at < len(source):
        text(source[at:])
    close_block()
    return page


def text_features(b: Block) -> tuple[float, ...]:
    """The values of TEXT_FEATURES."""
    n_words = b.text.count(" ") + 1
    digits = sum(map(b.text.count, "0123456789")) if n_words <= MOST_WORDS else 0
    return (
        1.0,
        min(n_words, MOST_WORDS) / 10,
        min(1.0, b.links / len(b.text)),
        float(b.text[-1] in ".!?:…。\"'”»"),
        float(b.element.heading),
        float(n_words <= MOST_WORDS and RIGHTS.search(b.text) is not None),
        float(n_words <= FEW_WORDS),
        digits / len(b.text),
        float(b.element.item),
    )


def _masthead(e: Element) -> bool:
    """In a header, and not the title of the content."""
    return e.header and not (e.heading and e.content)


def score_blocks(page: Page, weights: tuple[float, ...] = TEXT_WEIGHTS) -> None:
    for b in page.blocks:
        e = b.element
        s = sum(w * x for w, x in zip(weights, text_features(b), strict=True))
        s = max(-TEXT_LIMIT, min(TEXT_LIMIT, s))
        if page.has_content:
            s += IN_CONTENT if e.content else OUTSIDE_CONTENT
        s += NAMED_CONTENT * e.named + HIDDEN * e.hidden
        if e.boilerplate:
            s += IN_BOILERPLATE
        elif e.doubtful:
            s += DOUBTFUL
        if _masthead(e):
            s += IN_HEADER
        b.score = s


def self_labelled(page: Page) -> tuple[list[tuple[float, ...]], list[float]]:
    """Text features and labels of the blocks whose containers say what they are."""
    rows, labels = [], []
    for b in page.blocks if page.has_content else ():
        e = b.element
        sure = e.content and not (e.boilerplate or e.doubtful or e.header or e.hidden)
        if sure or e.boilerplate and not e.hidden:
            rows.append(text_features(b))
            labels.append(float(sure))
    return rows, labels


def fit_weights(sources: list[str]) -> tuple[float, ...]:
    """Weights of the text features: a logistic regression that both kinds of blocks share evenly, drawn to TEXT_WEIGHTS."""
    rows, labels = [], []
    for source in sources:
        own, y = self_labelled(read_page(source))
        rows += own
        labels += y
    y = np.array(labels)
    if not 0 < y.sum() < len(y):
        return TEXT_WEIGHTS
    x, w, start = np.array(rows), np.array(TEXT_WEIGHTS), np.array(TEXT_WEIGHTS)
    share = FIT_BLOCKS / 2 * np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum()))
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + (w - start)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between a block and the last one under its parent."""
    edges, last = [], {}

    def weight(a: Element, b: Element) -> float:
        if a.boilerplate != b.boilerplate or a.content != b.content or _masthead(a) != _masthead(b):
            return ACROSS
        up_a, up_b = a.parent, b.parent
        if a is b or up_a is up_b:
            return SAME_PARENT
        return NEAR / (1 + abs(a.depth - b.depth))

    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, weight(blocks[i - 1].element, b.element)))
        key = b.element.parent.number if b.element.parent else 0
        if last.get(key, i - 1) < i - 1:
            edges.append((last[key], i, weight(blocks[last[key]].element, b.element)))
        last[key] = i
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: -score for a block whose label contradicts its sign, the weight for each edge cut.

    Maximum flow by shortest augmenting paths in phases. The two terminal edges of a block are netted,
    so a positive score is what the source still offers to it and a negative one what it can pass to
    the sink. A block is content if the source reaches it when no flow can be added, or if it is
    neutral and no boilerplate holds it.
    """
    n = len(scores)
    offer, drain = [max(0.0, s) for s in scores], [max(0.0, -s) for s in scores]
    if not any(drain) or not any(offer):
        return [s > 0 for s in scores]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    tiny = 1e-9
    while True:
        level, queue, reached = [-1] * n, deque(i for i in range(n) if offer[i] > tiny), False
        for i in queue:
            level[i] = 0
        while queue:
            i = queue.popleft()
            reached |= drain[i] > tiny
            for e in near[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        following = [0] * n
        for source in range(n):
            while level[source] == 0 and offer[source] > tiny:
                path, i = [], source
                while drain[i] <= tiny:
                    while following[i] < len(near[i]):
                        e = near[i][following[i]]
                        if room[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        following[i] += 1
                    else:
                        if not path:
                            break
                        level[i] = -1  # a dead end of this phase
                        i = to[path.pop() ^ 1]
                        following[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if drain[i] <= tiny:
                    break
                flow = min([offer[source], drain[i], *(room[e] for e in path)])
                offer[source] -= flow
                drain[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def labelled_blocks(source: str, weights: tuple[float, ...] = TEXT_WEIGHTS) -> tuple[list[Block], list[bool]]:
    """The blocks of a page and which of them the cut leaves on the side of content."""
    page = read_page(source)
    score_blocks(page, weights)
    return page.blocks, min_cut([b.score for b in page.blocks], smoothness(page.blocks))


def main_text(source: str | None, weights: tuple[float, ...] = TEXT_WEIGHTS) -> str:
    """The main text of a page."""
    if not source:
        return ""
    return "\n".join(b.text for b, keep in zip(*labelled_blocks(source, weights), strict=True) if keep)


def training_sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """SAMPLE_PAGES distinct pages of at most SAMPLE_BYTES, by the order of a hash."""
    rows = pages.select(F.col(html_col).alias("html")).where((F.octet_length("html") > 0) & (F.octet_length("html") <= SAMPLE_BYTES)).withColumn("h", F.xxhash64("html"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    # A hash below the cut keeps about twice the sample, or everything.
    near = rows.where((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) <= min(1.0, (2.0 * SAMPLE_PAGES + 100) / max(1, n)))
    return [r.html for r in near.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(SAMPLE_PAGES).collect()]


def extract(pages: DataFrame, out_col: str = "text", html_col: str = "html") -> DataFrame:
    """``pages`` with a column that holds each page's main text."""
    bounded_batches(pages.sparkSession)
    weights = fit_weights(training_sample(pages, html_col))

    @F.pandas_udf("string")
    def texts(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: main_text(s if isinstance(s, str) else None, weights))

    return pages.withColumn(out_col, texts(F.col(html_col)))
