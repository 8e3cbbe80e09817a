"""Main text of web pages by tree scoring.

The page is parsed into a tree by a small tolerant parser (void elements, implied ends of p, li and table parts, raw
script and style). Paragraph-like blocks pass points for their length and commas to their ancestors, the nearer the
more; a container's points are discounted by the share of its text that is in links. The best container and those of
its siblings that score well enough or read like prose are kept, and their blocks are given in page order.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are dropped before scoring,
by element, by role, or by name: a class or id says so with its first or last word ("sidebar-left", "post-comments"),
not with one in between ("story-related-stats"), and not where it only tells what the page has ("no-sidebar",
"has-sidebar"). A name whose other words belong to page furniture as well ("related-posts") decides alone; one with
words of its own ("related-work", "social-security") only together with the text: it drops what is mostly links or too
short for prose, and leaves what reads like prose to the scores. An element with such a name that holds the page's main
heading or <main> and most of its text is a layout container and stays. Text of math, buttons and embedded objects
outside of forms and menus is part of its sentence. A header is dropped wherever it stands, an article's own with its
title included.

Defined cases: null, empty or text-free html gives an empty text; plain text without markup is one block; unclosed
elements end with their parent or the page; end tags without an element are skipped, at no cost that grows with the
page; quotes open a value only after '=', others are ordinary characters of the tag; a cut-off tag at the end is
dropped; equal scores go to the earlier container; repeated rows give equal rows; a very long page is one row's work; an
empty table gives no rows; extra columns are ignored, whatever their names. Nothing is cut by length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|=)*)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=>/\"']+|[\"'])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*|))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
DROPPED = frozenset("head nav header footer aside form dialog menu".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption div section".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert skip".split()
)
FURNITURE = BAD_WORDS | frozenset(
    "area articles back bar block body bottom box btn button buttons center col column component container content count feed form global group "
    "head header icon icons inline inner item items js left legal link links list load main media message mobile module msg news outer "
    "overlay page panel placeholder policy post posts primary prompt rail reader right row secondary section sticky site slot stories story "
    "text thread tile title top unit user view wrap wrapper".split()
)
GOOD_WORDS = frozenset("article body content entry main post story text hentry blog column".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
TELLING = frozenset("no not has have with without is hide hides show shows toggle wp".split())
SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def words_of(name: str) -> list[str]:
    """The words of one class or id."""
    return [w.lower() for w in SPLIT_WORDS.split(name) if w]


def says_bad(words: list[str]) -> bool:
    """Whether a class or id names something besides the article."""
    return bool(words) and words[0] not in TELLING and (words[0] in BAD_WORDS or words[-1] in BAD_WORDS)


def furniture(words: list[str]) -> bool:
    """Whether nothing in a class or id stands for content of its own."""
    return all(w in FURNITURE or len(w) == 1 for w in words)


class Node:
    __slots__ = ("tag", "parent", "children", "names", "dropped", "named", "sure", "score", "order")

    def __init__(self, tag: str, parent: Node | None, attributes: str, order: int):
        self.tag, self.parent, self.children, self.score, self.order = tag, parent, [], 0.0, order
        self.names: frozenset[str] = frozenset()
        self.dropped, self.named, self.sure = tag in DROPPED, False, False
        if attributes and not self.dropped:
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    self.dropped = True
                elif name == "style":
                    self.dropped |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif name == "role":
                    self.dropped |= value.lower() in BAD_ROLES
                elif name in ("class", "id"):
                    found = [words_of(x) for x in html.unescape(value).split()]
                    self.names |= frozenset(w for x in found for w in x)
                    if tag not in ("html", "body", "article", "main"):
                        bad = [w for w in found if says_bad(w)]
                        self.named |= bool(bad)
                        self.sure |= any(map(furniture, bad))


#: Characters from which text reads like prose, and the share of it in links up to which it does.
LEAST_PROSE, MOST_LINKED = 80, 0.3


def drop_named(root: Node) -> None:
    """Drops the elements that their names tell apart, but for layout containers."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if isinstance(c, Node) and not c.dropped)
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    heads: dict[int, bool] = {}
    for x in reversed(order):
        inner = [c for c in x.children if isinstance(c, Node) and not c.dropped]
        size[id(x)] = sum(len(c.strip()) for c in x.children if isinstance(c, str)) + sum(size[id(c)] for c in inner)
        linked[id(x)] = size[id(x)] if x.tag == "a" else sum(linked[id(c)] for c in inner)
        heads[id(x)] = x.tag in ("h1", "main") or any(heads[id(c)] for c in inner)
    for x in order:
        if x.named and not (heads[id(x)] and 2 * size[id(x)] > size[id(root)]):
            prose = size[id(x)] >= LEAST_PROSE and linked[id(x)] < MOST_LINKED * size[id(x)]
            x.dropped |= x.sure or not prose


def parse(page: str) -> Node:
    """Tree of a page; children are nodes and strings in page order."""
    root = node = Node("#root", None, "", 0)
    at, end, order = 0, len(page), 0
    open_: Counter[str] = Counter()  # open elements by name: what is not open need not be looked for

    def leave(last: Node) -> Node:
        """Closes everything up to a node; the node around it."""
        x = node
        while True:
            open_[x.tag] -= 1
            if x is last:
                return last.parent or root
            x = x.parent

    while at < end:
        m = TOKEN.match(page, at)
        if m is None:  # a '<' that opens nothing that can be read
            node.children.append(page[at])
            at += 1
            continue
        start, at = at, m.end()
        slash, tag, attributes, text = m.groups()
        if tag is not None and not m.group(0).endswith(">"):  # the end of the page, or a quote that closes too far on
            at = page.find(">", start) + 1
            if not at:
                break  # a tag that never ends
            attributes = page[m.end(2) : at - 1]
        if text is not None:
            node.children.append(html.unescape(text))
        elif tag is None:
            continue
        elif slash:
            tag = tag.lower()
            up: Node | None = node if open_[tag] > 0 else None
            while up is not None and up.tag != tag:
                up = None if tag == "p" and up.tag in BLOCKS or up.tag in ("td", "th") and tag not in BLOCKS else up.parent
            if up is not None and up.parent is not None:
                node = leave(up)
            elif tag == "br":
                node.children.append("\n")
        else:
            tag = tag.lower()
            order += 1
            if tag in CLOSES_P and open_["p"] > 0:
                up = node
                while up is not None and up.tag != "p" and up.tag not in BLOCKS:
                    up = up.parent
                if up is not None and up.tag == "p":
                    node = leave(up)
            if tag in SAME and any(open_[t] > 0 for t in SAME[tag]):
                up, stop = node, BARRIER.get(tag, set())
                while up is not None and up.tag not in SAME[tag] and up.tag not in stop:
                    up = up.parent
                if up is not None and up.tag in SAME[tag]:
                    node = leave(up)
            child = Node(tag, node, attributes, order)
            node.children.append(child)
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else (end if tag in ("script", "style") else at)
                continue
            open_[tag] += 1
            node = child
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space as one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.dropped and x is not node:
            if x.tag in BLOCKS:
                flush()
        elif x.tag == "br":
            line.append("\n")
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def _measure(root: Node) -> list[tuple[Node, int, int, int]]:
    """Nodes in page order with length of text, of linked text, and own text outside inner blocks."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not c.dropped)
    size: dict[int, list[int]] = {}
    for x in reversed(order):
        total = linked = own = commas = 0
        for c in x.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                total, own, commas = total + n, own + n, commas + c.count(",") + c.count("，") + c.count("、")
            elif not c.dropped:
                t, k, o, m = size[id(c)]
                total, linked = total + t, linked + k
                if c.tag not in BLOCKS:
                    own, commas = own + o, commas + m
        if x.tag == "a":
            linked = total
        size[id(x)] = [total, linked, own, commas]
    return [(x, *size[id(x)]) for x in order]


def main_text(page: str | None) -> str:
    """Text of the best container and its kept siblings."""
    if not page:
        return ""
    root = parse(page)
    drop_named(root)
    measured = _measure(root)
    facts = {id(x): (total, linked) for x, total, linked, _, _ in measured}
    scored: dict[int, Node] = {}
    for x, _, _, own, commas in measured:
        if x.tag not in PARAGRAPHS or own < 25:
            continue
        points, share, up = 1.0 + commas + min(own / 100.0, 3.0), 1.0, x.parent
        for level in range(4):
            if up is None or up.tag == "#root" and x.parent is not root:
                break
            if id(up) not in scored:
                scored[id(up)] = up
                up.score = (5.0 if up.tag in ("article", "main") else 0.0) + (5.0 if up.names & GOOD_WORDS else 0.0)
            share = (1.0, 0.5, 0.25, 0.15)[level]
            up.score += points * share
            up = up.parent
    if not scored:
        return " ".join(blocks(root))
    worth = {k: x.score * (1 - facts[k][1] / max(1, facts[k][0])) for k, x in scored.items()}
    best = max(scored.values(), key=lambda x: (worth[id(x)], -x.order))
    # An article or main element around the best container holds the whole piece.
    up = best
    while up is not None and up.tag not in ("article", "main", "body", "#root"):
        up = up.parent
    if up is not None and up.tag in ("article", "main"):
        best = up
    kept = [best]
    if best.parent is not None:
        floor = max(10.0, 0.2 * worth.get(id(best), 0.0))
        kept = []
        for c in best.parent.children:
            if c is best:
                kept.append(c)
            elif isinstance(c, Node) and not c.dropped and id(c) in facts:
                total, linked = facts[id(c)]
                density = linked / max(1, total)
                bonus = 0.2 * best.score if c.names and c.names == best.names else 0.0
                prose = c.tag == "p" and (total > 80 and density < 0.25 or 0 < total <= 80 and not linked)
                twin = c.tag == best.tag and c.tag in ("article", "section") and total > 80 and density < 0.25
                if worth.get(id(c), 0.0) + bonus >= floor or prose or twin or c.tag in ("h1", "h2") and total and best.tag not in ("article", "main"):
                    kept.append(c)
    return " ".join(t for x in kept for t in blocks(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    chosen = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
