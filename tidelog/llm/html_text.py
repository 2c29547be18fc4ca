"""Main text of web pages by composite text density.

A page becomes a tree of its elements, without those that hold no article text by their
tag (scripts, styles, menus, forms, asides, page headers and footers, ...) or by a word
of their class, id or role (adverts, notices, sidebars, comments, ...). Every node has
C characters of text, T elements, LC characters within links and LT links below it; its
composite density is C/T times the logarithm of (C*T)/(LC*LT) to a base that grows with
the share of linked text in the node and in the page. A node's density sum adds the
densities of its children (text of its own counts as a child). The body's node with the
largest sum sets the threshold: the least density on the path from body to it. From
body down, every node at or above the threshold whose siblings' best sum it holds gives
the subtree of the largest sum below it; all blocks of those subtrees are the text. A
subtree within an article element stands for the whole article. Around the subtree of
the largest sum, the nearest ancestor that holds other text than links is kept, too (or
the main element, where that is further out): headlines, intros, loose text; its blocks
of links are not.

Blocks end at block elements; character references are decoded, white space within a
block is one space, blocks are joined by a newline in page order.

Defined results: null or empty html, and pages without article text, give an empty
string; unclosed and stray tags are taken as browsers do in the cases that matter here
(p and li close implicitly, the end of the page closes all); rows are independent of
one another; a page is read whole, whatever its length. Media and frames without an end
tag are empty; scripts, styles and text fields without one take the rest of the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: What these hold is no article; without an end tag they are empty.
SKIPPED = frozenset("noscript template iframe svg object canvas audio video".split())
#: Blocks of running text: within an article only a word that is a whole class speaks against them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption td th em strong span b i".split())
APART = frozenset("head nav aside form button select option fieldset dialog menu footer".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header address details summary center hgroup search".split())
HEADLINE = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of these closes an open p; these close an open element of their own kind.
CLOSES_P = BLOCK - frozenset("html body tr td th thead tbody tfoot caption figcaption summary dt dd li".split()) | frozenset({"hr", "nav", "aside", "form", "fieldset", "footer", "menu", "dialog"})
OWN_KIND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words of class, id and role that mark what is no article.
BOILER = re.compile(r"(?:^|[\s_\d-])(?:ads?|adverts?|advert(?:isement|ising)?|adslot|adbox|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|comments?|commentlist|respond|replies|disqus|discussion|reactions|side-?bar|widgets?|related|recommend(?:ed|ations)?|share|sharing|social|nav(?:igation|bar)?|menus?|breadcrumbs?|crumbs|pagination|pager|toolbar|masthead|site-?header|page-?header|topbar|footer|site-?footer|page-?footer|bottombar|copyright|skip|search(?:box|form)?|announcements?|dialog|complementary|contentinfo)(?:$|[\s_\d-])", re.I)
HEADER = re.compile(r"(?:^|\s)(?:header|top|head)(?:$|\s)", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: These are the article whatever their class says.
NEVER_BOILER = frozenset({"html", "body", "article", "main"})

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "links", "density", "sum", "apart")

    def __init__(self, tag: str, parent: Node | None, apart: bool):
        self.tag, self.parent, self.apart = tag, parent, apart
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0


def _is_boiler(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in APART or tag == "header" and not inside_article:
        return True
    if not attrs or tag in NEVER_BOILER:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true":
            return True
        if value and inside_article and tag in PROSE:
            if any(BOILER.fullmatch(word) for word in value.split()):
                return True
        elif value and (BOILER.search(_HUMP.sub("-", value)) or not inside_article and HEADER.search(value)):
            return True
    return False


def parse(html: str) -> Node:
    """The page's tree: body (or the page) without raw elements' text."""
    root = Node("html", None, False)
    at, pos, articles = root, 0, 0
    n = len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        if m is None:
            at.items.append(html[pos:])
            break
        if m.start() > pos:
            at.items.append(html[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                at.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                while at is not node:
                    articles -= at.tag in ("article", "main")
                    at = at.parent
                articles -= at.tag in ("article", "main")
                at = at.parent
            continue
        if tag in RAW or tag in SKIPPED:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else n if tag in RAW else pos
            continue
        if tag in ("html", "body") and at.tag in ("html", "body", "head"):
            while at.tag == "head" and at.parent is not None:
                at = at.parent
            if tag == "html":
                continue
        if tag in VOID:
            at.items.append("\n" if tag in ("br", "hr") else " ")
            if tag == "hr":
                at.items.append(Node("hr", at, False))
            continue
        if tag in CLOSES_P or tag in OWN_KIND:
            stop = OWN_KIND.get(tag, frozenset())
            node = at
            while node is not None and node.tag not in stop and node.tag not in NEVER_BOILER and node.tag not in ("div", "section", "td", "th", "blockquote", "table"):
                if tag in OWN_KIND and (node.tag == tag or {tag, node.tag} <= {"dt", "dd"} or {tag, node.tag} <= {"td", "th"}) or tag in CLOSES_P and node.tag == "p":
                    while at is not node:
                        at = at.parent
                    at = at.parent
                    break
                node = node.parent
        node = Node(tag, at, at.apart or _is_boiler(tag, attrs, articles > 0))
        at.items.append(node)
        at = node  # a slash at the end closes nothing
        articles += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.apart:
            continue
        order.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    for node in reversed(order):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        kids = [x for x in node.items if isinstance(x, Node) and not x.apart]
        node.chars = own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.links = sum(k.links + (k.tag == "a") for k in kids)
    page = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = _density(node.chars, node.tags, node.link_chars, node.links, page)
        kids = [x for x in node.items if isinstance(x, Node) and not x.apart]
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        node.sum = sum(k.density for k in kids) + (_density(own, 0, 0, 0, page) if own else 0.0)
    return order


def _density(c: int, t: int, lc: int, lt: int, page: float) -> float:
    """Composite text density; counts of 0 elements or links stand as 1."""
    if not c:
        return 0.0
    t, lt, some = max(1, t), max(1, lt), max(1, lc)
    plain = max(1, c - lc)
    base = math.log(c / plain * lc + page * c + math.e)
    return max(0.0, c / t * math.log(max(1.0 + 1e-9, c / some * t / lt) + 1, base + 1e-9)) if base > 0 else 0.0


def _blocks(node: Node, out: list[list[str]], links: set[tuple[Node, int]]) -> None:
    """Text of the subtree, split into blocks, without the items (node, place) in ``links``."""
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.apart:
            block = _is_block(x)
            if block:
                out.append([])
                stack.append(None)
            stack += [k for i, k in reversed([*enumerate(x.items)]) if (x, i) not in links]


def _is_block(x: Node | str) -> bool:
    return isinstance(x, Node) and (x.tag in BLOCK or x.tag == "hr")


def _beside(x: Node, holding: set[Node]) -> tuple[int, set[tuple[Node, int]]]:
    """Characters that ``x`` holds beside its items in ``holding``, and the items that are no
    more than links: blocks, or the text between two blocks, all of it or, from three links
    on, over half of it linked. A headline is never one."""
    runs: list[list[int]] = [[]]
    for i, k in enumerate(x.items):
        if k in holding or _is_block(k):
            runs += [[] if k in holding else [i], []]
        else:
            runs[-1].append(i)
    chars, links = 0, set()
    for run in runs:
        kids = [k for k in (x.items[i] for i in run) if isinstance(k, Node) and not k.apart]
        n = sum(k.chars for k in kids) + sum(len("".join(x.items[i].split())) for i in run if isinstance(x.items[i], str))
        linked, many = sum(k.link_chars for k in kids), sum(k.links + (k.tag == "a") for k in kids)
        if linked and (linked >= n or many > 2 and 2 * linked > n) and not any(k.tag in HEADLINE for k in kids):
            links |= {(x, i) for i in run}
        else:
            chars += n
    return chars, links


def extract(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    if not root.chars:
        return ""
    top = max(order, key=lambda x: x.sum)  # the first of equals: the outermost
    threshold, node = math.inf, top
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    # the largest sum within each subtree
    best = {}
    for x in reversed(order):
        b = x
        for k in x.items:
            if isinstance(k, Node) and not k.apart and best[k].sum > b.sum:
                b = best[k]
        best[x] = b
    chosen, stack = set(), [root]
    while stack:
        x = stack.pop()
        if x.density < threshold:
            continue
        chosen.add(best[x])
        if best[x] is not x:  # what lies beside the chosen subtree may be article, too
            stack += [k for k in x.items if isinstance(k, Node) and not k.apart]
    article: dict[Node, Node | None] = {}  # the outermost around each node
    for x in order:
        article[x] = article.get(x.parent) or (x if x.tag == "article" else None)
    whole = {article[x] or x for x in chosen | {top}}
    holding: set[Node] = set()
    for x in whole:
        while x is not None and x not in holding:
            holding.add(x)
            x = x.parent
    # around the main subtree, the nearest ancestor that holds more than it and links, and main
    inner = node = top
    while node is not None:
        inner = node if node in whole else inner
        node = node.parent
    outer, links, near = inner, set(), False
    while inner.parent is not None:
        inner = inner.parent
        chars, more = _beside(inner, holding)
        links |= more
        if inner.tag == "main" or chars and not near:
            outer, near = inner, True
    kept = whole | {outer}
    parts: list[list[str]] = [[]]
    stack = [root]
    while stack:
        x = stack.pop()
        if x in kept:
            parts.append([])
            _blocks(x, parts, set() if x in whole else links)
            parts.append([])
        else:
            stack += [k for k in reversed(x.items) if isinstance(k, Node) and not k.apart]
    lines = (" ".join(unescape("".join(p)).split()) for p in parts)
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.steps(batches, "html"):
        text = [extract(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
