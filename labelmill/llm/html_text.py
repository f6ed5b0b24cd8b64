"""Main text of web pages by composite text density.

A page becomes a tree of elements. The density of a node is its characters per tag, adjusted
for links: text inside links counts against it. Each node's density sum adds up the
densities of its children, and the node with the largest sum holds the article. What stands
beside the path from there to the body (a title, a closing paragraph, bare text) is taken
along unless it is mostly links: density grows with length and says little about a short
block. Menus, notices,
adverts, forms, comments and the like are taken out of the tree first, by element, role
and class, whatever their density; of a form around most of the page only the controls.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelmill.llm.steps import bounded_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
DROP = frozenset("script style title head noscript template iframe object embed svg canvas math audio video map nav header footer aside form button select textarea input label fieldset dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("table ul ol dl select body html article section main div td th".split())
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notification notifications overlay pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
#: Names that an article's own parts have too.
AMBIGUOUS = frozenset(
    "banner comment comments discussion menu navigation notice notification notifications promotion recommended related replies respond share sharing skip social sponsor sponsored subscription".split()
)
TITLED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|(/?)([A-Za-z][^\s/>]*)([^>]*)>)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: str = "", parent: "Node | None" = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree of a page. End tags that nothing opened are ignored; open elements close at
    the end tags, blocks and siblings that imply it."""
    root = Node("html")
    at, here = root, 0
    low = None
    while True:
        lt = page.find("<", here)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if lt < 0:
            break
        if m is None:  # a bare "<"
            at.children.append(page[here : lt + 1])
            here = lt + 1
            continue
        if lt > here:
            if at.tag == "head" and page[here:lt].strip():
                at = at.parent
            at.children.append(page[here:lt])
        here = m.end()
        if m[1] is not None:
            at.children.append(html.escape(m[1]))
            continue
        name = m[3] or m[7]
        if name is None:
            continue
        name, closing, attrs = name.lower(), bool(m[2] or m[6]), m[4] or m[8] or ""
        if closing:
            node = at
            while node is not None and node.tag != name:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if name == "html":
            continue
        if at.tag == "head" and name not in HEAD:  # its end tag may be left out
            at = at.parent
        if name in CLOSES_P:
            node = at
            while node is not None and node.tag != "p" and node.tag not in SCOPES:
                node = node.parent
            if node is not None and node.tag == "p":
                at = node.parent
        if name in SIBLINGS:
            node, stop = at, SIBLINGS[name]
            edge = {"table"} if name in ("tr", "td", "th") else {"ul", "ol", "dl", "select", "table"}
            close = None
            while node is not None and node.tag not in edge:
                if node.tag in stop:
                    close = node
                node = node.parent
                if close is not None and name in ("td", "th"):
                    break
            if close is not None:
                at = close.parent
        node = Node(name, attrs, at)
        at.children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            low = low if low is not None else page.lower()
            end = low.find(f"</{name}", here)
            text, here = (page[here:], len(page)) if end < 0 else (page[here:end], end)
            if name in ("title", "textarea"):
                node.children.append(text)
            if end >= 0:
                gt = page.find(">", end)
                here = len(page) if gt < 0 else gt + 1
            continue
        at = node
    if here < len(page):
        if at.tag == "head":
            at = at.parent
        at.children.append(page[here:])
    return root


def _mostly_links(node: Node) -> bool:
    chars, linked, work = 0, 0, [(node, node.tag == "a")]
    while work:
        item, link = work.pop()
        for c in item.children:
            if isinstance(c, str):
                n = len(_SPACE.sub("", c))
                chars, linked = chars + n, linked + n * link
            else:
                work.append((c, link or c.tag == "a"))
    return linked * 2 > chars


def _not_text(node: Node, inside: bool) -> bool:
    """Whether an element is outside of an article by its kind. ``inside`` an article or
    main element a header is the article's own, ids of headings and sections are anchors,
    and ambiguous names count only for elements that are mostly links."""
    if node.tag in DROP:
        return not (node.tag == "header" and inside)
    if not node.attrs or node.tag in ("body", "html", "main", "article"):
        return False
    for key, *value in _ATTR.findall(node.attrs):
        key, value = key.lower(), "".join(value).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key == "role" and value in NOT_ROLES:
            return True
        if key in ("class", "id"):
            for name in value.split():
                parts = _SPLIT.split(name)
                found = NOT_TEXT.intersection(parts)
                if inside and (key == "id" and node.tag in TITLED or found <= AMBIGUOUS and not _mostly_links(node)):
                    continue
                if parts[0] not in ("has", "with", "no", "is", "not") and (found or name in ("header", "site-header", "page-header") and not inside):
                    return True
    return False


def prune(root: Node) -> None:
    """Take out everything that is no article text by its kind. A form that holds most of
    the body's text is a frame around the page: only its controls and labels go."""
    work, forms = [(root, False)], []
    while work:
        node, inside = work.pop()
        inside = inside or node.tag in ("article", "main")
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif child.tag == "form" or not _not_text(child, inside):
                kept.append(child)
                work.append((child, inside))
                if child.tag == "form":
                    forms.append(child)
        node.children = kept
    if forms:
        order = _measure(root)
        body = next((n for n in order if n.tag == "body"), root)
        whole = body.chars or root.chars
        for form in forms:
            if form.chars * 2 <= whole:
                form.parent.children = [c for c in form.parent.children if c is not form]


def _measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes; nodes in page order."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub("", c))
            else:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    whole_chars, whole_links = max(root.chars, 1), root.link_chars
    for node in order:
        node.density = 0.0
        if node.chars:
            c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - lc, 1) * lc + whole_links / whole_chars * c + math.e)
            ratio = (c / max(lc, 1)) * (t / lt)
            node.density = c / t * max(math.log(max(ratio, 1.0)) / math.log(max(base, 1.0001)), 0.0)
    for node in order:
        node.total = sum(c.density for c in node.children if not isinstance(c, str))
        if any(isinstance(c, str) and c.strip() for c in node.children):
            node.total = max(node.total, node.density)
    return order


def main_nodes(root: Node) -> list[Node | str]:
    """Nodes and bare texts of the main text in page order."""
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars and root.chars:
        body = root
    if not body.chars:
        return []
    best = max((n for n in order if n.chars), key=lambda n: n.total)
    path, node = [], best
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    framed = [n for n in path if n.tag in ("article", "main")]
    if framed:
        return [framed[-1]]
    articles = [n for n in order if n.tag in ("article", "main") and n.chars * 2 > body.chars]
    if articles:
        return [articles[0]]
    taken: list[Node | str] = [best]
    for child, parent in zip(path, path[1:]):
        where = next(i for i, c in enumerate(parent.children) if c is child)
        taken = _beside(parent.children[:where]) + taken + _beside(parent.children[where + 1 :])
    return taken


def _beside(items: list[Node | str]) -> list[Node | str]:
    """Neighbours of the path that are not mostly links: blocks, and lines of bare text
    with the inline elements among it."""
    out, line = [], []

    def flush():
        parts = [(c.chars, c.link_chars) if isinstance(c, Node) else (len(_SPACE.sub("", c)), 0) for c in line]
        if sum(p[1] for p in parts) * 2 <= sum(p[0] for p in parts):
            out.extend(line)
        line.clear()

    for c in items:
        if isinstance(c, str) or c.tag not in BLOCK and not any(isinstance(x, Node) and x.tag in BLOCK for x in c.children):
            line.append(c)
            continue
        flush()
        if c.tag in ("br", "hr") or c.chars and c.link_chars * 2 <= c.chars:
            out.append(c)
    flush()
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    """Text of each block below the nodes, references decoded, white space as one space."""
    out, line = [], []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        work: list = [(top, False)]
        while work:
            item, closed = work.pop()
            if isinstance(item, str):
                line.append(item)
                continue
            if item.tag in BLOCK:
                flush()
            if closed:
                continue
            work.append((item, True))
            work.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, a line per block; '' for null, empty and textless pages."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(main_nodes(root)))


def _texts(column: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in column], dtype=object)


def main_text_column(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(html_text: pd.Series) -> pd.Series:
        return _texts(html_text)

    return extract(page.cast("string"))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` with text and n_chars (replacing columns of these names).

    A narrow step: pages are read one by one, so repeated rows get equal texts.
    """
    pages = bounded_batches(pages.drop("text", "n_chars"))
    out = pages.withColumn("text", main_text_column(F.col(column)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
