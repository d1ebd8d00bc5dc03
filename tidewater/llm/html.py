"""Main text of web pages by composite text density.

A page becomes a tree. Each node has its characters, tags, link characters and
link tags, and from these a density: characters per tag, damped by the share
of links in the node and in the page. Densities of a node's children are
summed; the lowest density on the path from the node with the largest sum to
the body is the threshold. From the body down, each branch that reaches it
keeps its subtree with the largest sum, so an article split over several
branches is whole. Prose between kept branches stays, and the headline before
them. An article or main element is a hint: the densest subtree widens to the
one around it unless that adds mostly links. Template parts (menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments) are cut before, by element or by whole
tokens of class, id and role, and never count; but no node is cut that holds an
article or main element or most of the page's text outside links (the latter
never spares nav and footer elements).

Text: character references decoded, white space inside a block turned into one
space, trimmed; blocks in page order, joined by one space.

Defined results: null or blank html gives empty text; markup that is cut off
or badly nested is read as far as it goes; each row gets its own result,
repeated rows included; an empty table gives an empty table; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.registry import register

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text.
SILENT = frozenset("script style noscript template iframe object svg math canvas head title select option "
                   "textarea button audio video map datalist".split())
#: What may stand in a head; anything else ends it, as its end tag may be missing.
HEAD_PARTS = frozenset("base basefont bgsound command link meta noframes noscript script style template title".split())
#: Elements of other languages, which a slash before the bracket closes.
FOREIGN = frozenset(("svg", "math"))
#: Page furniture by element. header and footer count as article parts inside
#: an article that has its own headline there, so only headers without one go.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
#: Page furniture by a whole token of class, id or role.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget related "
    "recommended promo promotion sponsor sponsored ad ads advert adverts advertisement advertising cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments reply replies disqus respond form search pagination pager toolbar skip copyright legal "
    "contentinfo complementary".split())
#: Elements that stay, whatever their class says.
MAIN = frozenset(("html", "body", "article", "main"))
#: Elements that hold the main text where a page has them.
HOLDERS = frozenset(("article", "main"))
#: Furniture words that inside an article name its own head.
HEADS = frozenset(("header", "masthead"))
#: Words of readers' comments.
REPLIES = frozenset("comment comments reply replies disqus respond".split())
#: Furniture words of parts that may hold more text than a short article.
FIXED = REPLIES | frozenset("nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr copyright legal "
                            "contentinfo".split())
#: Inline elements: the text around them is one block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: An open element of the key is closed by an opening one of the values.
_BLOCK_START = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
                         "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"p": _BLOCK_START, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
#: How deep the tree may nest; deeper elements join their ancestor at this depth.
MAX_DEPTH = 256
#: Blocks that belong to the dense ones they stand between.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parts", "parent", "depth", "furniture", "reply", "fixed", "chars", "tags", "link_chars", "link_tags", "density", "total",
                 "inline", "top", "run")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.reply = self.fixed = False
        self.parts: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def is_furniture(tag: str, attrs: list[tuple[str, str | None]], parent: Node) -> bool:
    """Whether a node is furniture by its element or a whole token of class, id
    or role, unless ``spare`` finds that it holds the page's text."""
    if tag in MAIN:
        return False
    if tag in FURNITURE:
        return True
    # the header of an article has its headline
    words = FURNITURE_WORDS - HEADS if _inside(parent, HOLDERS) else FURNITURE_WORDS
    return tag == "header" and words is FURNITURE_WORDS or not words.isdisjoint(_tokens(attrs))


def _tokens(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Tokens of class, id and role. Of a compound one only the whole counts,
    or its words where each is a furniture word (cookie-banner)."""
    out = set()
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for token in v.lower().split():
                words = _WORD.findall(token)
                out.update(words if FURNITURE_WORDS.issuperset(words) else [token])
    return out


def spare(root: Node) -> None:
    """Nodes that hold an article or main element, or most of the page's text
    outside links, are no furniture. Comments, footers and the like are, however
    long, where an article or main element beside them has text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    plain, holds = {}, {}
    for node in reversed(order):
        inner = [x for x in node.parts if isinstance(x, Node)]
        own = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        plain[node] = 0 if node.tag == "a" else own + sum(plain[x] for x in inner)
        holds[node] = any(holds[x] for x in inner) or (
            node.tag in HOLDERS and not node.reply and plain[node] > 0)
    for node in order:
        if node.furniture:
            most = 2 * plain[node] > plain[root] and node.tag not in ("nav", "footer") and not (node.fixed and holds[root])
            node.furniture = not holds[node] and not most


def _inside(node: Node | None, tags: frozenset) -> bool:
    while node:
        if node.tag in tags:
            return True
        node = node.parent
    return False


class Builder(HTMLParser):
    """Element tree of a page, tolerant of missing and stray end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.silent: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"] and tag not in HEAD_PARTS and tag not in ("head", "html"):
            self.silent.clear()
        if self.silent:
            if self.silent[-1] == "head" and tag in SILENT:
                self.silent.append(tag)
                return
            if tag == self.silent[-1]:
                self.silent.append(tag)
            return
        if tag in ("html", "body"):
            return
        if tag in SILENT:
            self.silent.append(tag)
            return
        if tag in _BLOCK_START or tag in CLOSED_BY:
            self._close_implied(tag)
        node = Node(tag, self.at, is_furniture(tag, attrs, self.at))
        tokens = _tokens(attrs)
        node.reply = self.at.reply or not REPLIES.isdisjoint(tokens)
        node.fixed = not FIXED.isdisjoint(tokens)
        self.at.parts.append(node)
        if tag not in VOID and node.depth < MAX_DEPTH:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        # a slash means nothing on an element that is not void, but for those of
        # other languages and what is in them
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN and self.silent and self.silent[-1] == tag:
            self.silent.pop()

    def _close_implied(self, tag):
        node = self.at
        while node.parent and (node.tag in INLINE or node.tag in CLOSED_BY):
            if tag in CLOSED_BY.get(node.tag, ()):
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag in ("head", "body", "html"):
                self.silent.clear()
            return
        node = self.at
        while node.parent:
            if node.tag == tag:
                self.at = node.parent
                return
            # an inline end tag does not close the blocks around it
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.parent

    # a page is fed whole, so a comment or an instruction without an end runs to
    # the end of the page; looking for more of the kind in it would be quadratic
    def parse_comment(self, i, report=True):
        k = super().parse_comment(i, report)
        return len(self.rawdata) if k < 0 else k

    def parse_pi(self, i):
        k = super().parse_pi(i)
        return len(self.rawdata) if k < 0 else k

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.silent.clear()
        if not self.silent:
            self.at.parts.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    spare(builder.root)
    return builder.root


def measure(root: Node) -> list[Node]:
    """Fill in the measures and densities; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += reversed(children(node))
    for node in reversed(order):
        inner = children(node)
        own = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        node.chars = own + sum(x.chars for x in inner)
        node.tags = sum(x.tags + 1 for x in inner)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in inner)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in inner)
        node.inline = (node.tag in INLINE or node.tag in VOID) and all(x.inline for x in inner)
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(order):
        node.density = composite_density(node, share)
        # a node's own text, with the inline elements in it, is one child more
        run, inner = Node("", None), children(node)
        outer = [x for x in inner if not x.inline]
        for name in ("chars", "tags", "link_chars", "link_tags"):
            setattr(run, name, getattr(node, name) - sum(getattr(x, name) for x in outer))
        run.tags -= len(outer)
        run.link_tags -= sum(x.tag == "a" for x in outer)
        if node.tag == "a":
            run.link_chars = run.chars
        node.run = composite_density(run, share)
        node.total = sum(x.density for x in outer) + node.run
        node.top = max([node, *(x.top for x in outer)], key=lambda n: n.total)  # the first of equals
    return order


def children(node: Node) -> list[Node]:
    return [x for x in node.parts if isinstance(x, Node) and not x.furniture]


def composite_density(node: Node, body_share: float) -> float:
    """Characters per tag, to a base that grows with the share of links."""
    c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    if not c:
        return 0.0
    rest = max(c - node.link_chars, 1)
    base = math.log(c / rest * node.link_chars + body_share * c + math.e)
    return c / t * math.log(c / lc * t / lt + 1) / math.log(max(base, 1.0) + 1)


def main_nodes(root: Node) -> list[Node | str]:
    """The subtrees that hold the main text, in page order."""
    order = measure(root)
    best = root.top
    if not best.total:
        return list(root.parts)
    threshold = min(x.density for x in _path(best))
    kept, loose, stack = {_widened(best)}, set(), [root]
    while stack:
        node = stack.pop()
        if node in kept or node.inline or node.density < threshold:
            continue
        kept.add(node.top)
        if node.run >= threshold:
            loose.add(node)  # its own text
        stack += [] if node.top is node else children(node)
    found = _outermost(order, kept)
    # short blocks of one article, which stand between its dense ones
    if len(found) > 1:
        kept.update(_between(found))
        found = _outermost(order, kept)
    # its headline often stands outside
    first = order.index(found[0])
    head = next((x for x in reversed(order[:first]) if x.tag == "h1" and x.chars), None)
    if head and 2 * head.link_chars <= head.chars and not any(x.tag == "h1" for x in _inner(found)):
        kept.add(head)
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x in kept or x.inline:
            out.append(x)
        else:
            stack += reversed([
                y for y in x.parts if isinstance(y, str) and x in loose
                or isinstance(y, Node) and not y.furniture and (x in loose or y in kept or not y.inline)])
    return out


def _path(node: Node) -> list[Node]:
    """The node and its ancestors, up to the body."""
    out = []
    while node:
        out.append(node)
        node = node.parent
    return out


def _widened(best: Node) -> Node:
    """The article or main element around the densest subtree, if the rest of
    it is not mostly links: a hint that short blocks beside it belong to it."""
    for x in _path(best):
        if x.tag in ("article", "main"):
            return x if 2 * (x.link_chars - best.link_chars) <= x.chars - best.chars else best
    return best


def _outermost(order: list[Node], kept: set[Node]) -> list[Node]:
    """Those of the nodes that stand in no other, in page order."""
    inside, out = set(), []
    for x in order:
        if x.parent in inside:
            inside.add(x)
        elif x in kept:
            inside.add(x)
            out.append(x)
    return out


def _between(found: list[Node]) -> list[Node]:
    """Blocks of prose between the first and the last of the subtrees, in the
    element that holds them all."""
    paths = [_path(x)[::-1] for x in found]
    depth = 0
    while all(len(p) > depth + 1 and p[depth + 1] is paths[0][depth + 1] for p in paths):
        depth += 1
    inner = children(paths[0][depth])
    first, last = (inner.index(p[depth + 1]) for p in (paths[0], paths[-1]))
    return [x for x in inner[first:last] if x.tag in PROSE and 2 * x.link_chars <= x.chars]


def _inner(nodes: list[Node]) -> Iterator[Node]:
    stack = list(nodes)
    while stack:
        node = stack.pop()
        yield node
        stack += children(node)


def blocks(parts: list[Node | str]) -> list[str]:
    """Texts of the blocks, in page order."""
    out: list[list[str]] = [[]]
    stack: list[Node | str | None] = list(reversed(parts))
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.furniture:
            if x.tag in INLINE:
                stack += reversed(x.parts)
            else:
                out.append([])
                stack.append(None)
                stack += reversed(x.parts)
    joined = (" ".join("".join(b).split()) for b in out)
    return [b for b in joined if b]


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    return " ".join(blocks(main_nodes(parse(html))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [main_text(h) for h in b["html"]]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string")


@register("op3_html_text")
def op3_html_text(spark, sf_dir):
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
