"""Main-text extraction from HTML by tree scoring.

Paragraphs score points for length and commas and pass them to their parent,
and half to the grandparent; containers start with points by kind and are
discounted by link density. The best container is kept with its siblings, so
leads, headings and short paragraphs beside it stay. Where the page marks an
``article`` or ``main`` around the best container, that is the container, and
only headings, paragraphs and articles of like worth beside it are kept.
Boilerplate is left out everywhere: menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, comments, known by element, class, id or
role; and, where nothing is marked, blocks that are mostly links with short
labels.

Defined results: a null or empty page gives an empty text. Markup may be cut
off, unclosed or misnested: open paragraphs end where a block begins, end tags
without a start are skipped, a tag that never ends takes the rest of the page,
as in a browser, and a quote that never ends ends with its word. All runs of
Unicode white space count as one space. Nothing is capped, and time grows with
the length of the page, whatever its markup. Repeated rows give repeated
results; columns other than those named are ignored and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import python_workers_see_library

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>""")
_OPENS = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>][^\s=/>]*+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")

# Fixed sets of HTML names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_ALIKE = {x: g for g in (("li",), ("dd", "dt"), ("tr",), ("td", "th"), ("option",)) for x in g}
_DROPPED = frozenset("nav footer aside form button select head menu dialog".split())
_START = {"article": 30, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3}
_UNWANTED = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?\w*|consent|notices?|alert|popup|modal|overlay"
    r"|sidebar\w*|menu\w*|nav\w*|breadcrumb\w*|footer|masthead|comments?|comment-\w+|disqus|respond|share|sharing|social"
    r"|related|recommend\w*|newsletter|subscribe|signup|login|search\w*|toolbar|widget\w*|skip)(?:$|[^a-z])",
    re.I,
)


#: Classes that say what a block stands beside, not what it is.
_BESIDE = re.compile(r"(?:^|[-_])(?:has|with|without|no|show|hide)[-_]", re.I)
_HOLDERS = _BLOCKS | {"p", "option", "#root"}  # elements that end or shield others
_ITEMS = {"tr": ("p", "td", "th")}  # what a new element of the kind closes on its way; others close a paragraph


class _Node:
    __slots__ = ("tag", "parent", "children", "unwanted", "score", "length", "linked", "commas", "links", "holder")

    def __init__(self, tag: str, parent: _Node | None, unwanted: bool = False):
        self.tag, self.parent, self.unwanted = tag, parent, unwanted
        self.children: list = []  # nodes and texts in page order
        self.score = 0.0
        self.length = self.linked = self.commas = self.links = 0
        self.holder: _Node = self if parent is None or tag in _HOLDERS else parent.holder


def _is_unwanted(attributes: str) -> bool:
    """Whether class, id or role name a kind of boilerplate."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[2] and m[1].lower() in ("class", "id", "role"):
            if any(_UNWANTED.search(x) and not _BESIDE.search(x) for x in m[2].strip("\"'").split()):
                return True
    return False


def _loose_end(html: str, at: int, unclosed: set[str]) -> int:
    """Where a tag ends whose attributes the quick pattern doesn't know; quotes count after an equals sign."""
    n = len(html)
    while at < n:
        stop = _STOPS.search(html, at)
        if stop is None:
            return n
        at = stop.end()
        if stop[0] == ">":
            return at
        quote = stop[0][-1]
        if quote not in unclosed:
            end = html.find(quote, at)
            if end < 0:
                unclosed.add(quote)  # no later one is closed either
            else:
                at = end + 1
    return n


_STOPS = re.compile(r""">|=\s*+["']""")


def parse(html: str) -> _Node:
    """Tree of the page; texts are decoded, raw elements dropped."""
    root = node = _Node("#root", None)
    open_tags: Counter = Counter()
    unclosed: set[str] = set()
    at, n, pending = 0, len(html), 0

    def close(to: _Node) -> _Node:
        """Leaves ``to`` and all that is open in it."""
        at_node = node
        while True:
            open_tags[at_node.tag] -= 1
            if at_node is to:
                return to.parent
            at_node = at_node.parent

    while at < n:
        less = html.find("<", at)
        if less < 0:
            break
        m = _TAG.match(html, less)
        begin = m or _OPENS.match(html, less)
        mark = html[less + 1 : less + 2]
        if begin is None and mark not in ("!", "?", "/"):  # a plain character, and part of the text
            at = less + 1
            continue
        if begin is None and mark == "/" and less + 2 >= n:
            break
        if less > pending:
            node.children.append(unescape(html[pending:less]))
        if begin is None:
            end = html.find("-->", less + 4) + 2 if html.startswith("<!--", less) else html.find(">", less)
            at = pending = end + 1 if end > 1 else n
            continue
        end = m.end() if m else _loose_end(html, begin.end(), unclosed)
        attributes = html[begin.end(2) : end]
        at = pending = end
        name = begin[2].lower()
        if begin[1]:
            if open_tags[name] > 0:
                up = node
                while up.tag != name:
                    up = up.parent
                node = close(up)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                node.children.append(" ")
            continue
        if name in _RAW:
            if not attributes.rstrip("> \t\n").endswith("/"):
                ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                stop = html.find(">", ends.end()) if ends else -1
                at = pending = stop + 1 if stop >= 0 else n
            continue
        if name in _BLOCKS and open_tags["p"] > 0:
            up = node.holder
            while up.tag in ("li", "dd", "dt"):
                up = up.parent.holder
            if up.tag == "p":
                node = close(up)
        if name in _ALIKE and any(open_tags[x] > 0 for x in _ALIKE[name]):
            up = node.holder
            while up.tag in _ITEMS.get(name, ("p",)) and up.tag not in _ALIKE[name]:
                up = up.parent.holder
            if up.tag in _ALIKE[name]:
                node = close(up)
        unwanted = name in _DROPPED or (name == "header" and open_tags["article"] <= 0)
        if not unwanted and "=" in attributes and name not in ("body", "html", "article", "main", "p"):
            unwanted = _is_unwanted(attributes)
        child = _Node(name, node, unwanted)
        open_tags[name] += 1
        node.children.append(child)
        node = child
    if pending < n:
        node.children.append(unescape(html[pending:]))
    return root


def _measure(root: _Node) -> list[_Node]:
    """Lengths, commas and linked lengths from the leaves up; nodes in page order, unwanted ones left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, _Node) and not c.unwanted]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                size = len(c.strip())
                node.length += size
                node.commas += c.count(",")
            elif not c.unwanted:
                node.length += c.length
                node.commas += c.commas
                node.linked += c.linked
                node.links += c.links
        if node.tag == "a":
            node.linked, node.links = node.length, 1
    return order


def _density(node: _Node) -> float:
    return node.linked / node.length if node.length else 0.0


def main_container(root: _Node) -> list[_Node]:
    """The best container and the siblings that belong to it, in page order."""
    order = _measure(root)
    reached: dict[int, _Node] = {}

    def give(node: _Node | None, points: float) -> None:
        if node is not None:
            if id(node) not in reached:
                reached[id(node)] = node
                node.score = _START.get(node.tag, 0)
            node.score += points

    for node in order:
        own_text = node.tag in ("p", "pre", "td", "blockquote", "h1", "h2", "h3", "li") or (
            (node.tag in _BLOCKS or node.parent is None) and any(isinstance(c, str) and c.strip() for c in node.children)
        )
        if own_text and node.length:
            points = (1 + node.commas + min(node.length / 100, 3)) * (1 - _density(node))
            if node.tag in ("p", "pre", "td", "blockquote", "h1", "h2", "h3", "li"):
                give(node.parent, points)
                give(node.parent.parent if node.parent else None, points / 2)
            else:
                give(node, points)
                give(node.parent, points / 2)
    best, most = None, 0.0
    for node in reached.values():
        worth = node.score * (1 - _density(node))
        if node.length and (best is None or worth > most):
            best, most = node, worth
    if best is None:
        return []
    marked = best
    while marked is not None and marked.tag not in ("article", "main"):
        marked = marked.parent
    if marked is not None:
        if marked.tag == "main" or marked.parent is None:
            return [marked]
        least = 0.2 * marked.score * (1 - _density(marked))
        like = lambda c: c.tag == "article" and c.score * (1 - _density(c)) >= least
        beside = [c for c in marked.parent.children if isinstance(c, _Node) and not c.unwanted]
        return [c for c in beside if c is marked or c.tag in _PROSE or like(c)]
    # Nothing is marked: the container and all its siblings, without what looks like a menu.
    return [best if best.parent is None or best.tag in ("body", "html") else best.parent]


_PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote figure".split())


def _is_menu(node: _Node) -> bool:
    """Mostly links, with labels of a few words each."""
    return node.tag in ("ul", "ol", "div", "section", "table") and _density(node) > 0.5 and node.linked < 25 * node.links


def _texts(node: _Node, out: list[str], menus: bool) -> None:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.unwanted or (menus and x is not node and _is_menu(x)):
            continue
        if x.tag in _BLOCKS:
            stack.append(" ")
            out.append(" ")
        stack += reversed(x.children)


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one space between, white space folded."""
    out: list[str] = []
    nodes = main_container(parse(html or ""))
    marked = any(x.tag in ("article", "main") for x in nodes)
    for node in nodes:
        _texts(node, out, menus=not marked)
        out.append(" ")
    return " ".join("".join(out).split())


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every page."""
    python_workers_see_library(pages.sparkSession)
    slim = pages.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(html).alias("_h"))
    out = T.StructType([*slim.schema.fields[:-1], T.StructField("_h", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=b.schema.names)

    return slim.mapInArrow(run, out).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_h").alias("text"),
        F.length("_h").cast("long").alias("n_chars"),
    )
