"""Main text of web pages by composite text density.

A page becomes a tree of elements. A node of C characters and T tags, of which LC characters and LT tags are in links,
has the density

    C / T * log_base(C / LC * T / LT),   base = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

(characters per tag, adjusted by links; counts below one count as one). Nodes are rated by the sum of their children's
densities, markup inside a line of text (links, bold and the like) not counting as a child. The lowest density between the best node and the body is the threshold; from the body down, every node
above it marks its best descendant, whose subtree is taken. Elements that hold no article text by their kind (menus,
forms, scripts and the like; a header only outside of an article) and hidden ones are left out of tree and text. Class and id
names raise doubts. A subtree named as an advert, a notice or comments is left out, whatever its size, unless it alone
holds the page's headline or article. Other names (related, header, side and the like) leave a subtree out where a third of its
text is in links, or where its text per tag is below the page's and it holds neither the headline nor half of the page. If nothing
would be left, doubts do not count.

Tags are read in one pass: what looks like a tag but meets another ``<`` before its end is text, end tags without an open element
are passed over by a count, and optional end tags look at enclosing blocks only, so that hostile pages take linear time too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import pieces, ship

_INSIDE = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b{_INSIDE}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_INSIDE})>|<[!?][^<>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Class, id and role names of adverts, notices and reader comments: whole names, or parts of names.
_FIRM = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*)(?:$|\s)|(?:^|[\s_-])(?:comments?|disqus|respond|replies|notices?|cookies?|consent|gdpr|"
    r"popup|modal|newsletter|subscribe|signup|login)(?:$|[\s_-])",
    re.I,
)
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line of text.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements that hold no article text.
_LEFT_OUT = frozenset(
    "nav header footer aside form head script style noscript template button select option textarea iframe svg object dialog menu".split()
)
#: Parts of class and id names that raise a doubt.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|"
    r"footer\w*|masthead|topbar|header|alert|reviews?|share|sharing|social|related|recommended|widget\w*|toolbar|pagination|pager|contentinfo|"
    r"complementary|search)(?:$|[\s_-])",
    re.I,
)
_KEPT = frozenset("html body article main".split())
_CLOSED_BY = {
    "p": frozenset(
        "p div article section ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre hr main figure address fieldset nav header footer aside form".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: An open element is not closed across these.
_SCOPE = frozenset("body article main section div td th table ul ol dl blockquote aside nav header footer form figure".split())


class _Node:
    __slots__ = (
        "tag", "parent", "children", "out", "doubt", "link", "block", "article", "flat", "c", "t", "lc", "lt", "density", "total", "best", "marked"
    )

    def __init__(self, tag: str, parent: _Node | None, out: bool, link: bool):
        self.tag, self.parent, self.out, self.link = tag, parent, out, link
        #: 0 none, 1 a name that is often harmless, 2 a name of what never belongs to an article.
        self.doubt = 0
        #: The nearest node, itself included, that an optional end tag could close or that it must not cross.
        self.block = self if parent is None or tag in _SCOPE or tag in _CLOSED_BY else parent.block
        self.article = tag in ("article", "main") or parent is not None and parent.article
        #: Markup of a line of text, without blocks inside.
        self.flat = False
        self.children: list[_Node | str] = []
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0
        self.best, self.marked = self, False


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is left out, and the doubt that its names raise."""
    if tag in _LEFT_OUT and not (tag == "header" and in_article):
        return True, 0
    if not attributes:
        return False, 0
    doubt = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if tag in _KEPT and name not in ("class", "id", "role"):
            continue
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
            return True, 0
        if name in ("class", "id", "role"):
            doubt = max(doubt, 2 if _FIRM.search(value) else int(bool(_MARKS.search(value))))
    return False, 0 if tag in ("html", "body") else doubt


def _without_doubtful(nodes: list[_Node]) -> list[_Node]:
    """Takes doubtful subtrees that hold no article text out of the tree; returns the nodes that stay."""
    if not any(node.doubt for node in nodes):
        return nodes
    held = {}
    for node in reversed(nodes):
        text = linked = tags = 0
        # Headlines and articles below, and those of them that no firm name stands over.
        heads = clear = int(node.tag in ("h1", "article", "main"))
        for child in node.children:
            if isinstance(child, str):
                size = len("".join(child.split()))
                text, linked = text + size, linked + size * node.link
            else:
                c, lc, t, h, free = held[id(child)]
                text, linked, tags, heads, clear = text + c, linked + lc, tags + t + 1, heads + h, clear + free
        held[id(node)] = text, linked, tags, heads, 0 if node.doubt == 2 else clear
    whole, _linked, all_tags, _heads, clear = held[id(next((node for node in nodes if node.tag == "body"), nodes[0]))]
    stay, shortened, left = [], {}, 0
    for node in nodes:
        node.out = node.parent is not None and node.parent.out
        if node.doubt and not node.out:
            c, lc, t, heads, _clear = held[id(node)]
            if node.doubt == 2:
                # Its headline counts only where no other place has one.
                node.out = bool(clear) or not heads
            else:
                sparse = c * max(all_tags, 1) < whole * max(t, 1) and not heads and 2 * c < whole
                node.out = 3 * lc >= c or sparse
            if node.out:
                shortened[id(node.parent)] = node.parent
        if not node.out:
            stay.append(node)
            left += sum(len(child.strip()) for child in node.children if isinstance(child, str))
    if not left:
        return nodes
    for node in shortened.values():
        node.children = [child for child in node.children if isinstance(child, str) or not child.out]
    return stay


def parse(html: str) -> tuple[_Node, list[_Node]]:
    """The root and all nodes in page order. Left-out elements stay in the tree while open, their text does not."""
    root = _Node("html", None, False, False)
    here, nodes, at = root, [root], 0
    open_tags: dict[str, int] = {}

    def close(node: _Node) -> _Node:
        """Ends everything from the innermost open element up to this one; each element is ended once."""
        inner = here
        while inner is not node.parent:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return node.parent

    for match in _TOKEN.finditer(html):
        if match.start() > at and not here.out:
            here.children.append(html[at : match.start()])
        at = match.end()
        name = match[3]
        if not name:
            continue
        tag = name.lower()
        if match[2]:
            if open_tags.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = close(node)
            continue
        if tag == "html":
            continue
        node = here.block
        while node is not root and node.tag not in _SCOPE:
            if tag in _CLOSED_BY[node.tag]:
                here = close(node)
                break
            node = node.parent.block
        left_out, doubt = (True, 0) if here.out else _left_out(tag, match[4], here.article)
        out = here.out or left_out
        node = _Node(tag, here, out, here.link or tag == "a")
        node.doubt = doubt
        if not out:
            here.children.append(node)
            nodes.append(node)
        if tag not in _VOID and not match[4].endswith("/"):
            here = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(html) and not here.out:
        here.children.append(html[at:])
    return root, _without_doubtful(nodes)


def _rate(root: _Node, nodes: list[_Node]) -> _Node:
    """Densities and their sums; returns the body, or the root where there is none."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                size = len("".join(child.split()))
                node.c += size
                node.lc += size * node.link
            else:
                node.c += child.c
                node.t += child.t + 1
                node.lc += child.lc
                node.lt += child.lt + (child.tag == "a")
        node.flat = (node.tag in _INLINE or node.tag == "br") and all(isinstance(child, str) or child.flat for child in node.children)
    body = next((node for node in nodes if node.tag == "body"), root)
    linked = max(body.lc, 1) / max(body.c, 1)
    for node in reversed(nodes):
        if node.c:
            c, t, lc, lt = node.c, max(node.t, 1), max(node.lc, 1), max(node.lt, 1)
            base = log(c / max(c - node.lc, 1) * lc + linked * c + e)
            node.density = c / t * log(max(c / lc * t / lt, 1.0)) / log(max(base, 1.0001)) if base > 1 else 0.0
        # Markup inside a line is no place of its own: it would raise a paragraph over the article that holds it.
        inner = [child for child in node.children if not isinstance(child, str) and not child.flat]
        node.total = sum(child.density for child in inner) or node.density
        for child in inner:
            if child.best.total > node.best.total:
                node.best = child.best
    return body


def _mark(body: _Node) -> None:
    path, node = [body.density], body.best
    while node is not None and node is not body:
        path.append(node.density)
        node = node.parent
    least = min(path)
    waiting = [body]
    while waiting:
        node = waiting.pop()
        if node.marked or node.density < least or not node.c:
            continue
        node.best.marked = True
        waiting += [child for child in node.children if not isinstance(child, str)]


def _blocks(node: _Node, on: bool, out: list[str]) -> None:
    """Text runs in page order; a NUL stands where a block begins or ends."""
    stack: list[tuple[_Node | str, bool]] = [(node, on)]
    while stack:
        item, on = stack.pop()
        if isinstance(item, str):
            if on:
                out.append(item)
            continue
        on = on or item.marked
        if item.tag == "br":
            out.append(" ")
        elif item.tag not in _INLINE:
            out.append("\0")
            stack.append(("\0", True))
        stack += [(child, on) for child in reversed(item.children)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root, nodes = parse(html.replace("\0", " "))
    _mark(_rate(root, nodes))
    runs: list[str] = []
    _blocks(root, False, runs)
    blocks = ("".join(runs)).split("\0")
    return " ".join(text for text in (" ".join(unescape(block).split()) for block in blocks) if text)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, one by one; a null, empty or textless page gives an empty text."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
