"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that announce themselves as menus, headers, footers, sidebars, notices, adverts, forms or reader comments (by
name, role, class or id) go first. For every other element its composite density is its characters per tag, adjusted by the share of
characters and tags in links; an element's density sum is the sum over its children. The element with the largest sum is the seed of the article: if
it lies in an `article` or `main`, that element is the article, else the seed and every text block beside its path to the body that is at least as dense as the
sparsest element on that path. Bare text and inline elements between blocks are a block.

Blocks of text are joined by one line break, white space inside a block is one space, character references are decoded.

Results: a null, empty or text-free page has an empty text. Cut-off markup at a page's end is markup; unknown elements are inline; deep nesting is
followed without recursion. Equal sums go to the first element of the page. Repeated rows and rows without id are pages like others; other columns are carried along.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+[^>]*)(?:>|\Z)""",
    re.S,
)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg select audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # what an element ends when it begins
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
HOLDS = frozenset("table ul ol dl menu body html article section div".split())  # elements that such an ending does not reach beyond
# Names that say what an element is.
NOT_TEXT = frozenset("nav header footer aside form button dialog menu fieldset label input head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion"
    " banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments commentary disqus respond replies reply breadcrumb breadcrumbs share sharing social related recommended recommendations"
    " widget toolbar pagination pager skip disclaimer copyright paywall outbrain taboola".split()
)
# Words in a name that say where or how an element stands, not what it is, and words that say what an element lacks or has beside it.
WAYS = frozenset(
    "area author bar block body bottom box button buttons col column container content desktop first form heading icon icons inner item items last left lg link links list main md"
    " meta mobile outer panel post posts article articles primary right row secondary section slot sm stories story news text this title top unit wrap wrapper zone".split()
)
LEDE_WORDS = 10  # of a paragraph in an article's header that is text and no line about the author or the date
BESIDE = frozenset("no not has with without".split())
MOST_TEXT = 0.9  # share of the page's plain text that no name takes away
ROOTS = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("children", "drop", "name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "plain")

    def __init__(self, name: str, parent: Node | None, drop: str = ""):
        self.name, self.parent, self.drop, self.plain = name, parent, drop, 0
        self.parts: list = []  # texts and elements, in page order
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        if parent is not None:
            parent.parts.append(self)
            parent.children.append(self)


def _telling(names: str) -> bool:
    """Whether a class or id names something beside the article: what it is stands last, but for words that only say where or how."""
    for name in names.split():
        parts = [p.lower() for p in _name_parts.findall(name)]
        if BESIDE.intersection(parts):
            continue
        while len(parts) > 1 and (parts[-1] in WAYS or len(parts[-1]) == 1):
            parts.pop()
        if parts and parts[-1] in NOT_ARTICLE:
            return True
    return False


def _announced(name: str, attributes: str) -> str:
    """How an element says that it is not the article: by what it is, by its name, or not at all."""
    if name in NOT_TEXT:
        return "kind"
    if not attributes or name in ROOTS - {"article"}:
        return ""
    named = ""
    for key, *values in _attribute.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "kind"
        if key == "role" and value.lower() in ROLES:
            return "kind"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "kind"
        if key in ("class", "id") and _telling(value):
            named = "name"
    return named


def parsed(html: str) -> Node:
    """The page's elements. End tags close what they name and all inside it; missing ones are implied as browsers do for common cases."""
    root = Node("body", None)
    at, node, at_end = 0, root, len(html)
    while at < at_end:
        low = html.find("<", at)
        if low < 0:
            node.parts.append(html[at:])
            break
        found = _token.match(html, low)
        if found is None:  # a sign, not a tag
            nxt = html.find("<", low + 1)
            nxt = at_end if nxt < 0 else nxt
            node.parts.append(html[at:nxt])
            at = nxt
            continue
        if low > at:
            node.parts.append(html[at:low])
        at = found.end()
        end, start, attributes = found.groups()
        if start is not None:
            name = start.lower()
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = close.end() if close else at_end
                continue
            if name in ("html", "body"):
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    Node(name, node)
                continue
            node = _implied_end(node, name)
            node = Node(name, node, _announced(name, attributes))
        elif end is not None:
            node = _closed(node, end.lower())
    return root


def _implied_end(node: Node, name: str) -> Node:
    if name in BLOCK:
        seen: Node | None = node
        while seen is not None and (seen.name == "p" or seen.name not in BLOCK):
            if seen.name == "p":
                node = seen.parent
                break
            seen = seen.parent
    if name in CLOSES:
        seen = node
        while seen is not None and seen.name not in HOLDS:
            if seen.name in CLOSES[name]:
                node = seen.parent
            seen = seen.parent
    return node


def _closed(node: Node, name: str) -> Node:
    seen: Node | None = node
    while seen is not None and seen.parent is not None:
        if seen.name == name:
            return seen.parent
        if name not in BLOCK and seen.name in BLOCK:
            return node  # a stray end inside another block
        seen = seen.parent
    return node


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def _words(node: Node) -> int:
    return sum(len(p.split()) for n in _in_order(node) for p in n.parts if isinstance(p, str))


def _pruned(root: Node) -> None:
    """Takes away what is not article; an element around an article stays, and so do the headings and longer paragraphs in an article's own header. A name alone takes away no
    element that holds MOST_TEXT of the page's text outside links."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        if node.name != "a" and node.drop != "kind":
            node.plain = sum(len("".join(p.split())) if isinstance(p, str) else p.plain for p in node.parts)
    for node in nodes:
        if node.drop == "name" and node.plain and node.plain >= MOST_TEXT * root.plain:
            node.drop = ""
    holds = {id(n): False for n in nodes}
    for node in reversed(nodes):
        if node.parent is not None and (holds[id(node)] or (node.name in ("article", "main") and not node.drop)):
            holds[id(node.parent)] = True
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        keep = []
        inside = inside or node.name in ("article", "main")
        for part in node.parts:
            if isinstance(part, str):
                keep.append(part)
            elif not part.drop or (holds[id(part)] and part.name not in ("nav", "footer", "aside")):
                keep.append(part)
                todo.append((part, inside))
            elif inside and part.name in ("header", "div"):
                keep += [n for n in _in_order(part) if (n.name in HEADINGS and n.parent.name not in HEADINGS) or (n.name == "p" and _words(n) >= LEDE_WORDS)]
        node.parts = keep
        node.children = [p for p in keep if not isinstance(p, str)]
        for child in node.children:
            child.parent = node


def _measured(root: Node) -> list[Node]:
    nodes = _in_order(root)
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in node.children)
        node.tags = sum(c.tags + 1 for c in node.children)
        node.link_chars = sum(c.link_chars for c in node.children)
        node.link_tags = sum(c.link_tags for c in node.children)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body_links = root.link_chars / max(1, root.chars)
    for node in nodes:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, body_links)
    for node in nodes:
        node.total = sum(c.density for c in node.children)
    return nodes


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Characters per tag, times the logarithm of how far characters and tags outnumber those in links, to a base that grows with links."""
    if not chars:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - link_chars)
    base = log(chars / plain * link_chars + body_links * chars + e)
    ratio = (chars / max(1, link_chars)) * (tags / max(1, link_tags))
    return chars / tags * (log(max(ratio, 1.0)) / log(base) if base > 1 else log(max(ratio, 1.0)))


def _article(root: Node) -> list[Node]:
    """The article's elements, in page order."""
    nodes = _measured(root)
    if not root.chars:
        return []
    seed = max(nodes, key=lambda n: n.total)
    if not seed.total:
        seed = root
    path, node = [], seed
    while node is not None:
        path.append(node)
        node = node.parent
    for name in ("article", "main"):
        for node in path:
            if node.name == name:
                return [node]
    least = min(n.density for n in path)
    on_path, out = set(map(id, path)), []
    body_links = root.link_chars / max(1, root.chars)
    todo: list[Node | list] = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            out += _run(node, least, body_links)
        elif node is seed:
            out.append(node)
        elif id(node) in on_path:
            todo += reversed(_in_runs(node, on_path))
        elif node.density >= least and node.link_chars * 3 < node.chars:
            out.append(node)
    return out


def _in_runs(node: Node, on_path: set[int]) -> list[Node | list]:
    """What an element holds, in page order: its blocks and its elements on the path, and lists of the texts and inline elements between them."""
    out: list[Node | list] = []
    for part in node.parts:
        if not isinstance(part, str) and (part.name in BLOCK or id(part) in on_path):
            out.append(part)
        elif out and isinstance(out[-1], list):
            out[-1].append(part)
        else:
            out.append([part])
    return out


def _run(parts: list, least: float, body_links: float) -> list[Node]:
    """Bare text and inline elements as a block of their own, if it is as dense as other blocks have to be; line breaks are white space in it, not tags."""
    block = Node("div", None)
    block.parts = parts
    held = [p for p in parts if not isinstance(p, str) and p.name != "br"]
    chars = sum(len("".join(p.split())) for p in parts if isinstance(p, str)) + sum(p.chars for p in held)
    link_chars, link_tags = sum(p.link_chars for p in held), sum(p.link_tags for p in held)
    density = composite_density(chars, sum(p.tags + 1 for p in held), link_chars, link_tags, body_links)
    return [block] if chars and density >= least and link_chars * 3 < chars else []


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            part = todo.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                line.append(part)
            elif part.name == "br":
                line.append(" ")
            elif part.name in BLOCK:
                end()
                todo.append(None)
                todo += reversed(part.parts)
            else:
                todo += reversed(part.parts)
        end()
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parsed(html)
    _pruned(root)
    return "\n".join(blocks(_article(root)))


@F.pandas_udf(StringType())
def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages without `html`, with `text` and `n_chars` (its code points); columns of these names are replaced."""
    out = pages.withColumn("text", _main_texts(F.col(html).cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
    return out.drop(html) if html != "text" else out
