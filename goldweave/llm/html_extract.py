"""Main text of a web page by scoring its tree.

Paragraphs pass points for their length and commas to their ancestors, less
with distance; an ancestor's points are discounted by the share of its text
that lies in links.  The best container is kept with those siblings that score
alike, without the parts that are navigation, notices or comments by their
element or role.  A class or id is evidence only: what it names is left out
unless it holds most of the page's text, an article, or the best container,
and if hardly any text is left the names do not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import bound_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?=/?[a-zA-Z])[^>]*>?|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMES = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
#: Searched in the page itself: lower-casing can change the length of a text.
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body html article section div main td th menu".split())
_DROPPED = frozenset("nav footer aside form script style noscript template button select option textarea iframe svg math canvas object dialog head title menu input label video audio".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
#: Words of a class or id that name parts other than the article.
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar sidenav aside menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer foot masthead topbar cookie cookies consent gdpr notice notices alert banner popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar search comment comments "
    "commentlist feedback reply replies respond disqus discussion".split()
)
_WHOLE = frozenset({"html", "body", "main"})
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dd dt figcaption".split())


#: A named part goes if this share of it is links, or if it holds less than this share of the page's text.
LINKED, SHARE = 0.5, 0.5
#: Ancestors further away than this share of a paragraph's points get none.
NEAR = 1e-6
#: Names do not count if less than this share of the text is left.
LITTLE = 0.2


class Node:
    __slots__ = ("tag", "parent", "inside", "dropped", "named", "head", "score", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.inside: list = []
        self.named = 0
        #: The head of a main part that is in no article: it stays only for a heading, and not with a menu's links.
        self.head = False
        self.score, self.length, self.linked = 0.0, 0, 0


def _unwanted(tag: str, raw: str, in_article: bool) -> tuple[bool, int]:
    """Whether the element is no text by its kind, and how far its class or id says so: 1 in a part of a name, 2 as a whole name."""
    if tag in _DROPPED:
        return True, 0
    if tag == "header" and not in_article:
        # The head of an article holds its title; that of a page does not.
        return True, 0
    if not raw or raw.isspace():
        return False, 0
    attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(raw)}
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True, 0
    if attributes.get("role") in _ROLES:
        return True, 0
    if tag in _WHOLE:
        return False, 0
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if _PARTS.isdisjoint(_NAMES.split(named)):
        return False, 0
    return False, 1 if _PARTS.isdisjoint(named.split()) else 2


class _Open:
    """The open elements; by name too, so that an end that matches none costs no walk, however deep the page is."""

    def __init__(self, root: Node) -> None:
        self.node, self.names = root, Counter()

    def enter(self, child: Node) -> None:
        self.node = child
        self.names[child.tag] += 1

    def leave_to(self, parent: Node) -> None:
        while self.node is not parent:
            self.names[self.node.tag] -= 1
            self.node = self.node.parent

    def has(self, tags: Iterable[str]) -> bool:
        return any(self.names[t] > 0 for t in tags)

    def end(self, tag: str) -> None:
        """Close the innermost ``tag``; ends of inline elements and paragraphs don't leave a table's cell."""
        if self.names[tag] <= 0:
            return
        up = self.node
        while up is not None and up.tag != tag:
            up = None if up.tag in ("td", "th", "table") and tag in ("p", "li", "b", "i", "a", "span") else up.parent
        if up is not None and up.parent is not None:
            self.leave_to(up.parent)

    def imply(self, tag: str) -> None:
        """Close what a start of ``tag`` ends without saying so."""
        if tag in _BLOCK and self.names["p"] > 0:
            up = self.node
            while up is not None and up.tag not in _BLOCK:
                up = up.parent
            if up is not None and up.tag == "p":
                self.leave_to(up.parent)
        if tag in _CLOSES and self.has(_CLOSES[tag]):
            up = self.node
            while up is not None and up.tag not in _SCOPES:
                if up.tag in _CLOSES[tag]:
                    self.leave_to(up.parent)
                    break
                up = up.parent


def parse(html: str) -> Node:
    """The tree; ends that are missing are implied, and an unfinished tag at the end of the page is markup.

    References are decoded in each text between tags, never across a tag.
    """
    root, at = Node("html", None, False), 0
    held = _Open(root)
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                held.node.inside.append(unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            held.end(tag)
            continue
        if tag == "br":
            held.node.inside.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            if tag == "hr":
                held.node.inside.append(Node("hr", held.node, False))
            elif tag == "img":
                held.node.inside.append(" ")
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(html, at)
            at = len(html) if end is None else end.start()
            close = html.find(">", at)
            at = len(html) if close < 0 else close + 1
            continue
        held.imply(tag)
        node = held.node
        unwanted, named = _unwanted(tag, m[3], held.has(("article", "main")))
        child = Node(tag, node, node.dropped or unwanted)
        child.named, child.head = named, tag == "header" and not held.has(("article",))
        node.inside.append(child)
        held.enter(child)
    return root


def _measure(root: Node) -> list[tuple[Node, int, int]]:
    """Length and linked length of each node's kept text, and its paragraphs with their lengths and commas."""
    paragraphs: list[tuple[Node, int, int]] = []
    stack = [(root, False, False)]
    while stack:
        node, linked, done = stack.pop()
        if node.dropped:
            continue
        if not done:
            stack.append((node, linked, True))
            stack.extend((x, linked or node.tag == "a", False) for x in node.inside if isinstance(x, Node))
            continue
        own = commas = 0
        for x in node.inside:
            if isinstance(x, str):
                size = len(x) - x.count(" ") // 2 if not x.isspace() else 0
                own += size
                commas += x.count(",")
                node.linked += size if linked or node.tag == "a" else 0
                node.length += size
            elif not x.dropped:
                node.length += x.length
                node.linked += x.linked
                if x.tag not in _BLOCK:
                    own += x.length
        if own and (node.tag in _PARAGRAPHS or node.tag in _BLOCK):
            paragraphs.append((node, own, commas))
    return paragraphs


def _best(root: Node) -> Node:
    paragraphs = _measure(root)
    seen: dict[int, Node] = {}
    for node, own, commas in paragraphs:
        points = 1.0 + commas + min(own / 100.0, 3.0) + own / 1000.0
        up, share = (node.parent if node.tag in _PARAGRAPHS and node.parent is not None else node), 1.0
        while up is not None and share > NEAR:
            up.score += points * share
            seen[id(up)] = up
            up, share = up.parent, share / 2.0
    top, high = root, 0.0
    for node in seen.values():
        value = node.score * (1.0 - node.linked / max(node.length, 1)) * (1.5 if node.tag in ("article", "main") else 1.0)
        if value > high or value == high and node.parent is not None and top is root:
            top, high = node, value
    # Points spread over sections of one article meet in it: the nearest article around the best container, else the nearest main part.
    around = [top]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    for tag in ("article", "main"):
        for up in around:
            if up.tag == tag and not up.dropped:
                return up
    return top


def _kept(top: Node) -> list[Node]:
    """The best container and those siblings that look like parts of the same text."""
    if top.parent is None:
        return [top]
    need = max(3.0, 0.2 * top.score)
    out: list[Node] = []
    heading: list[Node] = []
    for x in top.parent.inside:
        if not isinstance(x, Node):
            heading = [] if x.strip() else heading
            continue
        if x.dropped:
            continue
        if x is top:
            # A heading just before the container is the text's own.
            out += [] if top.tag in _WHOLE or top.tag == "article" else heading
        density = x.linked / max(x.length, 1)
        alike = x.score * (1 - density) >= need and x.tag == top.tag or x.tag == "p" and x.length > 80 and density < 0.25
        if x is top or alike and top.tag not in ("html", "body"):
            out.append(x)
            heading = []
        elif x.tag in _HEADINGS and density < LINKED:
            heading.append(x)
        elif x.length:
            heading = []
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif not x.dropped:
            if x.tag in _BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(x.inside))
    close()
    return out


def main_text(html: str | None) -> str:
    """Blocks of the article joined by line feeds; empty if there are none."""
    if not html:
        return ""
    root = parse(html)
    top = _best(root)
    _drop_heads(root)
    named, holders, told = _named(root)
    if not named:
        return "\n".join(_blocks(_kept(top)))
    size = root.length
    path = set()
    if not told and top.tag == "article" and not top.named:
        # No article stands outside named parts, so the best one protects what holds it.
        up = top.parent
        while up is not None:
            holders.add(id(up))
            up = up.parent
    while top is not None:
        path.add(id(top))
        if top.named < 2:
            holders.add(id(top))
        top = top.parent
    gone = [x for x in named if id(x) not in holders and (x.named == 2 or x.linked >= LINKED * x.length or x.length < SHARE * size)]
    for x in gone:
        x.dropped = True
    text = _text_again(root)
    # Those that hold the best container come back first, then all.
    for back in ([x for x in gone if id(x) in path], gone):
        if back and len(text) < LITTLE * size and not (told and text):
            for x in back:
                x.dropped = False
            text = _text_again(root)
    return text


def _named(root: Node) -> tuple[list[Node], set[int], bool]:
    """Kept nodes whose class or id names another part, the ids of nodes that hold an article or main part, and whether there is such an article.

    An article counts if no name speaks against it and it lies in no other
    article and in no part that is named as a whole: those are comments.
    """
    named: list[Node] = []
    holders: set[int] = set()
    told = False
    stack = [(root, False)]
    while stack:
        node, within = stack.pop()
        if node.dropped:
            continue
        if node.named:
            named.append(node)
        if node.tag == "main" or node.tag == "article" and not node.named and not within:
            told = told or node.tag == "article"
            up = node.parent
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
        within = within or node.tag == "article" or node.named == 2
        stack.extend((x, within) for x in node.inside if isinstance(x, Node))
    return named, holders, told


def _drop_heads(root: Node) -> None:
    """Heads of main parts outside articles go, unless they hold a heading and few links."""
    stack, heads = [(root, None)], []
    while stack:
        node, head = stack.pop()
        if node.head and not node.dropped:
            head = [node, False]
            heads.append(head)
        if head and node.tag in _HEADINGS:
            head[1] = True
        stack.extend((x, head) for x in node.inside if isinstance(x, Node))
    for node, heading in heads:
        node.dropped = not heading or node.linked >= LINKED * node.length


def _text_again(root: Node) -> str:
    """The text by scores that are made anew."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.score, node.length, node.linked = 0.0, 0, 0
        stack.extend(x for x in node.inside if isinstance(x, Node))
    return "\n".join(_blocks(_kept(_best(root))))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    A null or empty page has an empty text.  Ids and urls pass as they are,
    null or repeated; further columns are not read.  Pages of any length are
    taken whole.  No rows give no rows.
    """
    bound_batches(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"]
            )

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html")).mapInArrow(extract, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
