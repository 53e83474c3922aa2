"""Main text of web pages by tree scoring: paragraphs pass points to their ancestors, the best container and its siblings are kept."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Names of HTML elements, by how a page's text treats them, and words that name what is not an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("script style head title noscript template iframe object svg math canvas nav footer aside menu button select option textarea input label dialog audio video map noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split()
)
CLOSES_P = BLOCK - frozenset("html body tr tbody thead tfoot caption".split())
#: Opening one of these ends an open one of the set, up to a container of the kind.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",))}
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "header comment comments comentarios kommentare commentaires disqus discussion replies reply respond responses cookie cookies consent gdpr notice notices notification notifications alert newsletter subscribe subscription signup login paywall popup modal overlay "
    "share sharing social related recommended recommendations trending popular pagination pager tags tagcloud outbrain taboola skip hidden".split()
)
#: Those of them that name other people's texts: they may be longer than the article.
OTHERS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted comment comments comentarios kommentare commentaires disqus discussion replies reply respond responses outbrain taboola".split())
#: Elements of controls: they go unless they hold most of the unlinked text, as a form around a whole page does.
CONTROLS = frozenset("form fieldset".split())
#: How class names and ids of readers' comments begin, and how those of a kind of article do.
COMMENTS, COMMENTARY = ("comment", "kommentar", "comentario", "commentaire", "disqus"), ("commentary", "commentator")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
LIKELY = frozenset("article articlebody body content entry main maincontent page post story text blog".split())

_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_simple = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*)[\t\n\f\r ]*>")
_tag_name = re.compile(r"[^\t\n\f\r />]*")
_gap = re.compile(r"[\t\n\f\r /]*")
_space = re.compile(r"[\t\n\f\r ]*")
_attr_name = re.compile(r"=?[^\t\n\f\r />=]*")
_unquoted = re.compile(r"[^\t\n\f\r >]*")
_comment_end = re.compile(r"--!?>")
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Node:
    """An element with its children in order: nodes, texts and None for a line break. What depends on all ancestors is set when it opens."""

    __slots__ = ("name", "children", "parent", "likely", "unlikely", "others", "dropped", "score", "inside", "apart", "block", "size", "linked", "free", "kept")

    def __init__(self, name: str, parent: Node | None, attrs: dict[str, str] | None = None) -> None:
        self.name, self.parent, self.children = name, parent, []
        self.score: float | None = None
        self.likely, self.dropped = 0, name in DROPPED
        #: Whether class or id name what is no article, or other people's texts; _settle() decides by text, too, whether it is dropped.
        self.unlikely, self.others = name in CONTROLS, False
        for key, value in attrs.items() if attrs else ():
            if key == "role":
                self.dropped |= value.strip().lower() in ROLES
            elif key in ("hidden", "aria-hidden"):
                self.dropped |= key == "hidden" or value.lower() == "true"
            elif key == "style":
                self.dropped |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key in ("class", "id"):
                found = set()
                for token in value.split():
                    words = [w.lower() for w in _words.findall(token)]
                    found.update(words)
                    lower = token.lower()
                    if name not in ("html", "body", "article", "main"):
                        self.unlikely |= not UNLIKELY.isdisjoint(words)
                        self.others |= bool(words) and words[0] in OTHERS or lower.startswith(COMMENTS) and not lower.startswith(COMMENTARY)
                self.likely += not LIKELY.isdisjoint(found)
        if name in CONTROLS:
            self.likely = 0
        #: In an article, in no element of an unlikely name, and the innermost block around it.
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        self.apart = not self.others and (not self.unlikely or self.likely > 0) and (parent is None or parent.apart)
        self.block: Node = self if parent is None or name in BLOCK else parent.block
        #: Characters under it, those in links, those outside of links, and whether it is in what is kept; see _measure().
        self.size = self.linked = self.free = 0
        self.kept = False


def tags(page: str) -> Iterator[tuple[int, int, bool, str | None, dict[str, str] | None]]:
    """(start, end, closing, name, attributes) of each tag, name null for comments and the like; send() a place to go on from there.

    One pass by the states of the HTML standard: an empty comment ends at once, quotes count only where a value begins,
    a tag or comment that the page's end cuts off reaches to it. Beyond the standard, a quoted value that nothing closes ends
    with its tag. Every character is looked at a bounded number of times.
    """
    at, n = 0, len(page)
    unclosed: set[str] = set()  # quotes that don't occur any more
    while (i := page.find("<", at)) >= 0:
        if m := _simple.match(page, i):
            at = m.end()
            at = (yield i, at, bool(m[1]), m[2].lower(), None) or at
            continue
        second = page[i + 1 : i + 2]
        closing = second == "/"
        first = page[i + 2 : i + 3] if closing else second
        if not ("a" <= first <= "z" or "A" <= first <= "Z"):
            if second == "!" and page.startswith("<!--", i):
                j = i + 4
                m = _comment_end.search(page, j)
                at = j + 1 if page.startswith(">", j) else j + 2 if page.startswith("->", j) else m.end() if m else n
            elif second in ("!", "?") or (closing and first):
                end = page.find(">", i)
                at = n if end < 0 else end + 1
            else:
                at = i + 1  # a plain character
                continue
            yield i, at, False, None, None
            continue
        m = _tag_name.match(page, i + 1 + closing)
        name, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        while True:
            at = _gap.match(page, at).end()
            if at >= n or page[at] == ">":
                break
            m = _attr_name.match(page, at)
            key, at, value = m[0].lower(), m.end(), ""
            then = _space.match(page, at).end()
            if page.startswith("=", then):
                at = _space.match(page, then + 1).end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = -1 if quote in unclosed else page.find(quote, at + 1)
                    if end < 0:
                        unclosed.add(quote)
                        end = page.find(">", at)
                        value, at = (page[at + 1 : end], end) if end >= 0 else ("", n)
                    else:
                        value, at = page[at + 1 : end], end + 1
                else:
                    m = _unquoted.match(page, at)
                    value, at = m[0], m.end()
            attrs.setdefault(key, value)
        if at >= n:
            yield i, n, False, None, None  # cut off: no tag
            return
        at += 1
        at = (yield i, at, closing, name, attrs) or at


def parse(page: str) -> list[Node]:
    """The elements of the whole page, parents before children, the root first; end tags that nothing opened are skipped, and what is left open ends with the page.

    The open elements' depths are kept by name, so that no tag climbs its ancestors: linear in the page at any nesting.
    """
    root = node = Node("#root", None)
    nodes, path = [root], [root]
    depths: dict[str, list[int]] = {}
    walls: list[int] = []  # depths of the open blocks and table cells: the innermost one tells whether a p is open

    def close(depth: int) -> None:
        nonlocal node
        while len(path) > depth:
            gone = path.pop()
            depths[gone.name].pop()
            if gone.name in BLOCK or gone.name in ("td", "th"):
                walls.pop()
        node = path[-1]

    at, found = 0, tags(page)
    tag = next(found, None)
    while tag:
        start, end, closing, name, attrs = tag
        if start > at:
            node.children.append(page[at:start])
        at, jump = end, None
        if name is None:
            pass
        elif closing:
            if depths.get(name):
                close(depths[name][-1])
            elif name in BLOCK:
                nodes.append(Node("p", node))  # a stray end tag still ends the paragraph
                node.children.append(nodes[-1])
        else:
            if name in CLOSES_P and walls and path[walls[-1]].name == "p":
                close(walls[-1])
            if name in IMPLIED:
                ends, stop = IMPLIED[name]
                floor = max((depths[x][-1] for x in stop if depths.get(x)), default=0)
                open_ = [d[i] for d in map(depths.get, ends) if d and (i := bisect_right(d, floor)) < len(d)]
                if open_:
                    close(min(open_))
            if name == "br":
                node.children.append(None)
            else:
                child = Node(name, node, attrs)
                nodes.append(child)
                node.children.append(child)
                if name in RAW:
                    m = _raw_end[name].search(page, at)
                    at = jump = len(page) if m is None else m.start()
                elif name not in VOID:
                    depths.setdefault(name, []).append(len(path))
                    if name in BLOCK or name in ("td", "th"):
                        walls.append(len(path))
                    path.append(child)
                    node = child
        try:
            tag = found.send(jump)
        except StopIteration:
            break
    if at < len(page):
        node.children.append(page[at:])
    return nodes


def _measure(nodes: list[Node], blocks: list[tuple[str, Node, int]]) -> None:
    """Sets what text, links and unlinked text the blocks put under each element, from the leaves up."""
    for x in nodes:
        x.size = x.linked = x.free = 0
    for text, node, linked in blocks:
        node.size += len(text)
        node.linked += linked
        node.free += len(text) - min(linked, len(text))
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.linked += x.linked
            x.parent.free += x.free


def _blocks(top: Node, out: list[tuple[str, Node, int]]) -> None:
    """Appends (text, innermost block, characters in links) of each block under top, in page order, without dropped parts."""
    parts: list[str] = []
    holder, linked = top, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, holder, linked))
            parts.clear()
        linked = 0

    # an explicit stack: pages may nest deeper than Python recurses
    stack: list[tuple[Node, int, bool]] = [(top, 0, False)]
    while stack:
        node, i, link = stack.pop()
        if i >= len(node.children):
            if node.name in BLOCK:
                flush()
                holder = node.parent or node
            continue
        stack.append((node, i + 1, link))
        x = node.children[i]
        if x is None:
            parts.append(" ")
        elif isinstance(x, str):
            if not parts:
                holder = node
            parts.append(x)
            if link:
                linked += len(x.strip())
        else:
            if x.dropped:
                if x.name in BLOCK:
                    flush()
                continue
            if x.name == "header" and not x.inside:
                flush()
                continue
            if x.name in BLOCK:
                flush()
                holder = x
            elif x.name in ("td", "th"):
                parts.append(" ")
            stack.append((x, 0, link or x.name == "a"))
    flush()


def _settle(nodes: list[Node], blocks: list[tuple[str, Node, int]]) -> bool:
    """Drops elements of an unlikely name, but those of a likely name too and those that hold most of the unlinked text. Whether any was dropped.

    What names other people's texts no likely word spares, and its text only if no other text stands outside unlikely elements.
    """
    _measure(nodes, blocks)
    total = nodes[0].free
    outside = any(node.apart and 2 * linked < len(text) and (node.name not in HEADINGS or node.inside) for text, node, linked in blocks)
    some, stack = False, [nodes[0]]
    while stack:
        node = stack.pop()
        if (node.unlikely or node.others) and not node.dropped:
            most = 2 * node.free > total and not (outside and node.others)
            node.dropped = not (most or (node.likely and not node.others))
            some |= node.dropped
            node.likely = 0
        if not node.dropped:
            stack += [x for x in node.children if isinstance(x, Node)]
    return some


def main_text(page: str) -> str:
    """The main text of one page: blocks joined by blank lines; empty if there is none."""
    if not page:
        return ""
    nodes = parse(page)
    blocks: list[tuple[str, Node, int]] = []
    _blocks(nodes[0], blocks)
    if _settle(nodes, blocks):
        blocks = []
        _blocks(nodes[0], blocks)
    if not blocks:
        return ""
    _measure(nodes, blocks)
    scored: list[Node] = []
    for text, node, linked in blocks:
        node = node.block
        if len(text) < 25 or node.name in HEADINGS:
            continue
        points = (1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)) * (1 - min(1, linked / len(text)))
        up = node if node.name not in PARAGRAPHS else node.parent
        level = 0
        while up is not None and up.name not in ("html", "#root") and level < 5:
            if up.score is None:
                up.score = {"article": 25.0, "main": 20.0, "body": -5.0, "ul": -3.0, "ol": -3.0}.get(up.name, 0.0) + 10 * min(up.likely, 2)
                scored.append(up)
            up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    if not scored:
        inside = [t for t, n, _ in blocks if n.inside]
        return "\n\n".join(inside or [t for t, n, k in blocks if 2 * k < len(t)])

    def final(x: Node) -> float:
        return 0 if x.score is None else x.score * (1 - min(1, x.linked / max(1, x.size)))

    best = max(scored, key=final)
    up = best.parent
    while up is not None:  # the article around the best part holds its headings too
        if up.name in ("article", "main"):
            best = up
            break
        up = up.parent
    best.kept = True
    if best.parent is not None:
        # what isn't dropped by now and isn't a list of links belongs to the article
        for x in best.parent.children:
            if isinstance(x, Node) and x is not best and not x.dropped:
                x.kept = x.size > 0 and 2 * x.linked < x.size
    for x in nodes:
        x.kept |= x.parent is not None and x.parent.kept
    return "\n\n".join(text for text, node, _ in blocks if node.kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html); the whole page is read.

    Null or empty html, or a page without main text: empty text and 0. Rows stay as they are, repeats included; null
    ids and urls pass through; an empty table gives no rows; other columns are left out.
    """

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h or "") for h in b.column("html").to_pylist()]
            return pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return f

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(p, make, "page_id long, url string, text string, n_chars long")
