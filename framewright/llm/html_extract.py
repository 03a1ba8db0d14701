"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text (what stands between two block-level tags). Runs of neighbouring blocks that have the
same place in the tree and the same traits are one node. A linear classifier gives each node a cost for being called
content and one for being called boilerplate; these are its capacities from the source and to the sink. Neighbours in page
order, and nodes that next share a parent, are joined by edges that are the stronger the nearer they are in the tree: the
larger the share of their ancestors that they have in common. The minimum cut, by Dinic's maximum flow, is the labelling
of least total cost.

Tags end at the first ">" that isn't in a quoted attribute value; quotes elsewhere, as in title=it's, open nothing. An
inline element whose class says that it is an advert, a share button or the like, or that is hidden, stands apart from the
paragraph around it, which goes on after it; other inline elements are part of their paragraph.

Character references are decoded, white space in a block becomes one space, and the content's blocks are joined by one.

Cases: a very long page is read once from its start to its end, in memory and time that grow with its length; null or empty html and pages without content give an empty text; cut-off tags, comments and raw elements at the end
of a page are dropped, what stands before is kept; pages are independent, so repeated rows get equal texts; null ids pass;
extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

# Names of HTML elements.
RAW = frozenset("script style noscript template textarea title iframe svg select option button object canvas noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("math a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset head".split())
MAIN = frozenset("article main".split())
#: In class, id and role: what marks a part as boilerplate, by whole words between - and _.
HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert overlay paywall teaser complementary contentinfo search".split())
#: Those that mark an inline element.
INLINE_HINTS = frozenset("ad ads advert adverts advertisement byline promo promoted share sharing social sponsor sponsored tags".split())
CONTENT_HINTS = frozenset("article content entry main post story body text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?", re.I)
_WORD = re.compile(r"[a-z]+")

#: The classifier: what a node's traits add to the log odds of being content.
WEIGHTS = {"bias": -0.4, "boilerplate": -6.0, "main": 3.0, "content_hint": 2.0, "hidden": -8.0, "linked": -2.5, "paragraph": 0.8, "heading": 0.3, "list": -0.4, "per_100_chars": 0.5, "most_chars": 2.5}
#: Edges: between neighbours in page order, and between nodes next in one parent.
ADJACENT, SIBLING = 0.3, 0.6


def _marks(name: str, attributes: str, hints: frozenset = HINTS) -> str:
    """What an element says of all within it: "-" boilerplate, "+" main, "c" a hint at content, "h" hidden, or nothing."""
    if name in ("html", "body"):  # their class and id speak of the whole page
        return ""
    marks = "-" if name in BOILERPLATE else "+" if name in MAIN else ""
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                marks += "h"
            elif key in ("class", "id", "role"):
                words = set(_WORD.findall(value))
                if words & hints:
                    marks += "-"
                elif words & CONTENT_HINTS:
                    marks += "c"
    return marks


class Node:
    __slots__ = ("above", "chars", "links", "path", "tag", "texts")

    def __init__(self, path: tuple, above: tuple, tag: str):
        self.path, self.above, self.tag, self.texts, self.chars, self.links = path, above, tag, [], 0, 0


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I)


#: What an opening tag closes, if it is the innermost block; all others close a paragraph.
_CLOSES = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr")}


def blocks(html: str) -> Iterator[tuple[str, int, tuple, tuple, str]]:
    """(text, characters in links, path: (element number, marks) of the marked elements from the root, the numbers of all
    block elements from the root, the innermost one's tag) of each block."""
    stack: list[tuple[str, int, str]] = []  # elements: name, number, marks; of inline ones the marked ones
    opened: Counter = Counter()  # the names in the stack
    path: tuple = ()
    number = at = links = inside = 0
    parts: list[str] = []
    end = html.rfind(">") + 1  # there are no whole tags after it
    cut = html.find("<", end)
    while 0 <= cut < len(html) - 1 and not (html[cut + 1].isalpha() or html[cut + 1] in "/!?"):
        cut = html.find("<", cut + 1)
    rest = html[end : cut if cut >= 0 else len(html)]

    def close():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        return text

    def where():
        above = [(name, n) for name, n, _ in stack if name not in INLINE]
        return path, tuple(n for _, n in above), above[-1][0] if above else ""

    while at < end:
        m = _TAG.search(html, at, end)
        piece = html[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            links += len(piece) if inside else 0
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                close_tag = _closing(name).search(html, at)
                at = close_tag.end() if close_tag else len(html)
                rest = rest if close_tag else ""
            continue
        drop, push = len(stack), None  # what happens to the stack after the block that ends here
        if name in INLINE:
            if name == "a":
                inside = 0 if m[1] else 1
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] not in INLINE:
                        break
                    if stack[k][0] == name:
                        drop = k
                        break
                if drop == len(stack):
                    continue
            else:
                marks = _marks(name, m[3], INLINE_HINTS) if m[3] else ""
                if not opened[name] and ("-" not in marks and "h" not in marks or m[3].endswith("/")):
                    continue
                push = marks.replace("c", "")  # within a marked one of its name its end must be told apart
        elif name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        elif name in VOID and name != "hr":
            continue
        elif m[1]:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    drop = k
                    break
        elif name != "hr":
            closes = _CLOSES.get(name, ("p",))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    drop = k
                elif stack[k][0] not in INLINE:
                    break
            if not m[3].endswith("/"):
                push = _marks(name, m[3])
        # A block ends here.
        if parts and (text := close()):
            yield text, links, *where()
        links = 0
        marked = bool(push) or any(marks for _, _, marks in stack[drop:])
        opened.subtract(x for x, _, _ in stack[drop:])
        del stack[drop:]
        if push is not None:
            number += 1
            stack.append((name, number, push))
            opened[name] += 1
        if marked:
            path = tuple((n, marks) for _, n, marks in stack if marks)
    if rest and at <= end:
        parts.append(rest)
        links += len(rest) if inside else 0
    if parts and (text := close()):
        yield text, links, *where()


def nodes(html: str) -> list[Node]:
    out: list[Node] = []
    for text, links, path, above, tag in blocks(html):
        linked = 2 * links > len(text)
        last = out[-1] if out else None
        if last is None or (last.path, last.above[:-1], last.tag) != (path, above[:-1], tag) or (2 * last.links > last.chars) != linked:
            last = Node(path, above, tag)
            out.append(last)
        last.texts.append(text)
        last.chars += len(text)
        last.links += min(links, len(text))
    return out


def log_odds(node: Node) -> float:
    w = WEIGHTS
    marks = "".join(m for _, m in node.path)
    score = w["bias"] + min(w["most_chars"], w["per_100_chars"] * node.chars / 100)
    inner = [m for _, m in node.path]
    # The innermost mark counts most: a header of an article is its own, an advert in it is not.
    score += w["boilerplate"] * ("-" in marks) + w["main"] * ("+" in marks) + w["content_hint"] * ("c" in marks) + w["hidden"] * ("h" in marks)
    if "+" in marks and inner and "-" not in "".join(inner[next(i for i, m in enumerate(inner) if "+" in m) :]):
        score -= w["boilerplate"] * ("-" in marks) * 0.5  # a page-wide wrapper's name matters less than the article in it
    score += w["linked"] * (2 * node.links > node.chars) + w["paragraph"] * (node.tag in ("p", "blockquote", "pre")) + w["heading"] * (node.tag[:1] == "h" and node.tag[1:].isdigit()) + w["list"] * (node.tag == "li")
    return score


def edges(page: list[Node]) -> Iterator[tuple[int, int, float]]:
    last: dict[tuple, int] = {}
    for i, node in enumerate(page):
        if i:
            yield i - 1, i, ADJACENT * _near(page[i - 1], node)
        parent = node.above[:-1]
        j = last.get(parent)
        if j is not None and j < i:
            yield j, i, SIBLING * _near(page[j], node)
        last[parent] = i


def _near(x: Node, y: Node) -> float:
    """The share of their ancestors and marks that two nodes have in common; 1 for neighbours in one unmarked parent."""
    a, b = x.above[:-1], y.above[:-1]
    same = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    one, two = set(x.path), set(y.path)
    return (1 + same) / (1 + max(len(a), len(b))) * (1 + len(one & two)) / (1 + len(one | two))


def minimum_cut(gain: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side; node i has capacity gain[i] from the source, or -gain[i] to the sink."""
    n = len(gain)
    source, sink = n, n + 1
    head: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(head))
        head.append(b)
        room.append(there)
        out[b].append(len(head))
        head.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            add(source, i, g, 0.0)
        elif g < 0:
            add(i, sink, -g, 0.0)
    for a, b, weight in joined:
        add(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        trail: list[int] = []
        while True:
            a = head[trail[-1]] if trail else source
            if a == sink:
                push = min(room[e] for e in trail)
                for e in trail:
                    room[e] -= push
                    room[e ^ 1] += push
                trail = trail[: next(i for i, e in enumerate(trail) if room[e] <= 1e-12)]
                continue
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if room[e] > 1e-12 and level[head[e]] == level[a] + 1:
                    trail.append(e)
                    break
                following[a] += 1
            else:
                if not trail:
                    break
                following[head[trail.pop() ^ 1]] += 1


def main_text(html: str) -> str:
    page = nodes(html)
    if not page:
        return ""
    keep = minimum_cut([log_odds(x) for x in page], list(edges(page)))
    return " ".join(text for node, kept in zip(page, keep) if kept for text in node.texts)


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and text (the main text; empty if none) and n_chars, in one pass without a shuffle."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html):
            texts = [main_text(x or "") for x in part.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return df.select(*keep, html).mapInArrow(run, schema)
