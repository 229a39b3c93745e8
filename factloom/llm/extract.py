"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags, with the open elements around
them). A linear classifier over a block's length, closing punctuation, link share, heading, paragraph
and the elements around it that speak for content or boilerplate gives the costs of calling it
either; these are the capacities to the two terminals. No feature decides alone: what names say is
added up over the elements around a block, within bounds that a paragraph's length or its
neighbours can outweigh, and a name that pages also use inside articles says less. Smoothness edges
join a block to the next one, the stronger the more elements the two have in common, and to the
next under the same parent, whichever way the two lean. The minimum cut is the labelling of least
total cost: a caption or a line of one word goes with what stands around it. Blocks whose own cost exceeds all their edges are labelled at once, which the
minimum cut would do too; only what stays undecided needs a flow, found by blocking flows.

Forms and their controls, scripts, styles, templates and embedded frames make no blocks; drawings,
formulas and hidden elements are text like any other.
Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty blocks vanish and content blocks are joined by one line break.

Defined cases: null or empty html has empty text; text outside any element is a block like any
other; unclosed elements end with their parent, but an unclosed script, style, textarea, title or
xmp takes the rest of the page, as in browsers; a ``<`` that starts no tag is text, and a quote or
tag that is never closed ends at the next ``>``; repeated rows give the same text; other columns
are ignored. Reading takes time in proportion to the page.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Forms, controls and what never shows; their text makes no blocks.
DROPPED_TAGS = frozenset("head form fieldset legend label datalist output option optgroup select button template iframe noembed noframes".split())
BOILERPLATE_TAGS = frozenset("nav footer aside header dialog menu".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer footers header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending pagination pager copyright disclaimer skip toc tags".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry post main maincontent story body text prose".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
SPACE = re.compile(r"\s+")

#: Names that pages also give to parts of an article.
MIXED_NAMES = frozenset("alert banner banners header headers notice notices promo promoted share sharing social tags toc trending related recommended rail login search menu".split())

#: The classifier: cost of content for a block, by its features.
BIAS, LENGTH, CLOSED, HEADING, PARAGRAPH, LINKS = -1.4, 0.75, 0.5, 0.5, 0.6, -3.5
#: What an element adds that speaks for content or boilerplate; a mixed name says less.
CONTENT, BOILERPLATE, MIXED = 0.9, -4.2, -2.2
#: The least and the most that elements add up to, the innermost in full and those around it by half.
BOUNDS = (-5.0, 1.4)
#: Smoothness between neighbouring blocks, from none to all elements in common, and between
#: neighbours under one parent.
NEXT, SIBLING = (0.1, 0.35), 0.6
PARAGRAPHS = frozenset("p blockquote pre dd figcaption".split())


class State(NamedTuple):
    """An open element and what holds inside it."""

    tag: str
    dropped: bool
    lean: float
    linked: bool
    heading: bool
    paragraph: bool
    content: bool  # inside an article
    own: int  # number of the innermost block-level element
    parent: int  # number of the one around it


class Block(NamedTuple):
    text: str
    parent: int
    lean: float  # what the elements around it add up to
    links: float  # share of the text inside links
    heading: bool
    paragraph: bool
    shared: float  # share of its elements that are also around the block before


def _inside(tag: str, attributes: str, outer: State, number: int) -> State:
    """The state inside a new element."""
    says: list[float] = []
    dropped = outer.dropped or tag in DROPPED_TAGS
    if tag in CONTENT_TAGS:
        says.append(CONTENT)
    elif tag in BOILERPLATE_TAGS and not (tag == "header" and outer.content):  # an article's own header holds its headline
        says.append(BOILERPLATE)
    if "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id", "itemprop"):
                whole = value.replace("-", "").replace("_", "").lower().split()
                parts = {x.lower() for x in NAME.findall(value)} | set(whole)
                named = parts & BOILERPLATE_NAMES if tag not in ("body", "html", *CONTENT_TAGS) else set()
                if named - MIXED_NAMES:
                    says.append(BOILERPLATE)
                elif named and not (outer.content and named == {"header"}):
                    says.append(MIXED)
                if parts & CONTENT_NAMES:
                    says.append(CONTENT)
            elif name == "role":
                says += [BOILERPLATE] if value.lower() in BOILERPLATE_ROLES else [CONTENT] if value.lower() in ("main", "article") else []
    lean = outer.lean
    if says:
        # one element's names count once for either side; what stands around it counts by half
        lean = min(max(min(says + [0.0]) + max(says + [0.0]) + outer.lean / 2, BOUNDS[0]), BOUNDS[1])
    block = tag in BLOCK_TAGS
    return State(tag, dropped, lean, outer.linked or tag == "a", outer.heading or tag in HEADINGS, outer.paragraph or tag in PARAGRAPHS, outer.content or tag in CONTENT_TAGS, number if block else outer.own, outer.own if block else outer.parent)


class Reader:
    """Reads the tags of a page one after another; open elements are a stack of states."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.stack = [State("", False, 0.0, False, False, False, False, 0, 0)]
        self.open: dict[str, list[int]] = defaultdict(list)  # places of each open tag in the stack
        self.out: list[Block] = []
        self.text: list[str] = []
        self.linked = self.number = self.low = 0

    def _cut(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        while len(self.stack) > k:
            self.open[self.stack.pop().tag].pop()
        self.low = min(self.low, k)

    def _close(self) -> None:
        """End the block."""
        own = SPACE.sub(" ", references.unescape("".join(self.text))).strip() if self.text else ""
        if own:
            top = self.stack[-1]
            self.out.append(Block(own, top.parent, top.lean, min(1.0, self.linked / len(own)), top.heading, top.paragraph, self.low / len(self.stack)))
            self.low = len(self.stack)
        self.text.clear()
        self.linked = 0

    def _say(self, piece: str) -> None:
        if piece and not self.stack[-1].dropped:
            self.text.append(piece)
            self.linked += len(piece) if self.stack[-1].linked else 0

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, past quoted values; there is one."""
        first = self.page.find(">", at)
        while True:
            m = STOP.search(self.page, at)
            if not m:
                return first
            if m[0] == ">":
                return m.start()
            at = m.end()
            if at <= self.last[m[0]]:  # a quote that is never closed is a sign like any other
                at = self.page.find(m[0], at) + 1

    def blocks(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            begin = page.find("<", at)
            if begin < 0 or begin >= self.last[">"]:
                self._say(page[at:])
                break
            if page.startswith("<!--", begin):
                self._say(page[at:begin])
                end = page.find("-->", begin + 4)
                if end < 0:
                    break
                at = end + 3
                continue
            if page[begin + 1] in "!?":
                self._say(page[at:begin])
                at = page.find(">", begin) + 1
                continue
            m = TAG.match(page, begin)
            if not m:
                self._say(page[at : begin + 1])
                at = begin + 1
                continue
            self._say(page[at:begin])
            end = self._tag_end(m.end())
            tag, attributes, at = m[1].lower(), page[m.end() : end], end + 1
            if page[begin + 1] == "/":
                self._end(tag)
            elif tag in RAW_TAGS:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    if not close:
                        break
                    at = page.find(">", close.end()) + 1
                    if not at:
                        break
            else:
                self._start(tag, attributes)
        self._close()
        return self.out

    def _end(self, tag: str) -> None:
        """An end tag closes its element and those left open inside."""
        k = self.open[tag][-1] if self.open.get(tag) else 0
        if not k:
            if tag in BLOCK_TAGS and not self.stack[-1].dropped:
                self._close()
            return
        if self.stack[-1].own != self.stack[k - 1].own and not self.stack[k - 1].dropped:
            self._close()
        self._cut(k)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._say(" ")
            return
        if tag in BLOCK_TAGS and not self.stack[-1].dropped:
            self._close()
            # a new paragraph ends the one before it, a new item the one before it in its list
            ends = self.open["p"][-1] if self.open["p"] else 0
            if ends and all(x.tag not in BLOCK_TAGS for x in self.stack[ends + 1 :]):
                self._cut(ends)
            if tag == "li" and self.open["li"] and self.open["li"][-1] > max((self.open[x][-1] for x in ("ul", "ol", "menu", "dir") if self.open[x]), default=0):
                self._cut(self.open["li"][-1])
        if tag not in VOID_TAGS and not attributes.rstrip().endswith("/"):
            self.number += 1
            self.open[tag].append(len(self.stack))
            self.stack.append(_inside(tag, attributes, self.stack[-1], self.number))


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; text of dropped elements makes none."""
    return Reader(page).blocks()


def costs(b: Block) -> float:
    """How strongly the classifier takes a block for content; negative for boilerplate."""
    words = b.text.count(" ") + 1
    linked = LINKS * b.links / (1 + words / 10)  # a whole sentence may be a link
    return BIAS + LENGTH * math.log1p(words) + (CLOSED if b.text[-1:] in ".!?…。！？" else 0.0) + (HEADING if b.heading else 0.0) + (PARAGRAPH if b.paragraph else 0.0) + linked + b.lean


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, and with the next under the same parent."""
    out = [(i, i + 1, NEXT[0] + (NEXT[1] - NEXT[0]) * b.shared) for i, b in enumerate(found[1:])]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node on the wrong side pays ``abs(lean)``, a parted edge its weight.

    A node whose own cost exceeds its edges to undecided nodes has its label in every minimum
    cut; its edges then become costs of its neighbours. The others are labelled by a flow.
    """
    near: list[dict[int, float]] = [{} for _ in lean]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    cost, free = list(lean), [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * len(lean)
    ready = list(range(len(lean)))
    while ready:
        i = ready.pop()
        if label[i] is None and abs(cost[i]) >= free[i] - 1e-12:
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    free[j] -= w
                    ready.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        inner = [(place[i], place[j], w) for i in left for j, w in near[i].items() if i < j and j in place]
        for i, side in zip(left, _flow([cost[i] for i in left], inner)):
            label[i] = side
    return [bool(x) for x in label]


def _flow(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether the content terminal still reaches each node after a maximum flow (blocking flows)."""
    n = len(lean)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: float, back: float) -> None:
        arcs[u].append(len(to))
        arcs[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for i, x in enumerate(lean):
        if x > 0:
            join(source, i, x, 0.0)
        elif x < 0:
            join(i, sink, -x, 0.0)
    for i, j, w in edges:
        join(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in arcs[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                much = min(room[e] for e in path)
                for e in path:
                    room[e] -= much
                    room[e ^ 1] += much
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(arcs[u]) and not (room[arcs[u][turn[u]]] > 1e-9 and level[to[arcs[u][turn[u]]]] == level[u] + 1):
                turn[u] += 1
            if turn[u] < len(arcs[u]):
                path.append(arcs[u][turn[u]])
                u = to[path[-1]]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page or "")
    labels = minimum_cut([costs(b) for b in found], edges(found))
    return "\n".join(b.text for b, keep in zip(found, labels) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in batch["html"].to_pylist()], pa.string())
            yield pa.record_batch([batch["page_id"], batch["url"], text], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
