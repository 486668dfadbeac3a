"""Operator 7, main text of HTML pages by minimum-cut labelling.

A page is read as a sequence of text blocks. A small classifier gives each
block a cost for being called content or boilerplate; these are the
capacities to the two terminals. Neighbours in page order and blocks under
the same parent are tied by smoothness edges. The minimum cut is the
labelling of least total cost, and its source side is the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_slices, schema_with

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style textarea title xmp noembed noframes iframe noscript template svg math canvas object audio video select button datalist".split())
#: An open element on the left ends when an element on the right starts; the search stops at those after the bar.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMES = re.compile(r"[a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Costs in hundredths, by hand: positive speaks for content.
ELEMENT = {"nav": -1200, "footer": -1200, "aside": -1200, "menu": -1200, "dialog": -1200, "form": -900, "header": -700, "search": -1200, "fieldset": -500, "details": -100, "address": -200, "figcaption": -50}
HOME = {"article": 400, "main": 300}
ROLE = {"navigation": -1200, "banner": -900, "contentinfo": -1200, "complementary": -1200, "search": -1200, "dialog": -1200, "alertdialog": -1200, "alert": -900, "menu": -1200, "menubar": -1200, "form": -900, "main": 300, "article": 300}
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus discussion feedback footer footnav gdpr "
    "legal links login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup privacy promo promos promotion promotions reader readers related replies reply respond "
    "rss search share sharing sidebar signin signup sitemap skip social sponsor sponsored sponsors subscribe subscription taboola tags teaser toolbar topbar widget widgets warning alert announcement".split()
)
BAD_STARTS = ("advert", "sponsor", "cookie", "comment", "navig", "navbar", "sidebar", "breadcrumb", "newsletter", "popup")
LAYOUT = re.compile(r"(?:with|without|has|no|hide|show)[-_ ][\w-]+")  # says what stands beside, not what this is
GOOD_NAMES = frozenset("article content entry story post text body main".split())
OPENERS = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved|share (?:this|on)\b|related (?:articles|posts)\b|read more\b|advertisement\b|we use cookies|sign up\b|subscribe\b|leave a (?:reply|comment)\b)", re.IGNORECASE)
ADJACENT, SIBLING = 60, 30
#: Shares of a page's prose from which what stands below an element is the page's own text: with its first heading, and without any on the page.
OWN_SHARE, ALL_SHARE = 0.3, 0.8


@dataclass
class Element:
    tag: str
    cost: int  # what speaks for content, inherited by all blocks below
    hidden: bool
    home: bool
    number: int
    blame: int = 0  # what speaks against it by its own element, role and names
    first: int = 0  # of the blocks below


@dataclass
class Block:
    text: str
    cost: int
    parent: int
    linked: int = 0
    tag: str = ""


class Stack:
    """Open elements, with the places of each tag and of the blocks, so that no search walks the depth of a page."""

    def __init__(self):
        self.items = [Element("", 0, False, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def __len__(self) -> int:
        return len(self.items)

    @property
    def top(self) -> Element:
        return self.items[-1]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.items))
        if e.tag in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append(e)

    def pop(self) -> Element:
        e = self.items.pop()
        self.places[e.tag].pop()
        if e.tag in BLOCK:
            self.blocks.pop()
        return e

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, tags, above: int) -> int:
        """Place of the first open element of these tags above a place, 0 for none."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, above)) < len(p)]
        return min(found, default=0)

    def block(self, back: int = 0) -> Element:
        """The innermost block element, or the one ``back`` blocks around it; the outermost if there are fewer."""
        return self.items[self.blocks[-1 - back]] if len(self.blocks) > back else self.items[self.blocks[0]] if self.blocks else self.items[0]


@dataclass
class Reader:
    """Splits a page into blocks; unclosed and stray tags are read as browsers do, as far as the blocks go."""

    blocks: list[Block] = field(default_factory=list)
    blamed: list[tuple[int, int, int]] = field(default_factory=list)  # blocks from and to, and what speaks against them

    def read(self, page: str) -> list[Block]:
        stack = Stack()
        parts: list[str] = []
        linked, count, at, end = 0, 0, 0, len(page)

        def flush():
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    inner = stack.block()
                    self.blocks.append(Block(text, inner.cost, stack.block(1).number, min(linked, len(text)), inner.tag))
            parts.clear()
            linked = 0

        def take(text):
            nonlocal linked
            if text and not stack.top.hidden:
                parts.append(text)
                if any(e.tag == "a" for e in stack.items[-3:]):
                    linked += len(text.strip())

        def close_to(i):
            """Ends all elements from place i on."""
            if stack.blocks and stack.blocks[-1] >= i:
                flush()
            while len(stack) > i:
                e = stack.pop()
                if e.blame:
                    self.blamed.append((e.first, len(self.blocks), e.blame))

        while at < end:
            low = page.find("<", at)
            if low < 0:
                take(page[at:])
                break
            take(page[at:low])
            m = TOKEN.match(page, low)
            if not m:
                take("<")
                at = low + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            if not m[4]:
                break  # the page ends inside a tag
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    take(" ")
                if i := stack.last((tag,)):
                    close_to(i)
                elif tag in BLOCK:
                    flush()
                continue
            if tag == "br":
                take("\n")
                continue
            if tag in BLOCK:
                flush()
                if stack.block().tag == "p":
                    close_to(stack.blocks[-1])
                if tag in ENDS:
                    closes, stops = ENDS[tag]
                    if i := stack.outermost(closes, stack.last(stops)):
                        close_to(i)
                elif tag in HEADINGS and stack.top.tag in HEADINGS:
                    close_to(len(stack) - 1)
                elif tag == "body" and (i := stack.last(("head",))):
                    close_to(i)
            if tag in VOID:
                if tag in ("img", "input", "wbr", "embed"):
                    take("" if tag == "wbr" else " ")
                continue
            count += 1
            e = self.element(tag, m[3], stack.top, count)
            if e.blame and tag not in BLOCK:
                flush()
            e.first = len(self.blocks)
            stack.push(e)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = close.start() if close else end
        flush()
        close_to(1)
        self.spread_blame()
        return self.blocks

    def spread_blame(self) -> None:
        """Lays each element's blame on the blocks below, except where these are the page's own text.

        Templates name wrappers after what stands beside the article, so names
        and elements do not count against what holds a first heading and a
        good part of the page's prose, or almost all of it.
        """
        n = len(self.blocks)
        prose, heads, change = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i, b in enumerate(self.blocks):
            long = len(b.text) if 2 * b.linked < len(b.text) and b.tag not in ("li", "dt", "dd") else 0
            prose[i + 1] = prose[i] + long
            heads[i + 1] = heads[i] + (b.tag == "h1")
        for low, high, blame in self.blamed:
            own = prose[high] - prose[low]
            if own and (heads[high] > heads[low] and own >= OWN_SHARE * prose[n] or own >= ALL_SHARE * prose[n] and not heads[n]):
                continue
            change[low] += blame
            change[high] -= blame
        total = 0
        for i, b in enumerate(self.blocks):
            total += change[i]
            b.cost += total

    @staticmethod
    def element(tag: str, attributes: str, above: Element, number: int) -> Element:
        cost, hidden, home, blame = above.cost, above.hidden or tag in HIDDEN, above.home, 0
        if tag in HOME and not home:
            cost += HOME[tag]
            home = True
        elif tag in ELEMENT:
            blame += ELEMENT[tag] // 2 if tag == "header" and home else ELEMENT[tag]
        if attributes and len(attributes) > 1:
            names: list[list[str]] = []
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id"):
                    names += [x for v in LAYOUT.sub("", value).split() if (x := NAMES.findall(v))]
                elif name == "role":
                    role = ROLE.get(value.strip(), 0)
                    cost, blame = cost + max(role, 0), blame + min(role, 0)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
            if names and tag not in ("html", "body"):
                every = {x for v in names for x in v}
                bad = [v for v in names if BAD_NAMES.intersection(v) or any(x.startswith(BAD_STARTS) for x in v)]
                if bad and (tag not in HOME or len(bad) == len(names)):  # an article goes by names only if all of them say so
                    blame -= 1000
                elif "header" in every and not home:
                    blame -= 700
                elif every & GOOD_NAMES and tag in ("div", "section", "td") and not home:
                    cost += 200
                    home = "content" in every or home
        return Element(tag, cost, hidden, home, number, blame)


def block_cost(b: Block) -> int:
    """Hundredths for content (positive) or against it: where it stands, its element, its length, its share of links."""
    n = len(b.text)
    cost = b.cost - 60 + min(n, 300)
    cost += 100 if b.tag in ("p", "pre", "blockquote") else 60 if b.tag in HEADINGS else -50 if b.tag in ("li", "td", "th", "dd", "dt") else 0
    cost -= 400 * b.linked // n
    if n < 200 and OPENERS.match(b.text):
        cost -= 300
    return cost


def minimum_cut(costs: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut: costs are terminal capacities, edges tie i < j both ways.

    Nodes whose terminal outweighs all their edges are settled first, which
    does not change the minimum; Dinic's algorithm cuts what is left. Where
    both sides cost the same a node goes to the sink.
    """
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and (abs(costs[i]) > sum(near[i].values()) or not near[i]):
            label[i] = costs[i] > 0
            for j, c in near[i].items():
                costs[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        flow = _Flow(len(rest) + 2)
        number = {i: k + 2 for k, i in enumerate(rest)}
        for i in rest:
            if costs[i] > 0:
                flow.add(0, number[i], costs[i], 0)
            elif costs[i] < 0:
                flow.add(number[i], 1, -costs[i], 0)
            for j, c in near[i].items():
                if i < j:
                    flow.add(number[i], number[j], c, c)
        reached = flow.cut()
        for i in rest:
            label[i] = number[i] in reached
    return [bool(x) for x in label]


class _Flow:
    """Dinic's maximum flow from node 0 to node 1."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, forth: int, back: int) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self) -> dict[int, int]:
        level, queue = {0: 0}, deque([0])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 0 and self.to[e] not in level:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def cut(self) -> set[int]:
        while 1 in (level := self.levels()):
            place = [0] * len(self.out)
            path: list[int] = []
            x = 0
            while True:
                if x == 1:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, x = [], 0
                    continue
                while place[x] < len(self.out[x]):
                    e = self.out[x][place[x]]
                    if self.room[e] > 0 and level.get(self.to[e]) == level[x] + 1:
                        break
                    place[x] += 1
                if place[x] < len(self.out[x]):
                    path.append(e)
                    x = self.to[e]
                elif path:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    place[x] += 1
                else:
                    break
        return set(level)


def main_text(page: str | None) -> str:
    """The page's article: content blocks in page order, joined by an empty line; empty for a null or empty page."""
    blocks = Reader().read(page) if page else []
    if not blocks:
        return ""
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = ADJACENT if blocks[i - 1].parent == b.parent else ADJACENT // 3
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            edges[before, i] = SIBLING
        last[b.parent] = i
    keep = minimum_cut([block_cost(b) for b in blocks], edges)
    return "\n\n".join([b.text for b, k in zip(blocks, keep, strict=True) if k])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of each page with text and n_chars (code points of text).

    A null or empty page, and one without any article, gives an empty text.
    One row for each row, repeated ones and equal ids too; an empty table gives
    none. Pages of any length and depth are read whole, in time in proportion
    to their length.
    """
    schema = schema_with(pages, keep, "text string, n_chars long")

    def run(batches):
        for some, _, _ in doc_slices(batches, text="html"):
            texts = [main_text(p) for p in some.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*keep, "html"])).mapInArrow(run, schema)
