"""HTML extraction by minimum-cut labelling (operator 6).

A page is parsed into text blocks.  A classifier over simple features of a block
gives it a cost as content and a cost as boilerplate; they are the capacities of
its edges to the two terminals.  Neighbours in page order, and blocks of the same
container in the DOM, are joined by smoothness edges.  A maximum flow cuts the
graph; the blocks on the content side are the main text.

Each page is a graph of its own, so pages are mapped one by one and nothing is
shuffled.  Weights of the classifier are fixed parameters; there are no labelled
pages to learn them from.

Marks of containers are inherited.  A mark that may stand around a whole page (a
form, a banner or modal class) ends at an article or main element; what holds
reader comments, side bars, menus or adverts ends at main alone.

Defined cases: null or empty html, and html without content blocks, give an
empty text; unclosed and truncated markup is read as far as it goes, and a head
without an end tag ends where something stands that a head can't hold; rows that
repeat are each returned; an empty table gives an empty result; other columns
are not read.  A very long or deeply nested page takes time in proportion to its
length, but for the cut, whose time grows with the flow between its blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.llm.common import slices

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"head", "script", "style", "noscript", "template", "textarea", "select", "option", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
HEAD_TAGS = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT_TAGS = {"article", "main"}
FRAME_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
#: Words in a class, id or role that name boilerplate, and content.
FRAME_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|form|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notice|notification|pagination|popup|promo\w*|related|repl(?:y|ies)|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])", re.I)
#: Of these, the ones that hold for an article inside as well.
SIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|disqus|footer|nav\w*|promo\w*|related|repl(?:y|ies)|sidebar|sponsor\w*)(?=$|[\s_-])", re.I)
SIDE_TAGS = {"nav", "footer", "aside", "menu"}
#: Names that tell what a page has, not what an element is; headers of a text.
LAYOUT_NAME = re.compile(r"(?<!\S)(?:no|has|with|without)[_-]\S*", re.I)
TEXT_HEADER = re.compile(r"(?<!\S)(?:article|content|entry|page|post|section|story)[_-]+header(?!\S)", re.I)
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?=$|[\s_-])", re.I)

#: Weights of the classifier (log-odds of being content).
BIAS, IN_CONTENT, IN_FRAME, PER_LOG_WORD, LINKS, SENTENCE, HEADING = -2.0, 4.0, -12.0, 0.6, -4.0, 0.8, 0.6
#: Smoothness between neighbours, halved for each step between their containers,
#: and between blocks of the same container.
NEXT, SAME = 1.0, 0.5
SENTENCE_END = re.compile(r"[.!?…]['\"”»)]*(?:\s|$)")


#: Marks of a container: none; a form or header; any other boilerplate; what
#: holds for articles inside as well.
CLEAR, WRAPPER, FRAME, SIDE = range(4)


@dataclass
class Block:
    text: str
    linked: int
    holder: int
    in_content: bool
    in_frame: bool
    heading: bool


@dataclass
class Element:
    """An open element; ``block`` is its nearest element that is not inline, and
    ``holder`` the number of the nearest one that is no paragraph either."""

    tag: str
    in_content: bool
    mark: int
    inline: bool
    heading: bool
    holder: int
    block: Element | None = None


class Blocks(HTMLParser):
    """The text blocks of a page, with what is known of their containers.  Each
    container has a parent and a depth, so blocks hold no paths."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.parent, self.depth = [0], [0]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inner = self.stack[-1] if self.stack else None
            block = inner.block if inner else None
            # a text that stands in an unclosed paragraph belongs to what holds the paragraph
            self.blocks.append(Block(text, min(self.linked, len(text)), inner.holder if inner else 0, bool(block and block.in_content), bool(block and block.mark), bool(block and block.heading)))
        self.parts, self.linked = [], 0

    def distance(self, a: int, b: int) -> int:
        """Steps between two containers in the DOM."""
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, n = self.parent[a], n + 1
        return n

    def _mark(self, tag: str, names: str, hidden: bool, content: bool, above: Element | None) -> int:
        """How far an element is boilerplate, with what it inherits."""
        mark = above.mark if above else CLEAR
        if tag == "main" or mark <= FRAME and tag == "article" or mark <= WRAPPER and content:
            mark = CLEAR
        if tag in ("html", "body", "article", "main"):
            return max(mark, FRAME if hidden else CLEAR)
        heads_text = bool(above and above.in_content) and (tag == "header" or bool(TEXT_HEADER.search(names)))
        names = LAYOUT_NAME.sub("", names)
        if tag in SIDE_TAGS or SIDE_WORDS.search(names):
            return SIDE
        if hidden or tag in FRAME_TAGS and tag != "form" or not heads_text and FRAME_WORDS.search(names):
            return max(mark, FRAME)
        if tag == "form" or tag == "header" and not heads_text:
            return max(mark, WRAPPER)
        return mark

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack and self.stack[-1].tag == "head" and tag not in HEAD_TAGS:
            self._pop(len(self.stack) - 1)
        inline = tag in INLINE
        if not inline and not self.silent:
            self.flush()
        if tag in VOID:
            return
        if not inline and tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") or tag in ("div", "ul", "ol", "table", "article", "section", "footer", "nav", "aside", "main", "header", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
            self._end_open("p" if tag != "li" else "li")
        above = self.stack[-1] if self.stack else None
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        content = tag in CONTENT_TAGS or bool(names and not inline and CONTENT_WORDS.search(names))
        mark = self._mark(tag, names, any(k == "hidden" for k, _ in attrs), content, above)
        e = Element(tag, content or bool(above and above.in_content), mark, inline, not inline and tag in HEADINGS or bool(above and above.block and above.block.heading), above.holder if above else 0)
        e.block = (above.block if above else None) if inline else e
        if not inline and tag != "p":
            self.parent.append(e.holder)
            self.depth.append(self.depth[e.holder] + 1)
            e.holder = len(self.parent) - 1
        self.stack.append(e)
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def _pop(self, k: int) -> None:
        for e in self.stack[k:]:
            self.silent -= e.tag in SILENT
            self.links -= e.tag == "a"
            self.open[e.tag] -= 1
        del self.stack[k:]

    def _end_open(self, tag: str) -> None:
        """A new block ends an open paragraph (or item), as the last block container."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            e = self.stack[k]
            if e.tag == tag:
                self._pop(k)
                return
            if not e.inline:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.flush()
            return
        if tag not in INLINE and not self.silent:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[k].tag == tag:
                self._pop(k)
                return
            if tag in INLINE and not self.stack[k].inline:
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and data.strip():
            self._pop(len(self.stack) - 1)
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def parsed(html: str | None) -> Blocks:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser


def log_odds(b: Block) -> float:
    """How much likelier the block is content than boilerplate."""
    return (
        BIAS + IN_CONTENT * b.in_content + IN_FRAME * b.in_frame + PER_LOG_WORD * math.log1p(b.text.count(" ") + 1)
        + LINKS * b.linked / len(b.text) + SENTENCE * bool(SENTENCE_END.search(b.text)) + HEADING * b.heading
    )


class FlowGraph:
    """Maximum flow by level graphs, and the source side of the minimum cut."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def content(self, source: int, sink: int) -> list[bool]:
        """Push the maximum flow; which nodes the source still reaches."""
        while (level := self.levels(source))[sink] >= 0:
            at, path, here = [0] * len(self.edges), [], source
            while True:
                if here == sink:
                    least = min(self.room[e] for e in path)
                    cut = len(path)
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                        if self.room[e] <= 1e-12 and k < cut:
                            cut = k
                    here = self.to[path[cut] ^ 1]
                    del path[cut:]
                elif at[here] < len(self.edges[here]):
                    e = self.edges[here][at[here]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[here] + 1:
                        path.append(e)
                        here = self.to[e]
                    else:
                        at[here] += 1
                elif path:
                    here = self.to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break
        return [x >= 0 for x in level]


def content_labels(page: Blocks) -> list[bool]:
    """The minimum-cut labelling: True for content."""
    blocks, n = page.blocks, len(page.blocks)
    if not n:
        return []
    graph, source, sink = FlowGraph(n + 2), n, n + 1
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        odds = log_odds(b)
        # -log of the probability that the label is wrong for the block
        graph.add(source, i, math.log1p(math.exp(odds)))
        graph.add(i, sink, math.log1p(math.exp(-odds)))
        if i:
            weight = NEXT * 0.5 ** page.distance(blocks[i - 1].holder, b.holder)
            graph.add(i - 1, i, weight, weight)
        if last_of.get(b.holder, i - 1) != i - 1:
            graph.add(last_of[b.holder], i, SAME, SAME)
        last_of[b.holder] = i
    return graph.content(source, sink)[:n]


def main_text(html: str | None) -> str:
    page = parsed(html)
    return " ".join(b.text for b, content in zip(page.blocks, content_labels(page), strict=True) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tasks, "page_id bigint, url string, text string, n_chars bigint")
