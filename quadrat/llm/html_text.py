"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page becomes a list of text blocks with the elements around them.  A logistic
classifier, fitted on the labelled pages of ``html_samples``, gives each block log-odds
of being content; they are the capacities of its arcs to the two terminals.
Neighbouring blocks and blocks near in the tree are tied by smoothness arcs.  The
minimum cut, found by maximum flow, is the labelling of least total cost.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import tidy

# Fixed element lists of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is no text of the page.
SILENT = set("script style noscript template title svg math iframe object canvas audio video textarea select datalist button".split())
#: What a start tag closes if it is still open, up to the first of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Evidence in elements and in the words of class, id and role.
CONTENT_TAGS, CHROME_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
CONTENT_WORDS = set("article content entry post story main articlebody postbody text".split())
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs complementary contentinfo cookie cookies "
    "consent disclaimer footer form gdpr header login masthead menu nav navbar navigation newsletter notice notification pager "
    "pagination popup promo promotion recommended related search share sharing sidebar sidenav signup social sponsor "
    "sponsored subscribe tags toc toolbar topbar widget".split()
)
REMARK_WORDS = set("comment comments commentlist disqus replies reply respond responses".split())
#: Parts after which a name speaks of what stands beside, and chrome words that name a part of the content.
BESIDE_WORDS, PART_WORDS = {"has", "with", "without", "no"}, {"header", "banner", "masthead"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")
_LEGAL = re.compile(r"(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Block:
    __slots__ = ("path", "parts", "linked", "text")

    def __init__(self, path: tuple[int, ...]):
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


class Page:
    """Blocks of a page; ``hints[n]`` is what element n says by its name and by its attributes.

    Either is +1 for content, -1 for chrome, 0 for nothing; attributes say -2 of remarks
    and -3 of what is hidden.
    """

    def __init__(self, source: str):
        self.tags: list[str] = ["#"]
        self.hints: list[tuple[int, int]] = [(0, 0)]
        self.blocks: list[Block] = []
        self.stack: list[int] = [0]
        self.open: Block | None = None
        self.links = 0
        self._read(source)
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        self.blocks = [b for b in self.blocks if b.text]

    def _say(self, text: str) -> None:
        if not text:
            return
        if self.open is None:
            if text.isspace():
                return
            self.open = Block(tuple(self.stack))
            self.blocks.append(self.open)
        text = html.unescape(text) if "&" in text else text
        self.open.parts.append(text)
        if self.links:
            self.open.linked += len(text)

    def _hint(self, tag: str, attrs: str) -> tuple[int, int]:
        name = 1 if tag in CONTENT_TAGS else -1 if tag in CHROME_TAGS else 0
        if tag == "header" and not any(max(self.hints[n]) > 0 for n in self.stack):
            name = -1
        return name, _says(attrs) if attrs.strip() and tag not in ("body", "html") else 0

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[k]]
            if tag in tags:
                del self.stack[k:]
                return
            if tag in stop:
                return

    def _read(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            self._say(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, ends, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
            if tag in SILENT:
                if not ends and not attrs.rstrip().endswith("/"):
                    over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    if over is None and tag in ("noscript", "svg", "math", "object", "canvas", "audio", "video", "template", "button", "select"):
                        continue  # never closed: the rest is not swallowed
                    at = over.end() if over else len(source)
                continue
            if tag == "br":
                self._say(" ")
            elif tag in BLOCK:
                self.open = None
                if ends:
                    if any(self.tags[n] == tag for n in self.stack):
                        self._close({tag}, set())
                    continue
                if tag in CLOSES:
                    self._close(*CLOSES[tag])
                if self.tags[self.stack[-1]] == "p":
                    self.stack.pop()
                if tag not in VOID:
                    self.hints.append(self._hint(tag, attrs))
                    self.tags.append(tag)
                    self.stack.append(len(self.tags) - 1)
            elif tag == "a":
                self.links = 0 if ends else 1
        self._say(source[at:])


def _says(attrs: str) -> int:
    """What the attributes of an element say.

    Every name in class, id, role and itemprop has a vote by its words: remarks, else
    content or chrome; content with a chrome word beside it is chrome, but for the words
    of a content's own parts (``entry-header``).  Names of what stands beside
    (``has-sidebar``) have none.
    """
    votes = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return -3
        if name not in ("class", "id", "role", "itemprop"):
            continue
        for one in value.split():
            words = set(_SPLIT.split(one))
            if words & BESIDE_WORDS:
                continue
            if words & REMARK_WORDS:
                return -2
            chrome = words & CHROME_WORDS
            if words & CONTENT_WORDS:
                votes += 1 if chrome <= PART_WORDS else -1
            elif chrome:
                votes -= 1
    return (votes > 0) - (votes < 0)


def features(page: Page, block: Block) -> list[float]:
    """What the classifier sees of a block: the elements around it and its text."""
    names, says = [page.hints[n][0] for n in block.path], [page.hints[n][1] for n in block.path]
    last = lambda x: next((v for v in reversed(x) if v), 0)
    name, said = last(names), last([max(v, -1) for v in says])
    deepest = last([a or max(b, -1) for a, b in zip(names, says)])
    size = len(block.text)
    legal = _LEGAL.search(block.text) is not None
    return [
        1.0,
        float(name > 0),
        float(name < 0),
        float(said > 0),
        float(said < 0),
        float(deepest > 0),
        float(deepest < 0),
        float(-2 in says),
        float(-3 in says),
        min(size / 120, 1.0),
        float(_SENTENCE.search(block.text) is not None),
        min(block.linked / max(size, 1), 1.0),
        float(page.tags[block.path[-1]] in HEADINGS),
        float(legal),
        float(legal and max(deepest, 0) == 0),
    ]


#: Penalty of the classifier's weights, and bound of its log-odds: ties can outweigh one that is unsure.
PENALTY, BOUND = 0.02, 6.0


@lru_cache
def weights() -> tuple[float, ...]:
    """The classifier's weights: logistic regression on the labelled pages, by Newton's method."""
    from quadrat.llm.html_samples import pages

    rows, labels = [], []
    for source in pages():
        page = Page(source)
        for b in page.blocks:
            mark, b.text = b.text[0], b.text[1:]
            rows.append(features(page, b))
            labels.append(float(mark == "+"))
    x, y = np.array(rows), np.array(labels)
    # what no page shows still speaks: hidden blocks are no text of the page
    x, y = np.vstack([x, np.eye(x.shape[1])[[0, 8, 8]] + np.eye(x.shape[1])[[9, 9, 0]]]), np.append(y, [1.0, 0.0, 0.0])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + PENALTY / 10 * w
        hess = (x.T * (p * (1 - p))) @ x / len(y) + PENALTY / 10 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return tuple(w.tolist())


def log_odds(page: Page, block: Block) -> float:
    """The classifier: log-odds that a block is content."""
    x = features(page, block)
    if x[7] or x[8]:  # remarks of readers and hidden blocks are out by definition
        return -BOUND
    return max(-BOUND, min(BOUND, sum(a * b for a, b in zip(weights(), x))))


#: Smoothness: of neighbours in page order, falling with tree distance; of the next block of the same parent.
NEXT, SIBLING = 1.2, 0.8


def ties(page: Page) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for k, b in enumerate(page.blocks):
        if k:
            p, q = page.blocks[k - 1].path, b.path
            common = sum(1 for x, y in zip(p, q) if x == y)
            out.append((k - 1, k, NEXT / (1 + len(p) + len(q) - 2 * common)))
        parent = b.path[-2] if len(b.path) > 1 else b.path[-1]
        if parent in last and last[parent] != k - 1:
            out.append((last[parent], k, SIBLING))
        last[parent] = k
    return out


def minimum_cut(odds: list[float], arcs: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: who stays with the source (content) after maximum flow.

    What a block draws from the source and can give the sink itself is cancelled
    first, so each block is left with an excess or a deficit; flow then runs over
    the smoothness arcs along shortest augmenting paths.
    """
    n = len(odds)
    spare, room = [max(z, 0.0) for z in odds], [max(-z, 0.0) for z in odds]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in arcs:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    tiny = 1e-9
    while True:
        came: list[int | None] = [None] * n
        todo = deque()
        for k in range(n):
            if spare[k] > tiny:
                came[k] = k
                todo.append(k)
        goal = None
        while todo and goal is None:
            a = todo.popleft()
            for b, c in near[a].items():
                if c > tiny and came[b] is None:
                    came[b] = a
                    if room[b] > tiny:
                        goal = b
                        break
                    todo.append(b)
        if goal is None:
            return [c is not None for c in came]
        path, k = [goal], goal
        while came[k] != k:
            k = came[k]
            path.append(k)
        path.reverse()
        flow = min(spare[path[0]], room[goal], *(near[a][b] for a, b in zip(path, path[1:])))
        spare[path[0]] -= flow
        room[goal] -= flow
        for a, b in zip(path, path[1:]):
            near[a][b] -= flow
            near[b][a] += flow


def main_text(source: str | None) -> str:
    """The article of a page: its content blocks in order, joined by a line feed."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    labels = minimum_cut([log_odds(page, b) for b in page.blocks], ties(page))
    return "\n".join(b.text for b, content in zip(page.blocks, labels) if content)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *carry, text, n_chars) of every row of ``pages``.

    White space is what Unicode says it is, no-break spaces included.  Null, empty and
    textless pages give an empty text.  Whole pages are read,
    whatever their length and however broken; a comment or script that never ends
    runs to the end of the page, as in browsers.  Repeated rows and null ids are
    kept one to one; an empty table gives an empty result; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            memo: dict[str | None, str] = {}
            out = []
            for source in b.column(0).to_pylist():
                if source not in memo:
                    memo[source] = main_text(source)
                out.append(memo[source])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*b.schema.names[1:], "t", "n"])

    given = pages.select(F.col(html_col).alias("h"), F.col(id_col).alias("i"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    out = given.mapInArrow(tidy(run), f"{schema}, t string, n bigint")
    return out.select(F.col("i").alias(id_col), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], F.col("t").alias("text"), F.col("n").alias("n_chars"))
