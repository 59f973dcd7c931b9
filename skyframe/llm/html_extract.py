"""Main text of web pages by minimum-cut labelling.

A page is parsed into blocks of text (runs between block-level tags). Two labels, content and
boilerplate, are chosen for all blocks of a page at once: a labelling costs, per block, what a
classifier says against its label (the capacity of its edge to a terminal), and per edge between
neighbours its weight where their labels differ. Edges join blocks that follow each other (the
weaker, the more container borders lie between) and blocks with the containers around them (each
container is a node of its own, so proximity in the document tree takes one edge a node and
not one a pair). The maximum flow between the terminals gives the least cost
(``max_flow``).

The classifier is a logistic regression on the block's own shape: words, links, punctuation, kind
of tag. It is taught by pages that mark their parts themselves (``article``/``main`` against
``nav``, ``footer``, ``aside`` and so on), from at most ``blocks`` blocks of about ``pages`` pages
chosen by hash (``train``); weights that no block speaks for stay at their fixed start. Where a page
names its parts, by tag or by class and id, that evidence is added to the classifier's.

Scripts, styles, form controls and the head hold no blocks. Character references are decoded,
white space within a block is one space, blocks of content are joined by an empty line.

Pages are independent: one pass, no shuffle, a page at a time. Defined cases: null or empty html
gives empty text, as does a page without content; bytes that are not UTF-8 become U+FFFD; unclosed
and stray tags are repaired as browsers do in the common cases; repeated pages are extracted
one by one; without labelled pages the start weights are used; other columns pass through, those
named ``text`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import max_flow

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
    table tbody td tfoot th thead tr ul""".split())
SILENT = frozenset("""script style head title noscript template textarea select option button iframe svg math canvas object
    audio video map datalist""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol menu dir dl table tbody thead tfoot body html".split())  # implied ends stop there
BAD_TAGS = frozenset("nav footer aside dialog menu form".split())
# words of class and id attributes that name a part of a page
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments
    complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer form gdpr header legal login masthead menu meta modal
    nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies
    reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser teasers
    toolbar topbar widget widgets""".split())
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
WORDS_OF_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
STATE = re.compile(r"(?:has|with|without|no)[-_A-Z]")  # names that tell of a part elsewhere: has-sidebar, noComments
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("bias", "words", "short", "links", "sentence", "commas", "heading", "paragraph", "item", "cell", "symbols")
START = np.array([-0.5, 0.6, -0.8, -3.0, 1.0, 0.3, 0.6, 0.8, -0.6, -0.3, -0.5])
MARKED, NAMED = 900, 700  # evidence of tags and of names, in hundredths of log-odds
LIMIT = 400  # what the classifier alone can say
NEAR, AROUND = 60, 25  # weights of neighbours and of containers


@dataclass
class Node:
    """An element that holds blocks."""
    tag: str
    parent: int
    depth: int
    good: bool = False
    bad: bool = False
    wraps: bool = False  # holds the page's article, so a bad name is not about its content


@dataclass
class Block:
    parent: int
    tag: str
    text: str
    linked: int


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page([Node("html", -1, 0)])
        self.open = [0]
        self.silent: list[str] = []
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[-1]
            self.page.blocks.append(Block(at, self.page.nodes[at].tag, text, min(len(text), self.linked)))
        self.parts, self.linked = [], 0

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            elif tag != "body":
                return
            else:
                self.silent = []  # a head without an end
        if tag in SILENT:
            self.silent.append(tag)
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK_TAGS:
            self._open(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in BLOCK_TAGS or tag == "a":  # a slash means nothing on elements that are not void
            self.handle_starttag(tag, attrs)

    def _open(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.flush()
        nodes = self.page.nodes
        if tag == "hr" or tag in ("html", "body") and len(self.open) > 2:
            return
        if nodes[self.open[-1]].tag == "p":
            self._leave(len(self.open) - 1)
        ends = CLOSED_BY.get(tag)
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                here = nodes[self.open[i]].tag
                if here in ends:
                    self._leave(i)
                    if tag != "tr" or here == "tr":
                        break
                elif here in SCOPE:
                    break
        parent = self.open[-1]
        node = Node(tag, parent, nodes[parent].depth + 1)
        words = {w.lower() for name in ("class", "id", "role") for part in (attrs.get(name) or "").split()
                 if not STATE.match(part) for w in WORDS_OF_NAME.findall(part)}
        inside = {nodes[i].tag for i in self.open[-64:]}
        if inside & {"article", "main"}:
            words.discard("header")  # of the article, which holds its title
        node.good = tag in ("article", "main") and not inside & {"article", *BAD_TAGS}
        node.bad = (tag in BAD_TAGS or tag == "article" and "article" in inside
                    or tag == "header" and not inside & {"article", "main"}
                    or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style") or "")))
        if not node.good and not node.bad and tag not in ("html", "body"):
            node.bad = bool(words & BAD_NAMES)
            node.good = not node.bad and bool(words & GOOD_NAMES)
        if node.good and tag in ("article", "main"):
            for i in self.open:
                nodes[i].wraps = True
        elif tag == "h1":  # a form around the whole page, as some servers write it
            for i in self.open:
                nodes[i].wraps |= nodes[i].tag == "form"
        nodes.append(node)
        self.open.append(len(nodes) - 1)

    def _leave(self, upto: int) -> None:
        self.flush()
        del self.open[upto:]

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag == "a":
            self.links = 0
        elif tag in BLOCK_TAGS:
            self.flush()
            for i in range(len(self.open) - 1, 0, -1):
                if self.page.nodes[self.open[i]].tag == tag:
                    self.links = 0
                    self._leave(i)
                    return


def parse(html: str) -> Page:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.page


def evidence(page: Page) -> list[int]:
    """Per node, what tags and names around it say: above 0 for content, below for boilerplate. The
    innermost mark counts, but nothing inside a bad part becomes content again."""
    out = [0] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        above = out[node.parent] if node.parent >= 0 else 0
        marked = node.tag in BAD_TAGS or node.tag in ("article", "main", "header")
        if above < 0:
            out[i] = above
        elif node.bad and not node.wraps:
            out[i] = -MARKED if marked else -NAMED
        elif node.good:
            out[i] = max(above, MARKED if marked else NAMED // 4)
        else:
            out[i] = above
    return out


def features(page: Page) -> np.ndarray:
    """The shape of every block, without what names or tags around it say."""
    out = np.zeros((len(page.blocks), len(FEATURES)))
    for i, b in enumerate(page.blocks):
        words = b.text.count(" ") + 1
        n = len(b.text)
        letters = sum(map(str.isalnum, b.text[:2000])) / min(n, 2000)
        out[i] = (1, min(np.log(words), 5), words < 4, b.linked / n, b.text[-1] in ".!?\"'…”»:;", min(b.text.count(",") / words * 10, 3),
                  b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("p", "blockquote", "pre", "figcaption"),
                  b.tag in ("li", "dt", "dd"), b.tag in ("td", "th"), letters < 0.6)
    return out


def edges_of(page: Page) -> tuple[dict[tuple[int, int], int], int]:
    """Edges between blocks (their numbers) and containers (numbers behind the blocks'); a chain of
    containers with one child each is one edge. Returns them with the number of graph nodes."""
    n = len(page.blocks)
    children: dict[int, int] = {}
    for b in page.blocks:
        children[b.parent] = children.get(b.parent, 0) + 1
    for i in range(len(page.nodes) - 1, 0, -1):  # parents come before their children
        if i in children:
            up = page.nodes[i].parent
            children[up] = children.get(up, 0) + 1
    used = {i: n + k for k, i in enumerate(sorted(i for i, c in children.items() if c > 1))}
    nearest = [-1] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        nearest[i] = i if i in used else nearest[node.parent] if node.parent >= 0 else -1
    edges: dict[tuple[int, int], int] = {}
    for i, b in enumerate(page.blocks):
        if nearest[b.parent] >= 0:
            edges[i, used[nearest[b.parent]]] = AROUND
        if i:
            edges[i - 1, i] = NEAR // (1 + _borders(page.nodes, page.blocks[i - 1].parent, b.parent))
    for i, number in used.items():
        up = page.nodes[i].parent
        if up >= 0 and nearest[up] >= 0:
            edges[number, used[nearest[up]]] = AROUND
    return edges, n + len(used)


def _borders(nodes: list[Node], a: int, b: int) -> int:
    """Container borders between two nodes, counted up to the weight of an edge."""
    steps = 0
    while a != b and steps < NEAR:
        if nodes[a].depth >= nodes[b].depth:
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        steps += 1
    return steps


def label(page: Page, weights: np.ndarray) -> list[bool]:
    """Whether each block is content: the labelling of least cost."""
    if not page.blocks:
        return []
    marks = evidence(page)
    odds = np.clip(np.rint(100 * (features(page) @ weights)), -LIMIT, LIMIT).astype(int).tolist()
    edges, size = edges_of(page)
    gain = [o + marks[b.parent] for o, b in zip(odds, page.blocks)] + [0] * (size - len(page.blocks))
    return max_flow.sides(gain, edges)[:len(page.blocks)]


def main_text(html: str, weights: np.ndarray) -> str:
    page = parse(html)
    return "\n\n".join(b.text for b, content in zip(page.blocks, label(page, weights)) if content)


def _decode(html: bytes | None) -> str:
    return (html or b"").decode("utf-8", "replace")


def labelled_blocks(pages: DataFrame) -> DataFrame:
    """Blocks inside parts that a page marks by tags: ``features`` and whether they are ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = parse(_decode(html))
                marks = evidence(page)
                chosen = [i for i, b in enumerate(page.blocks) if abs(marks[b.parent]) == MARKED]
                if chosen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(features(page)[chosen]), pa.list_(pa.float64())),
                         pa.array([marks[page.blocks[i].parent] > 0 for i in chosen]),
                         pa.array([page.blocks[i].text for i in chosen])], names=["features", "content", "text"])

    return (pages.select(F.col("html").cast("binary").alias("html"))
            .mapInArrow(run, "features array<double>, content boolean, text string"))


def train(pages: DataFrame, pages_wanted: int = 500, blocks: int = 8000, pull: float = 20.0) -> np.ndarray:
    """Weights of the classifier, from at most ``blocks`` marked blocks of about ``pages_wanted`` pages
    (both chosen by hash). ``pull`` is the strength with which weights stay at their start."""
    count = pages.count()
    share = -(-count // pages_wanted) if count else 1
    chosen = pages.where(F.pmod(F.xxhash64("html"), F.lit(share)) == 0).select("html")
    # distinct, so that a page with many copies is one
    rows = (labelled_blocks(chosen).distinct().withColumn("h", F.xxhash64("text", "features", "content"))
            .orderBy("h").limit(blocks).select("features", "content").toPandas())
    return fit(np.array(rows["features"].tolist()).reshape(-1, len(FEATURES)), rows["content"].to_numpy(dtype=float), pull)


def fit(x: np.ndarray, y: np.ndarray, pull: float, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, both labels weighing the same, pulled to ``START``."""
    w = START.copy()
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(w):
        return weight @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)) + pull / 2 * ((w - START) ** 2).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * (w - START)
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """``pages`` without html, with ``text``: the main text of each page."""
    kept = [c for c in pages.columns if c not in ("html", "text")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(_decode(h), weights) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*kept, F.col("html").cast("binary").alias("html")).mapInArrow(run, schema)
