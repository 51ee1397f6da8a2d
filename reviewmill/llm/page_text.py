"""Main text of web pages by ratios of tag paths.

A page is read into blocks, the stretches of text between block elements, each with its tag path
from the root to the innermost block. For every path of the page the length of its text, its
punctuation marks and its link text are summed over its blocks. Text and marks for each block are the
two ratios of a path: long sentences have both, menus and labels neither. The ratios are fused (their
geometric mean, less the share of links), smoothed over neighbouring blocks, nearer paths weighing more,
so that headings and short paragraphs gain from the text around them, and cut at a threshold taken from their
spread. Blocks of the paths above it are content; their common container holds the article.

What cannot be article by its element, role or class (menus, forms, adverts, comments and so on; fixed values below)
takes no part. Within an ``article`` or ``main`` element that holds the content nothing else is dropped but
menu-like paths; where there is none, the container is the element at which the content no longer lies
in one child, and paths below the threshold are dropped.

Each page is read once, in time that grows with its length; tasks hold a slice of pages, and no rows
are shuffled.

Defined results
---------------
* html NULL, empty or without content: an empty text of 0 characters. URLs are not looked at and may be NULL.
* Unclosed and misnested elements close as in browsers as far as text is concerned; an unclosed comment or script reaches to the end.
* Character references are decoded once; white space of any kind counts as one space; blocks are joined by one space.
* Keys may be NULL or repeated: every row is answered by itself. An empty table gives an empty result.
* Columns other than the named ones are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewmill.llm.common import sliced_by_bytes

SLICE_BYTES = 4_000_000
NEAR = 2  # blocks on either side that smooth a ratio
WIDTH = 1.0  # of the kernel over blocks
SPREAD = 0.5  # threshold in standard deviations
HOLDS = 0.7  # share of the content that a container must have
MENU_LINKS = 0.8  # share of link text that makes a path of lists a menu

# Elements of HTML by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
NEVER = frozenset("aside button canvas datalist dialog footer head map math menu nav object search select svg template".split()) | RAW
CLOSES_P = BLOCKS - frozenset("br body caption html legend optgroup option tbody td tfoot th thead tr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element closes an open one of its kind, up to the container of that kind.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
SCOPES = frozenset("table td th caption button object html".split())
# Words in roles, classes and ids of what is not article.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer foot gdpr login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup "
    "promo promoted promotion recommendations recommended related replies respond search share sharing shoutbox sidebar "
    "sidenav signup skip social sponsor sponsored submenu subscribe subscription taboola toolbar topbar trending widget "
    "widgets".split()
)
HEADER_WORDS = frozenset(("header", "head"))
LAYOUT = frozenset("div section table td tr ul".split())  # may be the header of a page by a class
IN_HEAD = frozenset("base bgsound link meta noscript script style template title".split())
ARTICLE_WORDS = frozenset("article content entry post story text".split())
PREFIXES = frozenset("has is js no with without".split())

MARK = re.compile(
    r"<(?:!--(?:>|->|.*?--!?>|.*)|[!?][^>]*>?|/(?:[^a-zA-Z>][^>]*)?>"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[,.;:!?…、。，！？،؟।]")


@dataclass(slots=True)
class _Element:
    tag: str
    number: int
    path: int
    soft: int  # nearest element that a word or form rules out, -1 without
    never: bool
    article: bool  # within an article element
    content: bool  # or one whose class says so
    links: bool


@dataclass(slots=True)
class Block:
    """A stretch of text: its path and element, and how much of it is link text."""

    text: str
    path: int
    element: int
    soft: int
    tag: str
    linked: int
    marks: int = 0
    score: float = 0.0


@dataclass
class Page:
    """Blocks in page order and the elements that they lie in."""

    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    above: list[tuple[int, int]] = field(default_factory=list)  # parent and depth of a path
    soft_parents: dict[int, int] = field(default_factory=dict)
    semantic: list[tuple[int, int]] = field(default_factory=list)  # article and main elements, with soft


def _ruled_out(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool, str]:
    """Whether role, class or id tell that an element is no article, or that it is one; and its classes."""
    out, article, classes = False, False, ""
    header = tag in LAYOUT and not in_content
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            out = out or value.strip().lower() in ROLES
            article = article or value.strip().lower() in ("main", "article")
            continue
        if name.lower() == "class":
            classes = ".".join(re.sub(r"\d+", "", value).split())
        for given in value.split():
            words = [w.lower() for w in WORD.findall(given)]
            if not words or words[0] in PREFIXES:
                continue
            out = out or not WORDS.isdisjoint(words) or (header and not HEADER_WORDS.isdisjoint(words))
            article = article or not ARTICLE_WORDS.isdisjoint(words)
    return out and tag not in ("html", "body", "main"), article, classes


class _Reader:
    """Reads one page into blocks."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[_Element] = []
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0
        self.at: tuple[int, int, int, str] = (0, 0, -1, "#")  # path, element, soft and tag of the pieces
        self.push("#", "")

    def push(self, tag: str, attributes: str) -> None:
        page, up = self.page, self.stack[-1] if self.stack else None
        number = len(page.tags)
        page.tags.append(tag)
        page.parents.append(up.number if up else -1)
        in_article, in_content = (up.article, up.content) if up else (False, False)
        out, content, classes = _ruled_out(tag, attributes, in_content) if attributes else (False, False, "")
        out = out or tag == "form"
        soft = up.soft if up else -1
        if out:
            page.soft_parents[number] = soft
            soft = number
        elif tag in ("article", "main"):
            page.semantic.append((number, soft))
        path = up.path if up else -1
        if up is None or tag in BLOCKS:
            step = (path, f"{tag}.{classes}" if classes else tag)
            path = page.paths.setdefault(step, len(page.paths))
            if path == len(page.above):
                page.above.append((step[0], page.above[step[0]][1] + 1 if up else 0))
        never = bool(up and up.never) or tag in NEVER or (tag == "header" and not in_article)
        article = in_article or tag in ("article", "main")
        links = tag == "a" or bool(up and up.links)
        self.stack.append(_Element(tag, number, path, soft, never, article, article or content or in_content, links))
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag] -= 1

    def close_open(self, tags: tuple[str, ...], scope) -> None:
        """Close the nearest open element of ``tags`` that is not beyond one of ``scope``."""
        if not any(self.open.get(tag) for tag in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                return self.pop_to(depth)
            if self.stack[depth].tag in scope:
                return

    def break_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                path, element, soft, tag = self.at
                self.page.blocks.append(Block(text, path, element, soft, tag, self.linked))
            self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if self.stack[-1].tag == "head" and raw.strip():
            self.pop_to(len(self.stack) - 1)
        top = self.stack[-1]
        if raw and not top.never:
            raw = entities.unescape(raw) if "&" in raw else raw
            if self.pieces and top.soft != self.at[2]:  # a block ends where another part of the page begins
                self.break_block()
            if not self.pieces:
                block = next((e for e in reversed(self.stack) if e.tag in BLOCKS), self.stack[0])
                self.at = (top.path, block.number, top.soft, block.tag)
            self.pieces.append(raw)
            if top.links:
                self.linked += len(raw)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.break_block()
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.pop_to(len(self.stack) - 1)
        if tag in CLOSES_P:
            self.close_open(("p",), SCOPES)
        if tag in SIBLINGS:
            self.close_open(*SIBLINGS[tag])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag not in VOID:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.break_block()
        if not self.open.get(tag) or tag in ("html", "body"):
            return
        depth = next(d for d in range(len(self.stack) - 1, -1, -1) if self.stack[d].tag == tag)
        if tag in FORMATTING and any(e.tag in BLOCKS for e in self.stack[depth + 1 :]):
            self.open[tag] -= 1  # closed by itself, the blocks within stay open
            del self.stack[depth]
        else:
            self.pop_to(depth)

    def read(self, source: str) -> Page:
        at, end = 0, len(source)
        while at < end:
            mark = MARK.search(source, at)
            self.text(source[at : mark.start() if mark else end])
            if not mark:
                break
            at = mark.end()
            if not mark[2]:
                continue
            tag = mark[2].lower()
            if mark[1]:
                self.end(tag)
                continue
            self.start(tag, mark[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                self.end(tag)
        self.break_block()
        return self.page


def _allowed(page: Page) -> list[Block]:
    """Blocks that no word or form rules out.

    Where every ``article`` and ``main`` lies in something ruled out, that is taken for the page's layout.
    """
    excused: set[int] = set()
    if page.semantic and all(soft >= 0 for _, soft in page.semantic):
        for _, soft in page.semantic:
            while soft >= 0:
                excused.add(soft)
                soft = page.soft_parents[soft]
    kept = []
    for block in page.blocks:
        soft = block.soft
        while soft >= 0 and soft in excused:
            soft = page.soft_parents[soft]
        if soft < 0:
            kept.append(block)
    return kept


def _distance(page: Page, a: int, b: int) -> int:
    """Steps from one path to another over the last they share."""
    steps = 0
    while a != b:
        if page.above[a][1] < page.above[b][1]:
            a, b = b, a
        a, steps = page.above[a][0], steps + 1
    return steps


def _scored(page: Page, blocks: list[Block]) -> tuple[dict[int, float], float]:
    """Smoothed, fused ratio of every path, and the threshold."""
    sums: dict[int, list[float]] = {}
    for block in blocks:
        total = sums.setdefault(block.path, [0, 0, 0, 0])
        block.marks = len(MARKS.findall(block.text))
        for i, value in enumerate((1, len(block.text), block.marks, min(block.linked, len(block.text)))):
            total[i] += value
    fused = {
        path: math.sqrt((length / n) * (marks / n)) * (1 - linked / length) for path, (n, length, marks, linked) in sums.items()
    }
    near: dict[tuple[int, int], float] = {}
    smooth: dict[int, list[float]] = {}
    for i, block in enumerate(blocks):
        value = weight = 0.0
        for j in range(max(0, i - NEAR), min(len(blocks), i + NEAR + 1)):
            pair = (block.path, blocks[j].path)
            if pair not in near:
                near[pair] = 1 / (1 + _distance(page, *pair))
            share = math.exp(-((i - j) ** 2) / (2 * WIDTH**2)) * near[pair]
            value, weight = value + share * fused[blocks[j].path], weight + share
        smooth.setdefault(block.path, []).append(value / weight)
    scores = {path: sum(values) / len(values) for path, values in smooth.items()}
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    return scores, min(SPREAD * spread, max(scores.values()))


def _within(page: Page, element: int) -> Iterator[int]:
    while element >= 0:
        yield element
        element = page.parents[element]


def content_blocks(page: Page) -> list[Block]:
    """Blocks of the main text, in page order."""
    blocks = _allowed(page)
    if not blocks:
        return []
    scores, threshold = _scored(page, blocks)
    chosen = {path for path, score in scores.items() if score >= threshold}
    menus = _menus(blocks)
    mass: dict[int, float] = {}
    for block in blocks:
        if block.path in chosen and block.path not in menus:
            plain = max(0, len(block.text) - block.linked) + 1
            for element in _within(page, block.element):
                mass[element] = mass.get(element, 0) + plain
    semantic = [e for e, _ in page.semantic if e in mass]
    if semantic:
        container = max(semantic, key=lambda e: (mass[e], -e))
        for element in semantic:  # outer ones come first
            if mass[element] >= HOLDS * mass[container] and container in _within(page, element):
                container = element
        chosen = set(scores)
    else:
        container = _container(page, mass)
        chosen |= {b.path for b in blocks if b.tag in HEADINGS}
    inside = []
    for block in blocks:
        title = block.tag == "h1" and page.parents[block.element] == page.parents[container]
        if title or (block.path in chosen and block.path not in menus and container in _within(page, block.element)):
            inside.append(block)
    return inside


def _menus(blocks: list[Block]) -> set[int]:
    """Paths of list entries that are links for the most part."""
    sums: dict[int, list[int]] = {}
    for block in blocks:
        if block.tag == "li":
            total = sums.setdefault(block.path, [0, 0, 0])
            for i, value in enumerate((1, len(block.text), block.linked)):
                total[i] += value
    return {path for path, (n, length, linked) in sums.items() if n > 1 and linked >= MENU_LINKS * length}


def _container(page: Page, mass: dict[int, float]) -> int:
    """The last element on the way down that has nearly all content in it and not in one child block."""
    below: dict[int, int] = {}  # child with most content
    for element in mass:
        up = page.parents[element]
        if up >= 0 and (up not in below or mass[element] > mass[below[up]]):
            below[up] = element
    at = 0
    while at in below and mass[below[at]] >= HOLDS * mass[at] and page.tags[below[at]] not in ("p", "li", "pre", "blockquote", *HEADINGS):
        at = below[at]
    return at


def main_text(source: str | None) -> str:
    """Main text of a page."""
    return " ".join(block.text for block in content_blocks(_Reader().read(source or "")))


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: key, url and html to key, url and text."""
    for batch in sliced_by_bytes(batches, 2, SLICE_BYTES):
        texts = pa.array([main_text(source.as_py()) for source in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["key", "url", "text"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "url")]
    found = rows.mapInArrow(_tasks, f"key {kinds[0]}, url {kinds[1]}, text string")
    return found.select(
        F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("bigint").alias("n_chars")
    )
