"""Operator 11: main text of web pages.

A page's text is read from the events of the standard library's streaming parser. Block tags end
lines; each line has a text-to-tag ratio, the ratios are smoothed by a Gaussian kernel, and a
threshold between the low and the high cluster of smoothed ratios selects the lines that say where
the content is. The region around them is taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is no text of the article.
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input map math menu nav noscript object script search select style svg template textarea title video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: no region is smaller than their parent.
TEXT_BLOCKS = HEADINGS | frozenset("blockquote caption dd dl dt figcaption li ol p pre table tbody td th tr ul".split())
#: A tag of the key ends an open tag of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
#: Words of class, id and role names of what is no text of the article.
ADVERT_WORDS = frozenset("ad ads adv advert advertisement advertising adverts banner promo promoted promotion sponsor sponsored sponsors".split())
MENU_WORDS = frozenset("breadcrumb breadcrumbs menu menus nav navbar navigation pager pagination share sharing sidebar sidebars social tabs toolbar widget widgets related recommended".split())
NOTICE_WORDS = frozenset("alert consent cookie cookies disclaimer gdpr modal newsletter notice notices notification popup subscribe subscription".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
EDGE_WORDS = frozenset("copyright footer header masthead".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A head or foot of one of these belongs to the article.
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
NAME_WORD = re.compile(r"[a-z0-9]+")
LAST_TAG = re.compile(r"<[a-zA-Z/!?]")


def left_out(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Says whether an element is no part of an article by its tag, names, role or because it is hidden."""
    if tag in LEFT_OUT:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            for one in value.split():
                words = set(NAME_WORD.findall(one))
                if tag in ("article", "main"):
                    if words and words <= COMMENT_WORDS | {"reader", "user"}:
                        return True
                elif words & (ADVERT_WORDS | MENU_WORDS | NOTICE_WORDS | COMMENT_WORDS) or (words & EDGE_WORDS and not words & CONTENT_WORDS):
                    return True
        elif name == "role":
            if value.strip() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


@dataclass(slots=True)
class Line:
    text: str
    linked: int
    tags: int
    box: int


@dataclass
class Page:
    """Lines of a page; a box is a block element: its tag and the number of the box around it."""

    lines: list[Line] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])


class LineReader(HTMLParser):
    """Collects lines from parser events; left-out elements give no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.opened: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.tags = self.links = 0

    def updatepos(self, i: int, j: int) -> int:
        """Positions in the page are not asked for."""
        return j

    def flush(self) -> None:
        text = ""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
        elif not self.tags:
            return
        self.page.lines.append(Line(text, min(self.linked, len(text)), max(1, self.tags), self.stack[-1][1]))
        self.linked = self.tags = 0

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.opened[tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.stack[-1][0] == "p":
                self.pop()
            while self.stack[-1][0] in ENDS.get(tag, ()):
                self.pop()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "a":
            self.links += 1
        _, box, out = self.stack[-1]
        marked = left_out(tag, attrs)
        if block:
            self.page.tags.append(tag)
            self.page.parents.append(box)
            box = len(self.page.tags) - 1
        if block or marked or out:
            self.stack.append((tag, box, out or marked))
            self.opened[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in VOID:
            return
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.opened[tag] > 0:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def read_lines(html: str) -> Page:
    """Lines of a page of any form; a tag or comment that never ends hides what is behind it."""
    opened = html.find("<!--", html.rfind("-->") + 1)
    if opened >= 0:
        html = html[:opened]
    last = html.rfind(">") + 1
    broken = LAST_TAG.search(html, last)
    reader = LineReader()
    reader.feed(html[: broken.start()] if broken else html)
    reader.close()
    reader.flush()
    return reader.page


def smoothed(ratios: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Gaussian smoothing; behind both ends nothing counts."""
    steps = np.arange(-radius, radius + 1)
    kernel = np.exp(-(steps**2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, radius), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray, rounds: int = 50) -> float:
    """The border half-way between the means of the low and the high cluster."""
    total, border = float(values.sum()), float(values.mean())
    for _ in range(rounds):
        high = values[values >= border]
        if not 0 < len(high) < len(values):
            break
        above = float(high.sum())
        after = (above / len(high) + (total - above) / (len(values) - len(high))) / 2
        if after == border:
            break
        border = after
    return border


def main_text(html: str | None, sigma: float = 1.0, radius: int = 2, share: float = 0.6) -> str:
    """The article of a page: its blocks in page order, joined by one space.

    Where a page says what its article is (`article`, else `main`), lines outside count as tags
    alone and the articles with selected lines are taken whole. Elsewhere the region is the
    smallest box of which no part holds `share` of the selected text, from its first selected line
    (and the headings before it) to its last. Elements that are left out by tag, name or role give
    no text in either case, nor do lists of links.
    """
    page = read_lines(html or "")
    lines, tags, parents = page.lines, page.tags, page.parents
    if not any(line.text for line in lines):
        return ""
    holders: list[int] = []
    for kind in ("article", "main"):  # the outermost element around each box
        holders = [0]
        for box in range(1, len(tags)):
            holders.append(holders[parents[box]] or (box if tags[box] == kind else 0))
        if any(line.text and holders[line.box] for line in lines):
            break
    else:
        holders = []
    inside = [not holders or holders[line.box] > 0 for line in lines]
    ratios = np.array([(len(line.text) - line.linked) / line.tags if ok else 0.0 for line, ok in zip(lines, inside)])
    smooth = smoothed(ratios, sigma, radius)
    chosen = [bool(s and ok and line.text) for s, ok, line in zip(smooth >= threshold(smooth), inside, lines)]
    if not any(chosen):
        chosen = [bool(ok and line.text) for ok, line in zip(inside, lines)]
    if holders:
        wanted = {holders[line.box] for line, ok in zip(lines, chosen) if ok}
        taken = [holders[line.box] in wanted for line in lines]
    else:
        taken = region(page, chosen, share)
    menus = link_lists(page)
    return " ".join(line.text for line, ok in zip(lines, taken) if ok and line.text and line.box not in menus)


def region(page: Page, chosen: list[bool], share: float) -> list[bool]:
    """Lines of the smallest box of which no part holds `share` of the chosen text."""
    mass = [0] * len(page.tags)
    for line, ok in zip(page.lines, chosen):
        mass[line.box] += len(line.text) if ok else 0
    parts: dict[int, int] = {}  # the heaviest part of each box
    for box in range(len(page.tags) - 1, 0, -1):
        up = page.parents[box]
        mass[up] += mass[box]
        if up not in parts or mass[box] >= mass[parts[up]]:
            parts[up] = box
    at = 0
    while at in parts and mass[parts[at]] >= share * mass[at] and page.tags[parts[at]] not in TEXT_BLOCKS:
        at = parts[at]
    within = [False] * len(page.tags)
    within[at] = True
    for box in range(at + 1, len(page.tags)):
        within[box] = within[page.parents[box]]
    held = [k for k, (line, ok) in enumerate(zip(page.lines, chosen)) if ok and within[line.box]]
    if not held:
        return chosen
    first, last = held[0], held[-1]
    while first > 0 and within[page.lines[first - 1].box] and (page.tags[page.lines[first - 1].box] in HEADINGS or not page.lines[first - 1].text):
        first -= 1
    return [first <= k <= last and within[line.box] and (chosen[k] or 2 * line.linked <= len(line.text)) for k, line in enumerate(page.lines)]


def link_lists(page: Page, least: int = 3) -> set[int]:
    """Boxes of the items of lists that have `least` items or more and nothing but links in them."""
    items: dict[int, list[Line]] = {}
    for line in page.lines:
        if line.text and page.tags[line.box] == "li":
            items.setdefault(page.parents[line.box], []).append(line)
    return {line.box for found in items.values() if len(found) >= least and all(5 * line.linked >= 4 * len(line.text) for line in found) for line in found}


def extract(pages: DataFrame, piece: int = 64) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of `pages(page_id, url, html)`.

    A null html is an empty page; a page without text has an empty text. Long pages are read whole.
    Repeated rows, null ids and null urls stay as they are; further columns are ignored; an empty
    table gives an empty one. Pages are read where they lie: nothing is shuffled.
    """
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, piece):
                b = whole.slice(at, piece)
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
