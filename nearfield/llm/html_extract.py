"""Main text of web pages: text-to-tag ratio of each line, smoothed and clustered, finds the content region.

The page is streamed through the standard library's parser. Its events cut it into lines, one for each block; a line has
its text, the number of its tags and the container it stands in. The ratios of text to tags are smoothed with a Gaussian,
and the lines whose ratio reaches a threshold, a share of their mean weighted by text and ratio, are the cluster of
content. A line of the cluster weighs as much as its text times the square of its ratio.

The region is found by going down from the page as long as one container holds the weight: it must outweigh each
container beside it, and no line of the cluster may stand outside of any container. Nothing is lost below an article,
so the way ends there; nor beside containers of the same name and class, as parts of one text have. A region is taken
as a whole, short lines included. If the way ends at the page itself or at a plain container, the containers in
it stay if most of their text lies in the cluster, and the lines outside of any always do.

Names decide where ratios cannot: of two containers whose weights are close, an article goes before others, and what
is called a footer or an advert is never the region, however much it holds; within the region, what its element, class,
id or role calls a menu, a form, an advert or readers' comments is dropped.

Defined cases: a null or empty page has the empty text; broken markup (unclosed tags, cut pages) is closed where the next
block begins or the page ends; a page without containers is taken as a whole; time and memory are linear in the page,
however deeply its elements are nested; repeated rows are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("head script style noscript template title svg math iframe object canvas audio video select textarea button datalist".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td nav header footer aside form menu dialog ul ol dl".split())
#: Words of class, id and role attributes that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: These close when an element of the same kind opens.
CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: They do not close what stands outside of these.
BARRIERS = frozenset("html body article main section div td ul ol table dl".split())
#: Of the smoothing, in lines; the cluster's threshold, as a share of the mean of ratios, weighted by text and ratio; how often a container must outweigh those beside it, or an article may be outweighed.
SIGMA, SHARE, OUTWEIGHS = 1.0, 0.6, 3.0


#: Containers that need not be parts of one text, for all that they are called the same.
PLAIN = frozenset({("div", ""), ("td", ""), ("center", "")})


@dataclass
class Line:
    text: str
    tags: int
    node: int  # its container
    marked: int  # the number of open elements whose names mark furniture


class Page(HTMLParser):
    """Cuts a page into lines; its containers are numbered as they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds, self.parents = [("", "")], [-1]  # (name, class) and parent of each container; 0 is the page
        self.first_mark = [0]  # marks that stand around a container
        self.node = 0
        self.open: list[tuple[str, bool, bool, int]] = []  # name, silent, marked, the container around it
        self.places: dict[str, list[int]] = {}  # of open elements by name
        self.barriers: list[int] = []
        self.silent = self.marked = self.articles = self.tags = 0
        self.parts: list[tuple[str, int]] = []

    def flush(self) -> None:
        """Ends a block. What stands in marked inline elements is dropped from it, and is a line of its own only where nothing else stands in the block."""
        if self.parts:
            least = min((m for t, m in self.parts if t.strip()), default=None)
            if least is not None:
                text = " ".join("".join(t for t, m in self.parts if m == least).split())
                self.lines.append(Line(text, self.tags, self.node, least))
            self.parts.clear()
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES:
                self._close_implied(CLOSES[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", self.marked))
        if tag in VOID:
            return
        silent = tag in SILENT
        words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        marked = tag in FURNITURE or (tag == "header" and not self.articles) or (bool(words) and tag not in ("html", "body", "article", "main") and not MARKS.isdisjoint(words.replace("-", " ").replace("_", " ").split()))
        if tag in BLOCKS or silent or marked:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BARRIERS:
                self.barriers.append(len(self.open))
            self.open.append((tag, silent, marked, self.node))
            self.silent += silent
            self.marked += marked
            self.articles += tag == "article"
            if tag in CONTAINERS:
                self.kinds.append((tag, words))
                self.parents.append(self.node)
                self.first_mark.append(self.marked)
                self.node = len(self.kinds) - 1

    def _close(self, place: int) -> None:
        """Closes the open elements from a place on."""
        while len(self.open) > place:
            tag, silent, marked, self.node = self.open.pop()
            self.places[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()
            self.silent -= silent
            self.marked -= marked
            self.articles -= tag == "article"

    def _close_implied(self, kinds: tuple[str, ...]) -> None:
        """Closes the latest open element of these kinds, unless a barrier has opened since."""
        place = max((self.places[k][-1] for k in kinds if self.places.get(k)), default=-1)
        if place >= (self.barriers[-1] if self.barriers else 0):
            self._close(place)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((data, self.marked))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's inner part counts alone."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[full] / np.convolve(np.ones(len(ratios)), kernel)[full]


def region_of(page: Page, weights: np.ndarray) -> int:
    """The container that holds the content. weights: of the lines, 0 outside of the cluster."""
    count = len(page.kinds)
    nodes = [line.node for line in page.lines]
    own, filled = np.bincount(nodes, weights, count), np.bincount(nodes, minlength=count)
    total = own.copy()
    inner: list[list[int]] = [[] for _ in range(count)]
    for c in range(count - 1, 0, -1):
        total[page.parents[c]] += total[c]
        filled[page.parents[c]] += filled[c]
        if filled[c] and page.first_mark[c] <= page.first_mark[page.parents[c]]:
            inner[page.parents[c]].append(c)
    at = 0
    while inner[at] and page.kinds[at][0] != "article":
        heaviest = max(inner[at], key=lambda c: total[c])
        named = max((c for c in inner[at] if page.kinds[c][0] in ("article", "main")), key=lambda c: total[c], default=heaviest)
        best = named if total[named] * OUTWEIGHS >= total[heaviest] else heaviest
        others = [c for c in inner[at] if c != best]
        if page.kinds[best] not in PLAIN and any(page.kinds[c] == page.kinds[best] for c in others):
            break
        if page.kinds[best][0] in ("article", "main"):
            if own[at] > total[best] * OUTWEIGHS:
                break
        elif page.kinds[at][0] == "main" or own[at] > 0 or total[best] == 0 or any(total[c] * OUTWEIGHS > total[best] for c in others):
            break
        at = best
    return at


def content_lines(page: Page) -> list[str]:
    """The lines of the content region, in page order."""
    sizes = np.array([len(line.text) for line in page.lines], float)
    if not len(sizes):
        return []
    ratios = smoothed(sizes / np.maximum([line.tags for line in page.lines], 1))
    inside = ratios >= SHARE * (sizes @ ratios**2) / (sizes @ ratios)
    region = region_of(page, np.where(inside, sizes * ratios**2, 0))
    # the child of the region that a container lies in; the region for itself, none for what lies outside
    top: list[int | None] = [None] * len(page.kinds)
    for c, parent in enumerate(page.parents):
        top[c] = c if c == region or parent == region else top[parent] if parent >= 0 and top[parent] != region else None
    balance = np.zeros(len(page.kinds))
    for line, size, here in zip(page.lines, sizes, inside, strict=True):
        if top[line.node] is not None:
            balance[top[line.node]] += size if here else -size
    kind = page.kinds[region][0]
    judged = frozenset() if kind in ("article", "main") else CONTAINERS if kind in ("", "html", "body") else CONTAINERS - {"ul", "ol", "dl", "table"}
    around = page.first_mark[region]
    return [line.text for line in page.lines if (c := top[line.node]) is not None and line.marked <= around and (c == region or page.kinds[c][0] not in judged or balance[c] >= 0)]


def main_text(html: str | None) -> str:
    """The main text of a page, a block a line."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    return "\n".join(content_lines(page))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of a table with page_id, url and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
