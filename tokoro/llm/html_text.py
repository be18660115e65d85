"""The main text of web pages, by text-to-tag ratios over a parser's events.

The standard library's parser streams a page's events into lines: a line is the text of one
block (paragraph, heading, list item, cell, ...), with how many tags it holds and how much
of it is link text. Lines of what can't be the article are marked on the way: elements that
name it (``nav``, ``footer``, ``aside``, ``form``, ``script``, ...), roles, class and id words
(``ad``, ``sidebar``, ``comments``, ...), hidden elements. A form, or a class or id word,
doesn't count on an element that holds the page's article, main element or first-rank
heading. In lists whose items are nothing but links, all lines are marked too.

Each line then has a ratio, characters outside links to tags (0 where marked). The ratios
are smoothed with a Gaussian kernel along the page, and lines whose smoothed ratio reaches
``SHARE`` of the ratios' standard deviation (or which is the largest of the page) form the
content clusters. Clusters say which region is the main text: the ``article`` with most of
their characters (all, if none has half of those in articles), else the ``main`` element,
else the innermost element with at least ``MOST`` of their characters. All unmarked lines of
an article or main element belong to the text, however short; in other regions those whose
own container holds a cluster's line do.

White space is what Python's ``str.split`` cuts at. In an article's own ``header``, headings
stay and the rest goes.

Defined results: null or empty html, or a page without text, gives an empty text of 0
characters; a very long page is read whole; broken or unclosed markup is closed where the
next block begins, an unclosed script or comment runs to the end; repeated rows give a row
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokoro.llm.common import map_arrow

#: Width of the Gaussian kernel in lines, the share of the standard deviation that content
#: reaches, and the share of content that a region without a name of its own must hold.
SIGMA, SHARE, MOST = 1.5, 0.5, 0.6

# Names of elements, roles and classes: fixed values of the format or of common usage.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas audio video map textarea select datalist title head button label".split())
ASIDE = set("nav footer aside menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside ad ads adbox adslot advert adverts advertisement advertising "
    "sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing sharebar comment comments commentlist disqus replies respond related recommended recommendations "
    "pagination pager search toolbar widget skip copyright".split()
)
#: The words that count on elements inside a block too.
INLINE_WORDS = set("ad ads advert adverts advertisement sponsor sponsored share sharing social".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set(
    "p div section article main body html header footer nav aside form fieldset legend ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
    "figure figcaption address details summary hr dialog menu center hgroup search noscript".split()
)
#: Elements that hold other blocks; the rest of the blocks are lines themselves.
CONTAINERS = set("div section article main body html header td th blockquote details center".split())
LISTS = set("ul ol".split())
#: What an element's start closes, if open and inside the given scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
INLINE_SCOPE = set("td th li dd dt".split()) | CONTAINERS
PARAGRAPHS = {"p"} | HEADINGS
MAIN = set("article main h1".split())
#: Elements that no word marks.
NEVER = set("body html main header".split())

COMMENT_END = re.compile(r"--!?\s*>")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Line:
    """A block's text, its tags, its characters in links, and the innermost element."""

    text: str
    tags: int
    links: int
    at: int


@dataclass(slots=True)
class Element:
    """An element and what it inherits from those it lies in."""

    name: str
    parent: int
    hard: bool = False  # names what isn't the article
    soft: bool = False  # does so by a word, or is a form
    skip: bool = False  # its text isn't read
    main: bool = False  # an article, a main element or a first heading
    article: bool = False  # it or an outer one is an article
    aside: bool = False  # it or an outer one is an article that a word marks
    pre: bool = False
    header: bool = False
    list: int = -1
    home: int = -1  # the innermost container
    block: str = "body"  # the innermost block's name


def names_aside(attrs: dict, words: set = WORDS) -> bool:
    """Whether class or id have a word for what isn't the article."""
    given = " ".join(filter(None, (attrs.get("class"), attrs.get("id"))))
    return bool(given) and any(w.lower() in words for w in _PARTS.findall(given))


def hidden(attrs: dict) -> bool:
    style = re.sub(r"\s", "", attrs.get("style") or "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class Lines(HTMLParser):
    """A page's events as lines and a table of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.lines: list[Line] = []
        self.open: list[int] = []
        self.names: Counter = Counter()  # of open elements
        self.text: list[str] = []
        self.tags = self.links = self.skipping = self.in_link = 0

    def line(self) -> None:
        """The block so far is a line."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append(Line(text, self.tags, self.links, self.open[-1] if self.open else -1))
            self.text = []
        self.tags = self.links = 0

    def close_to(self, names: set, scope: set) -> None:
        """Close the innermost element of some names, and all in it, unless a scope's bound
        comes first."""
        if not any(self.names[n] for n in names):
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[k]].name
            if name in names:
                for at in self.open[k:]:
                    e = self.elements[at]
                    self.names[e.name] -= 1
                    self.skipping -= e.skip
                    self.in_link -= e.name == "a"
                del self.open[k:]
                return
            if name in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.line()
            self.close_to(PARAGRAPHS, INLINE_SCOPE)
            if tag in CLOSES:
                self.close_to(*CLOSES[tag])
            if self.skipping and tag != "noscript":
                self.close_to({"head"}, RAW - {"head"})  # its end tag may be left out
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.close_to({"a"}, INLINE_SCOPE)
        parent = self.open[-1] if self.open else -1
        outer, at = self.elements[parent] if self.open else Element("", -1), len(self.elements)
        e = Element(tag, parent, tag in ASIDE, tag == "form", tag in RAW, tag in MAIN)
        e.hard |= tag == "header" and not outer.article
        if attrs:
            given = dict(attrs)
            role = (given.get("role") or "").lower()
            e.main |= role == "main"
            if block:
                e.hard |= role in ROLES or hidden(given)
                e.soft |= tag not in NEVER and names_aside(given)
            else:
                e.skip |= hidden(given) or (not outer.pre and names_aside(given, INLINE_WORDS))
        e.article = outer.article or tag == "article"
        e.aside = outer.aside or (e.soft and tag == "article")
        e.pre, e.header = outer.pre or tag == "pre", outer.header or tag == "header"
        e.list = at if tag in LISTS else outer.list
        e.home = at if tag in CONTAINERS else outer.home
        e.block = tag if block else outer.block
        e.main &= not (e.soft or e.hard or e.aside)
        self.elements.append(e)
        self.open.append(at)
        self.names[tag] += 1
        self.skipping += e.skip
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements alone

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.line()
        if tag == "br":
            self.text.append(" ")
        else:
            self.close_to({tag}, set() if tag in RAW or tag in BLOCKS else INLINE_SCOPE)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)
            if self.in_link:
                self.links += len(data)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Pages are fed whole, so a comment without an end runs to the end."""
        return super().parse_comment(i, report) if COMMENT_END.search(self.rawdata, i + 4) else len(self.rawdata)

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for positions

    def close(self) -> None:
        super().close()
        self.line()


def ratios(lines: list[Line], marked: np.ndarray) -> np.ndarray:
    """Characters outside links for each tag, 0 for marked lines."""
    plain = np.array([max(0, len(x.text) - x.links) for x in lines], float)
    tags = np.array([max(1, x.tags) for x in lines], float)
    return np.where(marked, 0.0, plain / tags)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel's part beyond either end counts as 0."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel / kernel.sum())[reach : reach + len(x)]


def clusters(lines: list[Line], marked: np.ndarray) -> np.ndarray:
    """The lines of the content clusters."""
    smooth = np.where(marked, 0.0, smoothed(ratios(lines, marked)))
    return (smooth > 0) & ((smooth >= SHARE * smooth.std()) | (smooth == smooth.max()))


def marks(page: Lines) -> np.ndarray:
    """Whether each line can't be the article's."""
    n = len(page.elements)
    holds, off = [e.main for e in page.elements], [False] * n
    for k in range(n - 1, -1, -1):  # parents come before what they hold
        e = page.elements[k]
        if holds[k] and e.parent >= 0 and not e.hard:
            holds[e.parent] = True
    for k, e in enumerate(page.elements):
        off[k] = e.hard or (e.soft and not holds[k]) or (e.parent >= 0 and off[e.parent])
    linked: dict[int, list[bool]] = {}
    for x in page.lines:
        if x.at >= 0 and (items := page.elements[x.at].list) >= 0:
            linked.setdefault(items, []).append(x.links >= len(x.text))
    menus = {k for k, items in linked.items() if len(items) > 1 and all(items)}
    out = []
    for x in page.lines:
        e = page.elements[x.at] if x.at >= 0 else Element("", -1)
        out.append(x.at >= 0 and (off[x.at] or e.list in menus or (e.header and e.block not in HEADINGS)))
    return np.array(out, bool)


def region(page: Lines, marked: np.ndarray, content: np.ndarray) -> tuple[set[int], bool]:
    """The elements whose lines are the main text, and whether they are so by name."""
    n = len(page.elements)
    size, used, depth = [0] * n, [False] * n, [0] * n
    for x, m, c in zip(page.lines, marked.tolist(), content.tolist(), strict=True):
        if x.at >= 0:
            size[x.at] += len(x.text) * c
            used[x.at] |= not m
    for k in range(n - 1, -1, -1):
        if (outer := page.elements[k].parent) >= 0:
            size[outer] += size[k]
            used[outer] |= used[k]
    for k, e in enumerate(page.elements):
        depth[k] = depth[e.parent] + 1 if e.parent >= 0 else 0
    outermost = lambda e: e.parent < 0 or not page.elements[e.parent].article
    articles = [k for k, e in enumerate(page.elements) if e.name == "article" and used[k] and outermost(e)]
    if articles:
        top = max(articles, key=lambda k: (size[k], -k))
        return ({top} if 2 * size[top] >= sum(size[k] for k in articles) else set(articles)), True
    mains = [k for k, e in enumerate(page.elements) if e.main and e.name != "h1" and used[k]]
    if mains:
        return {max(mains, key=lambda k: (size[k], -k))}, True
    total = sum(len(x.text) for x, c in zip(page.lines, content.tolist(), strict=True) if c)
    wide = [k for k, e in enumerate(page.elements) if e.name in CONTAINERS and size[k] >= MOST * total]
    return ({max(wide, key=lambda k: (depth[k], k))} if wide else set()), False


def main_text(html: str | None) -> str:
    """A page's main text, blocks joined by empty lines."""
    page = Lines()
    page.feed(html or "")
    page.close()
    if not page.lines:
        return ""
    marked = marks(page)
    content = clusters(page.lines, marked)
    chosen, named = region(page, marked, content)
    inside = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        inside[k] = k in chosen or (e.parent >= 0 and inside[e.parent])
    home = [page.elements[x.at].home if x.at >= 0 else -1 for x in page.lines]
    homes = {home[k] for k in np.flatnonzero(content)}
    kept = [
        x.text
        for x, m, h in zip(page.lines, marked.tolist(), home, strict=True)
        if not m and (not chosen or (x.at >= 0 and inside[x.at])) and (named or h in homes)
    ]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return map_arrow(given, run, "page_id long, url string, text string, n_chars long")
