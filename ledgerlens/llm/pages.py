"""Main text of web pages by text-to-tag ratio.

A standard-library parser streams a page's events into lines: one per block
element, with its text and the number of tags it took. Lines inside menus,
headers, footers, asides, forms, adverts, notices, comment lists and hidden
elements are structure and count with a ratio of 0. A class or id makes an element
structure only as a whole ("sidebar", not "has-sidebar"), and not if the element
holds a main, an article that is no comment, or most of the text of a page that
marks no article elsewhere. The ratio of text to tags is
smoothed along the page by a Gaussian; lines above a threshold select regions, on
pages with an article too. Lines of an article weigh double against the threshold.
The outermost ``article``, ``main`` or article body that holds a selected line is a
region as a whole, because clusters alone cut its short blocks off. Between and
outside of articles a region is every line from the first to the last of a cluster,
with the heading above. All lines of a region that are not structure are the main
text, short ones included; where no article has a selected line, the longest is kept
beside the regions outside.

Cases: a missing or empty page gives an empty text; broken and cut off markup is
read as far as it goes; pages without an article use the ratio alone. Work is per
page and linear in its length, however deep its elements lie, so that repeated rows,
ties and other columns do not matter; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, name

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead title tr ul".split()
)
# Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object audio video canvas select textarea button head title datalist map".split())
STRUCTURE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset(("article", "main"))
# Elements whose class names never make them structure.
NEVER = frozenset("html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar note".split())
# Words in class and id that name what is around an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup social share "
    "sharing related recommended recommendation recommendations trending popular sidebar sidebars widget widgets nav navbar "
    "navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist "
    "respond reply replies disqus discussion login search copyright outbrain taboola teaser teasers".split()
)
# Words that may stand beside them in the same class or id.
BESIDE = frozenset("area bar block bottom box button buttons container inner item items left link links list main post posts primary right secondary section site top wrap wrapper".split())
HEADER_NAMES = frozenset(("header",))
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag closes these open elements of its own kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside blockquote body div dl footer form header main nav ol section table td th ul".split())
# What a line of an article counts against one outside when lines are held against the threshold.
MARKED = 2.0
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


def _named(attrs: dict[str, str | None], names: frozenset[str]) -> bool:
    """Whether a class or the id as a whole says one of ``names``: "cookie-notice" and "related-posts", not "has-sidebar"."""
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if not names.isdisjoint(words) and all(w in names or w in BESIDE for w in words):
            return True
    return False


class Element:
    """An open or closed element: what its markup says, before it is known what it holds."""

    __slots__ = ("tag", "parent", "silent", "around", "named", "comments", "header", "article", "real", "breaks", "within", "beneath", "size", "holds", "structure", "number")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.silent = self.around = self.named = self.comments = self.header = self.article = self.real = self.breaks = False
        # Inside of an article; at or below an element that is around the text.
        self.within = self.beneath = False
        # Characters inside; number of articles and mains inside.
        self.size = 0
        self.holds = [0, 0]
        self.structure, self.number = False, 0


class Lines(HTMLParser):
    """Collects ``lines``: [text pieces, tags, element that holds it, element that begins it]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", None)]
        self.open = [self.elements[0]]
        # Places of the open elements by tag.
        self.at: dict[str, list[int]] = {}
        self.lines: list[list] = []
        self._start("")

    def _start(self, tag: str) -> None:
        self.lines.append([[], 0, self.open[-1], tag])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self._close_implied(CLOSES[tag])
        if not self.open[-1].silent:
            self.lines[-1][1] += 1
            if tag in ("br", "td", "th", "img"):
                self.lines[-1][0].append(" ")
        if tag in VOID:
            if tag == "hr":
                self._start(tag)
            return
        a = dict(attrs)
        e = Element(tag, self.open[-1])
        up = e.parent
        e.silent = up.silent or tag in SILENT
        inside = e.within = up.within or up.article and not up.around
        role = (a.get("role") or "").lower()
        marked = "class" in a or "id" in a
        e.comments = marked and _named(a, COMMENT_NAMES)
        if tag == "article" or role == "article":
            e.around, e.real = e.comments, not (marked and _named(a, NAMES))
        elif tag not in NEVER:
            e.around = tag in STRUCTURE or role in ROLES or tag == "header" and not inside
            e.named = marked and _named(a, NAMES)
            e.header = marked and not inside and _named(a, HEADER_NAMES)
        hidden = "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        e.around = e.around or hidden
        e.article = tag in ARTICLE or role in ("main", "article") or (a.get("itemprop") or "").lower() == "articlebody"
        e.breaks = tag in BLOCK or e.around or e.named or e.header or e.article
        e.beneath = up.beneath or e.around
        self.elements.append(e)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(e)
        if e.article and (e.real or tag != "article" and role != "article") and not e.beneath:
            e.holds[not e.real] += 1
        if e.breaks:
            self._start(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[-1].silent:
            self.lines[-1][1] += 1
        if self.at.get(tag):
            self._pop(self.at[tag][-1])

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close_implied(self, tags: set[str]) -> None:
        place = self._last(tags)
        if place and place >= self._last(SCOPES):
            self._pop(place)

    def _pop(self, i: int) -> None:
        changed = any(e.breaks for e in self.open[i:])
        for e in reversed(self.open[i:]):
            self.at[e.tag].pop()
        del self.open[i:]
        if changed:
            self._start("")

    def handle_data(self, data: str) -> None:
        if not self.open[-1].silent:
            self.lines[-1][0].append(data)

    def resolve(self) -> None:
        """Which elements are structure, and the number of the article they lie in or 0."""
        for pieces, _, e, _ in self.lines:
            e.size += len("".join(pieces).strip())
        # An element comes after its parent, so that backwards every element is complete when it is added to its parent.
        for e in reversed(self.elements[1:]):
            if e.around:
                e.size = 0
            e.parent.size += e.size
            e.parent.holds[0] += e.holds[0]
            e.parent.holds[1] += e.holds[1]
        top, articles = self.elements[0], 0
        for e in self.elements[1:]:
            up = e.parent
            around = e.around
            if e.named or e.header:
                # A class alone removes no main, no article that is no comment, and not most of the text, unless the page marks an article elsewhere.
                holds = e.holds[1] or e.holds[0] and not e.comments
                most = e.size > top.size / 2 and (e.holds == top.holds or up.number and not e.comments)
                around = around or not (holds or most)
            e.structure = up.structure or around
            e.number = up.number
            if e.article and not e.number and not e.structure:
                articles += 1
                e.number = articles


def page_lines(html: str) -> list[tuple[str, int, bool, int, str]]:
    """The non-empty lines of a page: text, tags, structure, article, element."""
    p = Lines()
    p.feed(html)
    p.close()
    p.resolve()
    out = []
    carried = 0  # tags of empty lines count for the next line
    for pieces, tags, element, tag in p.lines:
        text = " ".join("".join(pieces).split())
        if text:
            out.append((text, tags + carried, element.structure, element.number, tag))
            carried = 0
        else:
            carried += tags
    return out


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the edges the kernel is cut and scaled."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weighed = np.convolve(ratio, kernel)[radius : radius + len(ratio)]
    return weighed / np.convolve(np.ones(len(ratio)), kernel)[radius : radius + len(ratio)]


def main_text(html: str | None, sigma: float = 1.0, level: float = 1.0) -> str:
    """Blocks of the main text joined by newlines. The threshold is ``level`` standard deviations of the smoothed ratio."""
    lines = page_lines(html) if html else []
    free = [i for i, x in enumerate(lines) if not x[2]]
    if not free:
        return ""
    ratio = np.array([0.0 if s else len(t) / max(1, n) for t, n, s, _, _ in lines])
    soft = smooth(ratio, sigma)
    bound = level * soft.std()
    # A line of an article counts MARKED times.
    weighed = soft * np.array([MARKED if x[3] else 1.0 for x in lines])
    content = {i for i in free if weighed[i] > bound and ratio[i] > 0} or {max(free, key=lambda i: weighed[i])}
    out: list[int] = []
    # Parts of the page: an article, or what lies between two articles.
    for article, group in groupby(free, key=lambda i: lines[i][3]):
        part = list(group)
        if article:
            out += part
            continue
        # Smoothing lifts the neighbours of long lines: a cluster begins and ends with a line that passes by itself.
        found = [k for k, i in enumerate(part) if i in content]
        own = [k for k in found if ratio[part[k]] > bound] or (found if len(content) == len(found) else [])
        if own:
            at = own[0]
            while at and lines[part[at - 1]][4] in HEADINGS:
                at -= 1
            out += part[at : own[-1] + 1]
    chosen = {lines[i][3] for i in content}
    if not chosen - {0}:
        # No article has a line above the bound: the longest one is kept with the regions outside.
        size: dict[int, int] = {}
        for i in free:
            size[lines[i][3]] = size.get(lines[i][3], 0) + len(lines[i][0]) * (lines[i][3] > 0)
        chosen.add(max(size, key=size.get))
    return "\n".join(lines[i][0] for i in out if not lines[i][3] or lines[i][3] in chosen)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        n = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points). Each row is worked on alone, in the scan's tasks."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(name(page_id).cast("long").alias("page_id"), name(url).cast("string").alias("url"), name(html).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
