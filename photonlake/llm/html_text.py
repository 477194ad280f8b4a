"""Main text of web pages.

The standard library's parser streams tags and text into lines (one for each block element). Each line has the
ratio of its text to its tags; the ratios are smoothed by a Gaussian and split into two clusters by a
threshold. Lines above it, by their own ratio and by the smoothed one, are the seeds of the article: they choose
the region of the page that holds it, and each further line of the region stays or goes by its ratio, its links
and its place among the seeds. Elements whose meaning HTML itself defines (nav, aside, form, hidden and
the like) are left out; words in a class or id only weigh against what the ratios say.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import map_rows

# HTML elements by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas audio video head title select option datalist button textarea".split())
ASIDE = frozenset("nav aside footer header form dialog menu search".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTAINERS = frozenset("div section ul ol dl table article figure fieldset".split())
# Words of a class or id that speak against a container. The first have hardly another sense, the others have.
PLAIN_MARKS = frozenset("ad ads adsense advert advertisement advertising adverts breadcrumb breadcrumbs comments cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter popup sidebar sponsored".split())
VAGUE_MARKS = frozenset("aside banner comment consent copyright header hidden login notice notices overlay pager pagination promo promotion recommendations recommended related replies respond search share sharing side signup social sponsor subscribe subscription toolbar widget widgets".split())
COMMENT_MARKS = frozenset("comment comments disqus replies reply respond".split())
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_P_ENDS = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


@dataclass
class Line:
    """One block's text, the tags that opened or closed in it, whether it may be article text, the region it stands in and the marked containers around it."""

    text: str
    tags: int
    links: int
    fine: bool
    region: int
    marks: tuple[int, ...]
    heading: bool


@dataclass
class _Open:
    tag: str
    fine: bool
    silent: bool
    region: int
    marks: tuple[int, ...] = ()


def _left_out(own: dict[str, str]) -> bool:
    """Whether HTML itself says that an element isn't shown, or is no part of the text."""
    return "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES or bool(HIDDEN.search(own.get("style", "")))


def _weight(tag: str, own: dict[str, str]) -> int:
    """How much the names of a container speak against it: 3 for a plain mark alone, 2 for one in a compound, 1 for a vague one, 0 for none."""
    if tag not in CONTAINERS:
        return 0
    found = 0
    for name in f"{own.get('class', '')} {own.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if tag == "article":  # the element says more than its names, but for a reader's comment
            parts = [x for x in parts if x in COMMENT_MARKS]
            found = 3 if parts else found
        elif len(parts) == 1 and parts[0] in PLAIN_MARKS:
            found = 3
        elif PLAIN_MARKS.intersection(parts):
            found = max(found, 2)
        elif VAGUE_MARKS.intersection(parts):
            found = max(found, 1)
    return found


@dataclass
class Lines(HTMLParser):
    """Parser events as lines. Regions are the page, each article or main element, and, numbered alike, each other sectioning element."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", True, False, 0)]
        self.kinds = ["page"]
        self.parents = [0]
        self.weights: list[int] = []  # of the marked containers
        self.words: list[str] = []
        self.tags = self.link_chars = 0
        self.in_link = 0

    def updatepos(self, i, j):
        """Line numbers aren't needed."""
        return j

    def _end_line(self):
        if not self.words and not self.tags:
            return
        text = " ".join("".join(self.words).split())
        if text or self.tags:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, self.link_chars, top.fine, top.region, top.marks, any(o.tag in HEADING for o in self.stack[-4:])))
        self.words, self.tags, self.link_chars = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in SILENT:
            self._end_line()
        if tag in _P_ENDS:
            self._close("p", _P_ENDS - {"p"})
        if tag in _SAME:
            for other in {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)):
                self._close(other, _SAME[tag])
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        top = self.stack[-1]
        own = {k: v or "" for k, v in attrs}
        fine = top.fine and tag not in ASIDE and not _left_out(own)
        region, marks = top.region, top.marks
        if own and (weight := _weight(tag, own)):
            self.weights.append(weight)
            marks = (*marks, len(self.weights) - 1)
        if tag in ("article", "main", "section", "div", "td", "body"):
            self.kinds.append(tag)
            self.parents.append(region)
            region = len(self.kinds) - 1
        # A heading in the header of an article is the article's own.
        if tag in HEADING and not fine and self.stack[-1].tag in ("header", "hgroup") and any(o.tag in ("article", "main") for o in self.stack):
            fine = next(o for o in reversed(self.stack) if o.tag in ("article", "main")).fine
        self.stack.append(_Open(tag, fine, top.silent or tag in SILENT, region, marks))
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag == "svg" or self.stack[-1].silent):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK or tag in SILENT:
            self._end_line()
        self._close(tag, {"td", "th", "table"} if tag in ("p", "li", "div", "span", "b", "i", "a") else set())

    def _close(self, tag, barrier):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._end_line() if tag in BLOCK or tag in SILENT else None
                self.in_link -= sum(o.tag == "a" for o in self.stack[k:])
                inline = [o for o in self.stack[k + 1 :] if o.tag not in BLOCK and o.tag not in SILENT] if tag == "p" else []
                top = self.stack[k - 1]
                del self.stack[k:]
                self.stack += [_Open(o.tag, top.fine, o.silent, top.region, top.marks) for o in inline if o.tag in ("b", "i", "em", "strong", "u", "span", "font", "small")][:8]
                return
            if self.stack[k].tag in barrier:
                return

    def handle_data(self, data):
        if not self.stack[-1].silent:
            self.words.append(data)
            if self.in_link > 0:
                self.link_chars += len(data.strip())

    def unknown_decl(self, data):
        """Marked sections such as CDATA have no text."""


def lines_of(html: str | None) -> Lines:
    """All lines of a page; a tag cut off at its end is left out."""
    parser = Lines()
    if html:
        cut = html.rfind("<")
        if cut >= 0 and re.match(r"<[a-zA-Z/!?][^>]*\Z", html[cut:]):
            html = html[:cut]
        parser.feed(html)
        parser.close()
    parser._end_line()
    return parser


def own_ratios(lines: list[Line]) -> np.ndarray:
    """Text-to-tag ratio of each line; link text isn't counted."""
    return np.array([max(0, len(x.text) - x.links) / max(1, x.tags) for x in lines])


def smoothed(raw: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Ratios smoothed by a Gaussian."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(raw, kernel / kernel.sum())[reach : reach + len(raw)]


def threshold(values: np.ndarray) -> float:
    """Border of two clusters of values: the mean of their means, until it stays."""
    border = float(values.mean())
    for _ in range(50):
        low, high = values[values < border], values[values >= border]
        if not len(low) or not len(high):
            break
        if abs((now := (low.mean() + high.mean()) / 2) - border) < 1e-9:
            break
        border = float(now)
    return border


def blocks_of(html: str | None) -> list[str]:
    """The article's blocks, each with single spaces, in page order.

    A line is rich if both its ratio and its smoothed ratio lie in the upper cluster. Seeds are the rich lines outside marked containers (without such, all rich
    lines; without those, all lines). The region is the page's article and main elements, all of them, if they hold at least half of the seeds' text; else the smallest container that
    holds all seeds (there, article elements are teasers or the like). Of its lines go

    * those of a marked container for which too little speaks: one for mostly rich text, one for a place among the seeds, one against for many links, less its weight;
    * outside article elements, links in a row of three or more, and before the first and after the last seed poor lines that are links or
      stand in a container without any seed (headings stay).
    """
    page = lines_of(html)
    lines = page.lines
    shown = [i for i, x in enumerate(lines) if x.fine and x.text]
    if not shown:
        return []
    raw = own_ratios(lines)
    smooth = smoothed(raw)
    rich = (raw >= threshold(raw)) & (smooth >= threshold(smooth))
    seeds = [i for i in shown if rich[i] and not lines[i].marks] or [i for i in shown if rich[i]] or shown
    dropped = _against(page, shown, rich, seeds)
    shown = [i for i in shown if dropped.isdisjoint(lines[i].marks)]
    seeds = [i for i in seeds if dropped.isdisjoint(lines[i].marks)] or shown
    if not shown:
        return []
    held = sorted({lines[i].region for i in seeds})
    articles = {r for r in range(1, len(page.kinds)) if page.kinds[r] in ("article", "main")}
    own = {r for r in held if _within(page.parents, r, articles)}
    if 2 * sum(len(lines[i].text) for i in seeds if lines[i].region in own) >= sum(len(lines[i].text) for i in seeds):
        return [lines[i].text for i in shown if _within(page.parents, lines[i].region, articles)]
    # The region must hold every seed: no share of them is given up.
    chosen = held[0]  # the innermost that holds all
    while not all(_within(page.parents, r, {chosen}) for r in held):
        chosen = page.parents[chosen]
    inside = [i for i in shown if _within(page.parents, lines[i].region, {chosen})]
    linked = [not rich[i] and lines[i].links > 0.8 * len(lines[i].text) for i in inside]
    stay = []
    for k, i in enumerate(inside):
        row = any(all(linked[j : j + 3]) for j in range(max(0, k - 2), min(k, len(inside) - 3) + 1))
        edge = not seeds[0] <= i <= seeds[-1] and not rich[i] and not lines[i].heading
        apart = not any(_within(page.parents, r, {lines[i].region}) for r in held)
        if not row and not (edge and (linked[k] or apart)):
            stay.append(lines[i].text)
    return stay


def _against(page: Lines, shown: list[int], rich: np.ndarray, seeds: list[int]) -> set[int]:
    """The marked containers that go."""
    lines, out = page.lines, set()
    size = lambda some: sum(len(lines[i].text) for i in some)
    for mark, weight in enumerate(page.weights):
        own = [i for i in shown if mark in lines[i].marks]
        if not own:
            continue
        other = [i for i in seeds if mark not in lines[i].marks]
        among = other and other[0] < own[0] and own[-1] < other[-1] or 2 * size(set(seeds).intersection(own)) > size(seeds)
        mostly_rich = 2 * size(i for i in own if rich[i]) >= size(own)
        linked = 3 * sum(lines[i].links for i in own) >= size(own)
        if mostly_rich + bool(among) - linked < weight:
            out.add(mark)
    return out


def _within(parents: list[int], region: int, of: set[int]) -> bool:
    while region not in of:
        if region == 0:
            return False
        region = parents[region]
    return True


def main_text(html: str | None) -> str:
    """The blocks joined by empty lines; empty for null or a page without text."""
    return "\n\n".join(blocks_of(html))


def whole_text(html: str | None) -> str:
    """Every line of text of a page, menus and the like included, one below the other."""
    return "\n".join(x.text for x in lines_of(html).lines if x.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row, repeated rows included. Null and empty html, and pages without text, have empty text; null ids and urls
    stay null; an empty table gives no rows. Other columns are neither read nor returned."""

    def rows(part):
        texts = [main_text(h) for h in part["html"]]
        yield {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), rows, "page_id long, url string, text string, n_chars long", slices=200)
