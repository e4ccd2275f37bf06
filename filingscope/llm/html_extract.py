"""Main text of web pages by the text-to-tag ratio of lines.

Standard-library parser events are turned, in one pass over the page, into lines: one
for each block of text, with the tags and link letters it holds and its container. Page
furniture by kind of element (menus, headers, footers, asides, controls of forms) never
becomes a line. The ratios of text to tags are smoothed over neighbouring lines by a Gaussian, and
a two-cluster threshold separates content lines from the rest. A form, or an element that its
class, id or role names as furniture, is dropped unless it holds the article or most of
the content lines; if furniture is only a part of the name, or the element is marked hidden, it is dropped if most of its
text isn't in content lines. The content region is the smallest container with nearly
all of the content lines' text, or the articles if they hold half of it; its lines are
the main text, but for link lists with ratios below the threshold. Time and memory grow
with the length of the page, however deep it is nested.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import bounded

#: Lines' standard deviation of the Gaussian, and the share of the content letters that the region must hold, if it is one of articles and if not.
SIGMA, ARTICLE_SHARE, REGION_SHARE = 1.5, 0.5, 0.9
#: A line of low ratio is a menu's if links hold more than this share of its letters; in an article, only with so many beside it.
LINK_SHARE, MENU_LINES = 0.6, 3
#: First piece of a page that the parser is fed; each further one is as long as all before it, so a construct that stays open is not read again and again.
FEED_CHARS = 1 << 16

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas audio video head title nav footer aside menu dialog button select textarea datalist search".split())
CLOSES_P = BLOCKS - {"li", "dd", "dt", "td", "th", "tr", "caption", "legend", "option", "optgroup", "summary"}
# An opening tag closes an open element of these kinds, up to the nearest of the stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words in class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist comment-list complementary consent contentinfo cookie cookies disqus dialog disclaimer feedback footer form gdpr header login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup popups promo promos promoted promotion recommended related replies reply respond reviews search share sharing shares sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tags teaser toc toolbar topbar tracking usercomments widget widgets".split()
)
# Those of them that name what readers write.
COMMENTS = frozenset("comment comments commentlist comment-list disqus replies respond reviews usercomments".split())
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<(?:[A-Za-z/!?]|$)")
_RAW = re.compile(r"<(/?)(script|style)\b", re.I)


CERTAIN, DOUBTFUL = 2, 1
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _named(attrs: list[tuple[str, str | None]]) -> int:
    """CERTAIN if a class, id or role is a furniture name or made of such words only, DOUBTFUL if one of its words is one, or 0."""
    found = 0
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for name in v.split():
                words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))]
                if name.lower() in FURNITURE or (words and all(w in FURNITURE for w in words)):
                    return CERTAIN
                if any(w in FURNITURE for w in words):
                    found = DOUBTFUL
    return found


def _readers(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class, id or role is a name for readers' comments."""
    return any(v and k in ("class", "id", "role") and any(n.lower() in COMMENTS for n in v.split()) for k, v in attrs)


# What an end tag of an inline element doesn't reach beyond, and what an implied end of a paragraph doesn't.
BARRIERS, P_STOPS = ("article", "body", "td", "table"), ("td", "th", "button", "table", "article", "section", "div", "li", "blockquote", "body")


class Lines(HTMLParser):
    """Collects a page's lines: text, tags, link letters and innermost container. Containers are numbered as they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.kinds: list[str] = ["#page"]  # kind of each container
        self.above: list[int] = [0]  # its container
        self.named: dict[int, tuple[int, bool]] = {}  # containers with a furniture name: how certain, and whether it is readers'
        self.open: list[tuple[str, int]] = []  # open elements and the containers that they are, or are in
        self.depths: dict[str, list[int]] = {}  # where elements of each kind are open
        self.skip = 0  # depth of the outermost open furniture
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.linked, self.open[-1][1] if self.open else 0))
                self.tags = self.linked = 0
            self.parts = []

    def innermost(self, kinds: Iterable[str]) -> int:
        """Depth of the innermost open element of the kinds, -1 without one."""
        return max((d[-1] for k in kinds if (d := self.depths.get(k))), default=-1)

    def pop_to(self, depth: int) -> None:
        """Close open elements until ``depth`` are left."""
        while len(self.open) > depth:
            tag = self.open[-1][0]
            if tag in BLOCKS and not self.skip:
                self.line()
            self.open.pop()
            self.depths[tag].pop()
            if self.skip > len(self.open):
                self.skip = 0

    def close_implied(self, kinds: Iterable[str], stops: Iterable[str]) -> None:
        depth = self.innermost(kinds)
        if depth >= 0 and depth > self.innermost(stops):
            self.pop_to(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.skip:
            self.tags += 1
        if tag in VOID:
            if not self.skip:
                if tag == "hr":
                    self.line()
                elif tag in ("br", "img"):
                    self.parts.append(" ")
            return
        if tag in CLOSES_P:
            self.close_implied(("p",), P_STOPS)
        if tag in IMPLIED:
            self.close_implied(*IMPLIED[tag])
        block, in_article = tag in BLOCKS, bool(self.depths.get("article"))
        if block and not self.skip:
            self.line()
        container = self.open[-1][1] if self.open else 0
        if block:
            self.kinds.append(tag)
            self.above.append(container)
            container = len(self.kinds) - 1
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, container))
        if self.skip:
            return
        nameless = tag in ("html", "body", "main", "p", "h1") or (tag == "article" and not in_article and not _readers(attrs))
        if tag in SKIPPED or (tag == "header" and not in_article):
            self.skip = len(self.open)
            if tag in ("iframe", "button"):
                self.parts.append(" ")
        elif tag == "form":
            self.named[container] = CERTAIN, _readers(attrs)  # one that is around the page's content stays
        elif attrs and not nameless:
            if not block and _named(attrs) == CERTAIN:
                self.skip = len(self.open)
            elif block and any(k == "hidden" for k, _ in attrs):
                self.named[container] = DOUBTFUL, False
            elif block and tag not in HEADINGS and (name := _named(attrs)):
                self.named[container] = name, _readers(attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if not self.skip:
            self.tags += 1
        depth = self.innermost((tag,))
        if depth < 0:
            if tag == "p" and not self.skip:
                self.line()
        elif tag in BLOCKS or depth > self.innermost(BARRIERS):
            self.pop_to(depth)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.depths.get("a"):
                self.linked += len(data)


def _whole(html: str) -> str:
    """The page without what its end leaves open: a comment, or a tag that is cut off."""
    begin = html.find("<!--", html.rfind("-->") + 1)
    if begin >= 0 and _in_data(html, begin):
        html = html[:begin]
    cut = _TAG.search(html, html.rfind(">") + 1)  # a tag that never closes
    return html[: cut.start()] if cut and _in_data(html, cut.start()) else html


def _in_data(html: str, at: int) -> bool:
    """Whether a place is outside scripts and styles, by the last of their tags before it."""
    before = None
    for before in _RAW.finditer(html, 0, at):  # noqa: B007
        pass
    return before is None or before.group(1) == "/"


def parse(html: str | None) -> Lines:
    page = Lines()
    html = _whole((html or "").replace("\0", ""))
    at, upto = 0, FEED_CHARS
    while at < len(html):
        page.feed(html[at:upto])
        at, upto = upto, 2 * upto
    page.close()
    page.pop_to(0)
    page.line()
    return page


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the edges the kernel is renormalised."""
    reach = min(math.ceil(3 * sigma), max(0, len(values) - 1))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The border of two clusters: the midpoint of their means, moved until it settles."""
    border = float(values.mean())
    for _ in range(100):
        high, low = values[values >= border], values[values < border]
        if not len(high) or not len(low):
            break
        moved = (float(high.mean()) + float(low.mean())) / 2
        if abs(moved - border) < 1e-9:
            break
        border = moved
    return border


class Region:
    """A page's lines with their letters, ratios and containers, and the choice among them."""

    def __init__(self, page: Lines):
        self.kinds, self.above = page.kinds, page.above
        self.texts = [x[0] for x in page.lines]
        self.letters = np.array([len(x[0]) for x in page.lines], dtype=float)
        tags, linked = (np.array([x[i] for x in page.lines], dtype=float) for i in (1, 2))
        self.at = [x[3] for x in page.lines]
        self.density = np.log1p(self.letters / np.maximum(1, tags))
        self.linked = linked > LINK_SHARE * self.letters
        self.kept = np.ones(len(self.texts), dtype=bool)
        self.mark()
        self.drop_named(page.named)

    def mark(self) -> None:
        """Content lines: those of the upper cluster of the smoothed ratios of the lines that are left."""
        ratios = smooth(self.density[self.kept])
        self.low, self.content = np.zeros(len(self.texts), dtype=bool), np.zeros(len(self.texts), dtype=bool)
        self.low[self.kept] = ratios < threshold(ratios)
        self.content = self.kept & ~self.low & ~self.linked
        if not self.content.any():
            plain = self.kept & ~self.linked
            self.content = plain if plain.any() else self.kept.copy()

    def below(self, values: np.ndarray) -> list[float]:
        """Sum of the lines' values in each container."""
        sums = [0.0] * len(self.kinds)
        for c, v in zip(self.at, values.tolist(), strict=True):
            sums[c] += v
        for c in range(len(sums) - 1, 0, -1):  # a container is numbered after the one that it is in
            sums[self.above[c]] += sums[c]
        return sums

    def inside(self, roots: set[int]) -> np.ndarray:
        """Lines in any of the containers."""
        within = [False] * len(self.kinds)
        for c in range(len(self.kinds)):
            within[c] = c in roots or (c > 0 and within[self.above[c]])
        return np.array([within[c] for c in self.at], dtype=bool)

    def path(self, c: int) -> set[int]:
        out = {0, c}
        while c:
            c = self.above[c]
            out.add(c)
        return out

    def outermost(self, kind: str) -> set[int]:
        """Containers of a kind that are in none of that kind."""
        within, out = [False] * len(self.kinds), set()
        for c, k in enumerate(self.kinds):
            over = c > 0 and within[self.above[c]]
            within[c] = over or k == kind
            if k == kind and not over:
                out.add(c)
        return out

    def drop_named(self, named: dict[int, tuple[int, bool]]) -> None:
        """Leave out the lines of named elements that are furniture."""
        if not named or not len(self.texts):
            return
        held, text = self.below(self.letters), self.below(self.letters * self.content)
        # The article: the longest outside any that is named itself; all that it stands in stays.
        first = max((c for c, k in enumerate(self.kinds) if k in ("article", "main") and c not in named and held[c]), key=lambda c: (held[c], -c), default=None)
        around, total = (self.path(first) if first is not None else {0}), text[0]
        gone = set()
        for c, (name, readers) in named.items():
            if c in around or not held[c]:
                continue
            if name != CERTAIN:
                drop = text[c] <= 0.5 * min(held[c], total)
            elif readers:
                drop = held[c] < held[0]
            else:
                drop = text[c] <= 0.5 * total or (first is not None and first not in self.path(c))
            if drop:
                gone.add(c)
        left = ~self.inside(gone)
        if left.any():
            self.kept = left
            self.mark()

    def chosen(self) -> np.ndarray:
        """The region's lines, without menus."""
        text = self.below(self.letters * self.content)
        total, held = text[0], self.below(self.letters * self.kept)
        menu = self.low & self.linked
        for kind in ("article", "main"):
            own = [c for c, k in enumerate(self.kinds) if k == kind and held[c]]
            outer = self.outermost(kind) & set(own)
            if outer and sum(text[c] for c in outer) >= ARTICLE_SHARE * total:
                links = self.below(self.letters * self.linked)
                region = {c for c in outer if links[c] <= 0.5 * held[c]} or outer
                runs = np.convolve(menu, np.ones(MENU_LINES), "full")
                starts = runs[MENU_LINES - 1 :] >= MENU_LINES  # as many menu lines from here on
                menu = np.convolve(starts, np.ones(MENU_LINES), "full")[: len(menu)] > 0
                return self.kept & self.inside(region) & ~menu
        wide = [c for c in range(len(text)) if text[c] >= REGION_SHARE * total and self.kinds[c] != "p" and self.kinds[c] != "li" and self.kinds[c] not in HEADINGS]
        return self.kept & self.inside({max(wide)}) & ~menu  # the innermost opened last


def main_text(html: str | None) -> str:
    """The page's main text: its blocks in order, one on each line; empty if there is none."""
    page = parse(html)
    if not page.lines:
        return ""
    region = Region(page)
    return "\n".join(t for t, chosen in zip(region.texts, region.chosen().tolist(), strict=True) if chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null page is empty; a page without a content line has an empty text. Any id or
    url may be null or repeat; extra columns are ignored; an empty table gives an empty
    result. Each page is read whole, and none needs another.
    """
    rows = pages.select(F.col(html_col).cast("string").alias("_html"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(bounded(_extract), rows.drop("_html").schema.add("text", "string").add("n_chars", "long"))
