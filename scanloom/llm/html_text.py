"""Main text of web pages by the text-to-tag ratio of their lines.

The standard library's parser streams a page as events; block-level tags cut it into lines. A line's ratio is
its characters by its tags. Ratios are smoothed with a Gaussian, so that a short paragraph between long
ones keeps their company, and two clusters are cut at the threshold between their means. The lines of the
upper cluster vote for the element that holds the content; its lines are the text, short ones included, less
what the markup itself calls navigation, advertising, forms or comments.

The method outranks the markup: all lines are clustered first, and an element's mark counts for nothing when the
element holds the main element, the article or most of what the upper cluster has besides other marked text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_columns

SIGMA = 1.0
RADIUS = 2
#: Share of the upper cluster's characters that an element must hold to be the content.
SHARE = 0.9
#: Share from which an article or main element is the content.
ARTICLE_SHARE = 0.5
#: Share of a line's characters in links from which it is a menu, where it stands at an edge of the content.
LINK_SHARE = 0.5
#: Share of the upper cluster, other marked text apart, from which a layout mark counts for nothing; others need SHARE.
LAYOUT_SHARE = 0.5

#: Fixed values of HTML: elements without end tag, elements that start a line, and what is never content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - {"body", "html"}
NEVER = frozenset("script style template head title iframe".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements and roles that are not content, unless the method finds the content inside.
MARKED = frozenset("noscript nav footer aside button select textarea object svg canvas audio video menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
#: Words of a class or id that mark what is not content: parts of a layout, which wrappers are also named after,
LAYOUT = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget banner "
    "overlay pagination pager skip toolbar".split()
)
#: and text of others.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion notice cookie cookies "
    "consent gdpr popup modal newsletter subscribe signup login share sharing social related recommended comment "
    "comments commentlist disqus reply replies respond".split()
)
#: Words before a mark that make it a state of the page, and words that make a header one of the content.
STATES = frozenset("has no not with without".split())
OF_CONTENT = frozenset("article content entry post story".split())
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
#: White space of HTML, which one space replaces inside a line.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")


class Lines(HTMLParser):
    """Lines of a page: pieces of text (the mark they stand under, whether in a link), tags since the line before, and
    the element around. Elements and marks know the one around them, so depth costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []
        self.kinds = ["page"]
        self.parents = [-1]
        #: Marks by number: by a part of the layout or not, by the tag or not; and the mark around, -1 for none.
        self.marks: list[tuple[bool, bool]] = []
        self.mark_parents: list[int] = []
        #: The mark around each article and main element.
        self.around: dict[int, int] = {}
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.names: Counter[str] = Counter()
        self.hidden = 0
        self.element, self.under = 0, -1
        self._pieces: list[tuple[str, int, bool]] = []
        self._tags = 0

    def _flush(self) -> None:
        pieces, self._pieces = self._pieces, []
        if any(text.strip(WHITE) for text, _, _ in pieces):
            self.lines.append((pieces, self._tags, self.element))
            self._tags = 0

    def _mark(self, tag: str, attrs) -> tuple[bool, bool] | None:
        if tag in MARKED:
            return False, True
        if tag == "form":
            return True, False
        inside = self.names["article"] + self.names["main"] > 0
        if tag == "header":
            return None if inside else (True, False)
        if tag in ("html", "body", "article", "main"):
            return None
        known = dict(attrs)
        names: set[str] = set()
        for word in f"{known.get('class') or ''} {known.get('id') or ''}".split():
            parts = [part.lower() for part in NAME_PARTS.findall(word)]
            found = {part for before, part in zip(["", *parts], parts) if before not in STATES}
            names |= found - {"header"} if inside or not OF_CONTENT.isdisjoint(parts) else found
        if not FOREIGN.isdisjoint(names) or "hidden" in known or known.get("aria-hidden") == "true":
            return False, False
        if not LAYOUT.isdisjoint(names) or (known.get("role") or "").lower() in ROLES:
            return True, False
        return None

    def _pop(self, to: int) -> None:
        for name, never, is_element, marked in reversed(self.open[to:]):
            self.names[name] -= 1
            self.hidden -= never
            if is_element:
                self.element = self.parents[self.element]
            if marked:
                self.under = self.mark_parents[self.under]
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        if tag in BLOCK:
            self._flush()
            if tag in ENDS_PARAGRAPH:
                for at in range(len(self.open) - 1, -1, -1):
                    if self.open[at][0] == "p":
                        self._pop(at)
                        break
                    if self.open[at][0] in BLOCK:
                        break
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                self._close_sibling(tag)
        self._tags += 1
        if tag == "br":
            self._pieces.append((" ", self.under, False))
        if tag in VOID:
            return
        mark = self._mark(tag, attrs)
        if mark:
            self.mark_parents.append(self.under)
            self.under = len(self.marks)
            self.marks.append(mark)
        never = tag in NEVER
        is_element = tag in BLOCK and tag != "p"
        if is_element:
            self.parents.append(self.element)
            self.element = len(self.kinds)
            self.kinds.append(tag)
            if tag in ("article", "main"):
                self.around[self.element] = self.under
        self.hidden += never
        self.names[tag] += 1
        self.open.append((tag, never, is_element, mark is not None))

    def _close_sibling(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag or {name, tag} == {"dt", "dd"} or {name, tag} == {"td", "th"}:
                return self._pop(at)
            if name in ("ul", "ol", "dl", "table", "tbody", "select", "menu", "div", "section", "article"):
                return None
        return None

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._flush()
        if not self.names[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            # An inline end tag does not close the block around it.
            if tag not in BLOCK and self.open[at][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._pieces.append((data, self.under, self.names["a"] > 0))

    def close(self) -> None:
        super().close()
        self._flush()


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to the upper of two clusters of the smoothed ratios."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(ratios, RADIUS, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    low, high = smooth.min(), smooth.max()
    while high > low:
        upper = smooth >= (low + high) / 2
        means = smooth[~upper].mean(), smooth[upper].mean()
        if means == (low, high):
            break
        low, high = means
    return smooth >= (low + high) / 2


def summed_up(own: list[float], parents: list[int]) -> list[float]:
    """Sums over everything inside; what is around has a smaller number."""
    out = list(own)
    for at in range(len(out) - 1, 0, -1):
        if parents[at] >= 0:
            out[parents[at]] += out[at]
    return out


def inside_of(chosen: set[int], parents: list[int]) -> list[bool]:
    """Which numbers are chosen or inside a chosen one."""
    out: list[bool] = []
    for at, parent in enumerate(parents):
        out.append(at in chosen or (parent >= 0 and out[parent]))
    return out


Line = tuple[str, int, int, float]


def without(page: Lines, marks: set[int]) -> list[Line]:
    """Text, tags, element and share in links of the lines that have text outside ``marks``; tags of the others go
    to the next one."""
    dropped = [*inside_of(marks, page.mark_parents), False]  # the last one is for no mark, -1
    left, tags = [], 0
    for pieces, n, element in page.lines:
        tags += n
        kept = [(text, linked) for text, under, linked in pieces if not dropped[under]]
        text = SPACE.sub(" ", "".join(t for t, _ in kept)).strip(WHITE)
        if text:
            links = sum(len("".join(t.split())) for t, linked in kept if linked)
            left.append((text, tags, element, links / max(1, len("".join(text.split())))))
            tags = 0
    return left


def upper_lines(lines: list[Line]) -> np.ndarray:
    sizes = np.array([len(text) for text, *_ in lines], float)
    return content_lines(sizes / np.array([max(1, tags) for _, tags, *_ in lines], float))


def honoured(page: Lines) -> set[int]:
    """Marks of elements that do not hold the content. Large elements come first, so one before those inside it; text
    of other marked ones is left out of the comparison, unless their marks count for nothing too."""
    marks = set(range(len(page.marks)))
    if not marks:
        return marks
    every = without(page, set())
    upper = upper_lines(every)
    own, own_marked = [0] * len(page.kinds), [0] * len(page.marks)
    for (pieces, _, element), (text, *_), up in zip(page.lines, every, upper):
        if not up:
            continue
        own[element] += len(text)
        for piece, under, _ in pieces:
            if under >= 0:
                own_marked[under] += len(SPACE.sub(" ", piece).strip(WHITE))
    sizes, held = summed_up(own, page.parents), summed_up(own_marked, page.mark_parents)
    elements = {e: sizes[e] for e in page.around}
    article = max((e for e in elements if page.kinds[e] == "article"), key=elements.get, default=None)
    around_main: set[int] = set()
    around_article: set[int] = set()

    def add_all(mark: int, to: set[int]) -> None:
        while mark >= 0 and mark not in to:
            to.add(mark)
            mark = page.mark_parents[mark]

    for element, size in elements.items():
        if size and (page.kinds[element] == "main" or size >= ARTICLE_SHARE * sizes[0]):
            add_all(page.around[element], around_main)
        elif size and element == article:
            add_all(page.around[element], around_article)
    clean = without(page, marks)
    outside = sum(len(text) for (text, *_), up in zip(clean, upper_lines(clean)) if up) if clean else 0
    two = not upper.all()
    free = [False] * len(page.marks)
    for mark in sorted(marks, key=lambda m: (-held[m], m)):
        layout, by_tag = page.marks[mark]
        most = held[mark] and held[mark] >= (LAYOUT_SHARE if layout else SHARE) * (held[mark] + outside)
        if mark in around_main or layout and mark in around_article or most and (two or not by_tag):
            marks.discard(mark)
            parent = page.mark_parents[mark]
            free[mark] = parent < 0 or free[parent]
            if free[mark]:
                outside += own_marked[mark]
    return marks


def without_menus(lines: list[Line], upper: list[bool]) -> list[Line]:
    """Less the lines of the lower cluster at the beginning and the end that are mostly links."""
    def is_menu(at: int) -> bool:
        return not upper[at] and lines[at][3] >= LINK_SHARE

    start, end = 0, len(lines)
    while start < end and is_menu(start):
        start += 1
    while start < end and is_menu(end - 1):
        end -= 1
    return lines[start:end]


def main_text(html: str | None) -> str:
    """Text of the content of one page, a line per block; empty for a null, empty or textless page.

    Character references are decoded, white space in a block is one space, and a page that ends inside a tag
    loses only that tag. Nothing else is dropped or cut. Time grows with the length of the page, however deep its
    elements are.
    """
    page = Lines()
    page.feed(CUT_TAG.sub("", html or ""))
    page.close()
    lines = without(page, honoured(page))
    if not lines:
        return ""
    upper = upper_lines(lines)
    own = [0.0] * len(page.kinds)
    for (text, _, element, _), up in zip(lines, upper):
        if up:
            own[element] += len(text)
    votes = summed_up(own, page.parents)
    total = votes[0]
    articles = [e for e, v in enumerate(votes) if v and page.kinds[e] in ("article", "main") and v >= ARTICLE_SHARE * total]
    # Elements are numbered in page order, so a parent has a smaller number than what it holds.
    chosen = min(articles) if articles else max(e for e, v in enumerate(votes) if v and v >= SHARE * total)
    there = inside_of({chosen}, page.parents)
    kept = [(line, bool(up)) for line, up in zip(lines, upper) if there[line[2]]]
    return "\n".join(text for text, *_ in without_menus([line for line, _ in kept], [up for _, up in kept]))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    Repeated rows stay repeated, nulls in page_id and url are passed on, other columns are ignored, an empty table
    gives no rows. Pages of any length are read whole.
    """

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        for rows in slices:
            texts = [main_text(h) for h in rows["html"]]
            yield {
                "page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]
            }

    kept = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return map_columns(kept, work, "page_id long, url string, text string, n_chars long", rows=64)
