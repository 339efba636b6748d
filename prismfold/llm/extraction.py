"""HTML extraction: text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; each block of text becomes a line with its number of text
characters and of tags. The ratio of the two is smoothed over neighbouring lines with a Gaussian kernel; lines at
or above a threshold (a share of the ratios' standard deviation) form clusters. The clusters select the region: of the
content elements (article, main, or an element whose class or id says so) the one with most clustered text; where none
has any, the smallest element that holds most of it. Lines that no cluster has belong to the region if its element
holds them, so that short paragraphs stay. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out by element, role, or class and id: a class counts only if all its parts name such a
thing or a mere container, so that `side-by-side` or `disclaimer text` keep their text.

Defined cases: null or empty html gives empty text; broken nesting is closed as browsers do for blocks; time is linear
in the page, however deep its nesting and however long; repeated rows each give their row; a column main_text is
replaced, others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from prismfold.llm.shared import text_batches, texts

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CHROME = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea head title menu dialog".split())
_CHROME_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement advertisements "
    "sponsor sponsored promo comment comments respond replies breadcrumb breadcrumbs pagination form".split()
)
_MERE_WORDS = frozenset("area bar block bottom box container global inner left list main outer page post primary reader right secondary section site slot top unit user wrap wrapper".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|story|entry|body|text)(?:$|[\s_-])", re.IGNORECASE)
#: An open element of these ends when one of the given tags starts.
_CLOSES = {
    "p": _BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


@lru_cache(maxsize=4096)
def _names_chrome(named: str, inside: bool) -> bool:
    """Whether a class or id is of what surrounds an article; a header inside an article is its own."""
    for token in named.lower().split():
        parts = {p for p in re.split(r"[_\W\d]+", token) if p}
        told = parts & _CHROME_WORDS
        if told and parts <= _CHROME_WORDS | _MERE_WORDS and not (inside and told == {"header"}):
            return True
    return False


class _Element:
    __slots__ = ("tag", "parent", "chrome", "content", "first", "last", "held")

    def __init__(self, tag: str, parent, attrs, first: int):
        self.tag, self.parent = tag, parent
        self.first, self.last, self.held = first, None, 0.0  # numbers of the elements from here to the last inside
        named = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        role = next((v for k, v in attrs if k == "role" and v), "").lower()
        inside = parent.content if parent else None
        self.content = self if tag in ("article", "main") or role in ("main", "article") else inside
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        marked = tag in _CHROME and not (tag == "header" and inside is not None) or role in _CHROME_ROLES or hidden
        if named and tag not in ("html", "body", "article", "main"):
            if _names_chrome(named, inside is not None):
                marked = True
            elif self.content is None and _CONTENT_WORDS.search(named):
                self.content = self
        self.chrome = marked or (parent.chrome if parent else False)

    def holds(self, other: _Element) -> bool:
        return self.first <= other.first and (self.last is None or other.first <= self.last)


class _Lines(HTMLParser):
    """Blocks of text in page order: (text pieces, tags, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, [], 0)
        self.made = [self.at]
        self.open: Counter = Counter()
        self.lines: list[tuple[str, int, _Element]] = []
        self.parts: list[str] = []
        self.tags = 0

    def _end_line(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.at))
                self.tags = 0
            self.parts = []

    def _leave(self):
        element = self.at
        if element.tag in _BLOCK or element.chrome:
            self._end_line()
        element.last = len(self.made) - 1
        self.open[element.tag] -= 1
        self.at = element.parent

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _BLOCK:
            self._end_line()
            if any(tag in closed and self.open[t] for t, closed in _CLOSES.items()):
                scope = self.at
                while scope.parent is not None and (scope.tag not in _BLOCK or tag in _CLOSES.get(scope.tag, ())):
                    if tag in _CLOSES.get(scope.tag, ()):
                        while self.at is not scope:
                            self._leave()
                        self._leave()
                        break
                    scope = scope.parent
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        made = _Element(tag, self.at, attrs, len(self.made))
        if made.chrome and not self.at.chrome:
            self._end_line()
        self.made.append(made)
        self.open[tag] += 1
        self.at = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.open[tag]:
            return
        scope = self.at
        while scope.parent is not None and scope.tag != tag:
            if scope.tag in _BLOCK and tag not in _BLOCK:
                return  # an inline end tag closes no block
            scope = scope.parent
        if scope.parent is None:
            return
        while self.at is not scope:
            self._leave()
        self._leave()

    def handle_data(self, data):
        if self.at.tag != "script" and self.at.tag != "style":
            self.parts.append(data)

    def finish(self, html: str) -> list[tuple[str, int, _Element]]:
        self.feed(html)
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios convolved with a Gaussian, weights renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach), kernel, "valid") / np.convolve(np.pad(np.ones_like(ratios), reach), kernel, "valid")


def clusters(high: np.ndarray) -> list[tuple[int, int]]:
    """The runs of lines at or above the threshold."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], high, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _region(made: list[_Element], lines: list[tuple[str, int, _Element]], size: np.ndarray, runs: list[tuple[int, int]]) -> _Element:
    """The element that the clustered lines select."""
    content: dict[_Element, float] = {}
    total = 0.0
    for start, end in runs:
        for (_, _, element), n in zip(lines[start:end], size[start:end]):
            element.held += n
            total += n
            if element.content is not None:
                content[element.content] = content.get(element.content, 0) + n
    if content:
        return max(content, key=lambda e: (content[e], -e.first))
    root = made[0]
    for element in reversed(made):  # what is inside an element comes behind it
        if element.held > 0.5 * total:
            root = element
            break
        if element.parent is not None:
            element.parent.held += element.held
    if root.tag in ("p", "li", *_HEADINGS) and root.parent is not None:  # a single block: its siblings belong to it
        root = root.parent
    return root


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """The main text of a page, one line a block."""
    if not html:
        return ""
    parsed = _Lines()
    lines = [(t, n, e) for t, n, e in parsed.finish(html) if not e.chrome]
    if not lines:
        return ""
    size = np.array([len(t) for t, _, _ in lines], float)
    ratio = smoothed(size / np.maximum(1, [n for _, n, _ in lines]), sigma)
    root = _region(parsed.made, lines, size, clusters(ratio >= min(ratio.max(), threshold * ratio.std())))
    return "\n".join(t for t, _, e in lines if root.holds(e))


def extract(pages: DataFrame, *, html_col: str = "html", sigma: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """The rows of `pages` with main_text in place of the html; one row a page, nothing is shuffled."""
    carried = [c for c in pages.columns if c not in (html_col, "main_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, sigma, threshold) for h in texts(batch, html_col)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(found, pa.string())], names=[*carried, "main_text"])

    text_batches(pages.sparkSession)
    given = pages.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{html_col}`"))
    schema = StructType([*(given.schema[c] for c in carried), StructField("main_text", StringType())])
    return given.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
