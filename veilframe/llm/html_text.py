"""Main text of web pages from parser events and smoothed text-to-tag ratios.

Events of the standard library's streaming parser make lines, bounded by line
feeds of the page and by the edges of blocks. Each line has a text-to-tag ratio
without what is linked; a Gaussian smooths the ratios along the page, menus,
adverts and footers included, and the lines over a multiple of their deviation
are the content cluster. The regions that hold such lines, an article or main
element before a section or div, are the content, and are kept whole with the
lists and sections in them; so are regions that lie between them, or in an
article, unless most of their text is linked.

Marks only exclude: parts that are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments by their element or role, or
by a class or an id that names such a part and nothing else: each word of it is
a part's or only says where or what kind of box it is. In an article those names
count on sectioning elements, and on others only as the one class they have. A
wrapper is no part, whatever its name: one that holds all the articles and main
elements of the page, or where there are none, over half of the text.

Defined results: null and empty html and pages without content give "" and 0;
a page with text but no line in the cluster gives the region of the best line;
broken, unclosed and cut-off markup is read as far as it goes; rows are
independent, so repeated or null ids give a row each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.common import arrow_map, field

SIGMA = 1.0
LAMBDA = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that are regions of their own outside articles, and those whose names in class or id exclude them.
REGIONS = frozenset("article body div main section td".split())
SECTIONING = REGIONS | frozenset("aside details dl fieldset figure ol table ul".split())
#: Elements whose opening and closing are followed; the rest only bound blocks or words.
CONTAINERS = frozenset("article aside body center details dialog div dl fieldset figure footer form head header li main menu nav noscript ol search section table td template ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style noscript template iframe object svg canvas audio video map button select textarea option title".split())
AROUND = frozenset("nav aside footer header form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
#: Words for page parts in classes and ids; those of OUTSIDE count outside articles only.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle banner sponsor sponsored sponsors promo promos promotion promotions nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended recommendations pagination pager toolbar".split()
)
OUTSIDE = PARTS | frozenset("discussion trending popular skip copyright legal disclaimer header masthead topbar".split())
#: Words that say where a part is or what kind of box: a name may have them besides.
BOXES = frozenset(
    "site page main top bottom left right side primary secondary global mobile desktop sticky fixed user reader readers post posts article articles entry stories links link buttons button icons icon list lists item items body "
    "area section box block bar panel wrapper wrap container inner outer content form widget widgets slot unit zone group row col column bottombar thread title heading media js id".split()
)
#: What these words head is the text's own: article-header, post-title.
OF_TEXT = frozenset("article post entry content".split())
#: What excludes other elements of an article, as their only class.
ALONE = frozenset("ad ads advert adverts advertisement advertisements adsbygoogle sponsored notice notices comment comments".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=20_000)
def names_part(name: str, article: bool) -> bool:
    """Whether a class or an id names a page part and nothing else."""
    words = [w for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])|(?<=[a-z])(?=[0-9])", name) if w]
    words = [w.lower() for w in words if not w.isdigit()]
    parts = PARTS if article else OUTSIDE
    if not any(w in parts for w in words) or (words[0] in OF_TEXT and words[-1] in ("header", "content", "body")):
        return False
    return all(w in parts or w in BOXES for w in words)


#: No content for certain; an element of that kind, which may have been left open before an article; a name or a form, which may stand around a whole page.
HARD, KIND, SOFT = 3, 2, 1


def mark(tag: str, attrs: dict[str, str | None], article: bool) -> int:
    """Whether the element is no content: for certain, or by a name that a wrapper of the content may have as well."""
    if (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or HIDDEN.search(attrs.get("style") or ""):
        return HARD
    if tag in ("body", "html", "main"):
        return 0
    classes = (attrs.get("class") or "").split()
    if article and tag not in SECTIONING:
        return SOFT if len(classes) == 1 and classes[0].lower() in ALONE else 0
    names = [*classes, *(attrs.get("id") or "").split()]
    return SOFT if any(names_part(n, article) for n in names) else 0


class Blocks(HTMLParser):
    """Blocks of a page (text, link characters, region, in an article, mark), and its lines (characters, tags, link characters, block or -1).

    `marks` has for each marked element the mark around it, or 0, and its kind; `articles` the mark around
    each article and main element that has none itself.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        self.lines: list[tuple[int, int, int, int]] = []
        self.parts: list[str] = []
        self.open: list[tuple[int, int, int]] = []  # lines of the block at hand
        self.chars = self.tags = self.links = self.in_link = 0
        self.above = [-1]  # the region around each region
        self.marks: list[tuple[int, int]] = [(0, 0)]
        self.articles: list[int] = []
        self.stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]  # tag, region, in an article, mark, never text

    def end_line(self) -> None:
        if self.chars or self.tags:
            self.open.append((self.chars, self.tags, self.links))
            self.chars = self.tags = self.links = 0

    def flush(self) -> None:
        self.end_line()
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            _, region, article, part, _ = self.stack[-1]
            self.blocks.append((text, sum(x[2] for x in self.open), region, article, part))
        at = len(self.blocks) - 1 if text else -1
        self.lines += [(*x, at) for x in self.open]
        self.parts, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if self.stack[-1][0] == "p":  # a paragraph ends where the next block begins
                self.stack.pop()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link += 1
        if tag in VOID:
            return
        _, region, article, part, never = self.stack[-1]
        attrs = dict(attrs)
        marked = mark(tag, attrs, article)
        if tag in NEVER or marked or tag in CONTAINERS or tag == self.stack[-1][0]:
            if tag not in BLOCKS and (tag in NEVER or marked):
                self.flush()
            if tag in REGIONS and not article:
                self.above.append(region)
                region = len(self.above) - 1
            around = tag in AROUND and not (tag == "header" and article)
            if tag in NEVER or marked or around:
                self.marks.append((part, HARD if tag in NEVER or marked == HARD else KIND if around and tag != "form" else SOFT))
                part = len(self.marks) - 1
            elif tag in ("article", "main"):
                article = True
                self.articles.append(part)
            self.stack.append((tag, region, article, part, never or tag in NEVER))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag), 0)
        self.tags += 1
        if at and (tag in CONTAINERS or tag in NEVER or self.stack[-1][0] == tag):
            self.flush()
            del self.stack[at:]
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.stack[-1][4]:
            return
        self.parts.append(data)
        for i, piece in enumerate(data.split("\n")):
            if i:
                self.end_line()
            n = len(piece.strip())
            self.chars += n
            if self.in_link:
                self.links += n


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a normed Gaussian of three deviations either way, edges repeated."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def parse(html: str) -> Blocks:
    parser = Blocks()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError, IndexError):  # markup that the parser gives up on ends the page there
        pass
    parser.flush()
    return parser


def excluded(page: Blocks) -> list[bool]:
    """For each mark, whether what it is around is no content: not if it is around the content itself."""
    marks = page.marks

    def within(m: int) -> set[int]:
        out = set()
        while m:
            out.add(m)
            m = marks[m][0]
        return out

    certain = [False] * len(marks)
    for m in range(1, len(marks)):  # a mark lies behind the one around it
        certain[m] = marks[m][1] == HARD or certain[marks[m][0]]
    chars, every = [0] * len(marks), 0
    for text, _, _, _, m in page.blocks:
        if not certain[m]:
            every += len(text)
            chars[m] += len(text)
    for m in range(len(marks) - 1, 0, -1):
        chars[marks[m][0]] += chars[m]
    seen = [within(m) for m in page.articles if not certain[m]]
    around = set.intersection(*seen) if seen else {m for m in range(1, len(marks)) if marks[m][1] == SOFT and 2 * chars[m] > every}
    out = [False] * len(marks)
    for m in range(1, len(marks)):
        out[m] = out[marks[m][0]] or m not in around
    return out


def main_text(html: str, sigma: float = SIGMA, factor: float = LAMBDA) -> str:
    page = parse(html) if html else Blocks()
    blocks, gone = page.blocks, excluded(page)
    able = [not gone[b[4]] for b in blocks]
    if any(a and b[3] for a, b in zip(able, blocks, strict=True)):
        able = [a and b[3] for a, b in zip(able, blocks, strict=True)]
    if not any(able):
        return ""
    level = smooth(np.array([max(0, chars - 2 * links) / (1 + tags) for chars, tags, links, _ in page.lines], np.float64), sigma)
    threshold = factor * level.std()
    lines = [(x, b) for x, (*_, b) in zip(level.tolist(), page.lines, strict=True) if b >= 0 and able[b]]
    chosen = {blocks[b][2] for x, b in lines if x >= threshold and 2 * blocks[b][1] < len(blocks[b][0])}
    if not chosen:
        chosen = {blocks[max(lines)[1]][2]}
    # Regions with few words between those of the content, or in an article, belong to it unless they are links.
    at = [i for i, b in enumerate(blocks) if able[i] and b[2] in chosen]
    size, linked = {}, {}
    for i, b in enumerate(blocks):
        if able[i] and (b[3] or at[0] < i < at[-1]):
            size[b[2]], linked[b[2]] = size.get(b[2], 0) + len(b[0]), linked.get(b[2], 0) + b[1]
    chosen |= {r for r in size if 2 * linked[r] < size[r]}
    kept = []
    for region, above in enumerate(page.above):  # a region lies behind the one around it
        kept.append(region in chosen or above > 0 and kept[above])
    return "\n".join(b[0] for a, b in zip(able, blocks, strict=True) if a and kept[b[2]])


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, carried columns, text, n_chars) of every page."""

    def kernel():
        def work(part):
            texts = [main_text(h or "") for h in part.column(html_col).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return arrow_map(pages, [id_col, *carry], html_col, kernel, [field("text", T.StringType()), field("n_chars", T.LongType())])
