"""Main-text extraction by smoothed text-to-tag ratios.

The standard library's parser streams events; they become lines, one for each block
of text, with its characters, tags and link characters.  Each line's text-to-tag
ratio (no more than a full paragraph's) is smoothed with a Gaussian over its
neighbours, and lines whose smoothed ratio reaches the threshold (the ratios' standard
deviation) form the content cluster.  If most of the cluster stands in articles, the
articles that hold some of it are the region.  Otherwise it is the innermost container
of most of it, and of all its lines that have a ratio of their own; around the former,
containers of links without a line of the cluster are left out.  All blocks of the
region are the text, but for those in page furniture (navigation, forms, asides,
adverts, comments, ...), by element or by the words of class, id and role.  Inside an
article, a word that may be its topic, or an id, counts only for blocks
of links or without a passing ratio.  A form, or a block that is furniture by name, may
still wrap the page: those around the article that has the fewest of them around it (without
an article, around the first heading of its kind, or those that hold most of the text) are kept, and with nothing
else left all are.

Defined results: a null or empty page has an empty text, so has one without text
outside furniture; markup that is cut off yields the text before, and behind a piece
that can't be parsed parsing goes on;
a null url or page_id is kept as it is; repeated rows are extracted one by one; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

SIGMA = 1.0
REGION_SHARE = 0.7
#: A ratio counts up to that of a full paragraph (characters for each tag).
PARAGRAPH = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s
samp small span strike strong sub sup time tt u var""".split())
REGIONS = frozenset("html body main article section div td center".split())
FURNITURE = frozenset("""nav footer aside button select textarea script style noscript template iframe svg canvas
object audio video head title dialog menu datalist optgroup option math""".split())
#: Words of class, id and role that mark furniture.
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored
sponsors promo promos promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe
subscription share sharing social related recommended recommendations comment comments commentlist respond replies
disqus sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead pagination
pager login signup search widget widgets toolbar skip complementary contentinfo alert""".split())
#: Words directly before which those describe a layout, not furniture.
LAYOUT_WORDS = frozenset("with has no without".split())
#: A wrapper of these parts that holds most of the page's text is not one of them.
WRAPPER_WORDS = frozenset("layout wrapper wrap container page".split())
PART_WORDS = frozenset("footer header masthead menu menus nav navbar navigation sidebar sidebars toolbar".split())
#: What readers say.
COMMENT_WORDS = frozenset("comment comments commentlist respond replies disqus".split())
COMMENT_PAIRS = frozenset((a, b) for a in ("reader", "readers", "user", "users") for b in ("discussion", "discussions", "feedback", "opinions", "reactions", "responses"))
#: Words that may name what an article is about; inside one they need evidence.
TOPIC_WORDS = frozenset("""advertisement advertising alert header login menu menus navigation promotion
recommendations related replies search share sharing social sponsors subscription widgets""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


class Mark:
    """A block that is furniture by name, if its content bears that out.  ``kind``: wrapper,
    topic, named, comment or form; ``depth`` and ``comments`` count the last three, and
    those of comments, from it outwards."""
    __slots__ = ("up", "kind", "titled", "depth", "comments")

    def __init__(self, up: int, kind: str, heading: bool, around: "Mark | None"):
        self.up, self.kind, self.titled = up, kind, heading
        self.depth = (around.depth if around else 0) + (kind in SOFT)
        self.comments = (around.comments if around else 0) + (kind == "comment")


SOFT = ("named", "comment", "form")


class Line:
    __slots__ = ("text", "links", "tags", "region", "furniture", "mark")

    def __init__(self, text: str, links: int, tags: int, region: int, furniture: bool, mark: int = -1):
        self.text, self.links, self.tags = text, links, tags
        self.region, self.furniture, self.mark = region, furniture, mark


class LineParser(HTMLParser):
    """Turns a page into lines.  ``stack`` holds open blocks only; an element is
    looked for by its count of open ones, so unclosed tags cost no search."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.names = [-1], ["html"]  # regions, 0 is the page
        self.stack: list[tuple[str, int, int, int]] = []  # name, region, depth of furniture, mark
        self.marks: list[Mark] = []
        self.mark = -1  # the innermost open one
        self.anchors: list[tuple[bool, int]] = []  # articles (or else titles) and the marks they are in
        self.open: dict[str, int] = {}
        self.region = self.furniture = self.tags = self.in_link = self.links = 0
        self.buffer: list[str] = []

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append(Line(text, self.links, max(1, self.tags), self.region, self.furniture > 0, self.mark))
                self.tags = 0
            self.buffer.clear()
            self.links = 0

    @staticmethod
    def is_furniture(attrs: list[tuple[str, str | None]], tag: str = "", in_article: bool = False) -> str:
        """"hidden"; "named", "comment", "wrapper" or "topic" if it depends on the content; "" if not."""
        found = ""
        for name, value in attrs:
            if name in ("class", "id", "role"):
                words, every = set(), set()
                for token in (value or "").lower().split():
                    parts = _SPLIT.split(token)
                    every.update(parts)
                    words.update(w for k, w in enumerate(parts) if w in FURNITURE_WORDS and not (k and parts[k - 1] in LAYOUT_WORDS))
                    if not COMMENT_PAIRS.isdisjoint(zip(parts, parts[1:])):
                        words.add("comments")
                if not words:
                    continue
                if in_article and (name == "id" and (tag in HEADINGS or not words & COMMENT_WORDS) or name == "class" and words <= TOPIC_WORDS):
                    found = found or "topic"
                elif words <= PART_WORDS and every & WRAPPER_WORDS:
                    found = found if found in ("named", "comment") else "wrapper"
                else:
                    found = "comment" if words & COMMENT_WORDS else "named"
            elif name == "hidden" or name == "aria-hidden" and value == "true" \
                    or name == "style" and re.search(r"display\s*:\s*none", value or ""):
                return "hidden"
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag == "a":
            self.in_link += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in INLINE:
            # An inline topic stays: its paragraph would be cut in pieces to judge it.
            heading = next((h for h in HEADINGS if self.open.get(h)), tag)
            if tag != "a" and self.is_furniture(attrs, heading, self.in_article()) in ("hidden", "named", "comment"):
                self.push(tag, True)
            return
        self.flush()
        if self.open.get("p"):
            self.pop("p")
        in_article = self.in_article()
        named = "" if tag in ("html", "body", "article", "main") else self.is_furniture(attrs, tag, in_article)
        self.push(tag, tag in FURNITURE or tag == "header" and not in_article or named == "hidden")
        named = "form" if tag == "form" and named not in ("comment", "named") else named
        if named not in ("", "hidden"):
            self.marks.append(Mark(self.mark, named, tag in HEADINGS, self.marks[self.mark] if self.mark >= 0 else None))
            self.mark = len(self.marks) - 1
        if tag == "h1" and self.mark >= 0:
            self.marks[self.mark].titled = True
        if tag in ("article", "main", "h1") and not self.furniture:
            self.anchors.append((tag == "h1", self.mark))
        if tag in REGIONS:
            self.parent.append(self.region)
            self.names.append(tag)
            self.region = len(self.parent) - 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def in_article(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def push(self, tag: str, mark: bool) -> None:
        if mark and tag in INLINE:
            self.flush()
        self.stack.append((tag, self.region, self.furniture, self.mark))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.furniture += mark

    def pop(self, tag: str) -> None:
        while True:
            name, self.region, self.furniture, self.mark = self.stack.pop()
            self.open[name] -= 1
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in INLINE and not self.open.get(tag):
            return
        self.flush()
        if self.open.get(tag):
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)
        if self.in_link:
            self.links += len(data)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):  # a marked section: to the next >, as browsers do
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)


def parse_lines(html: str) -> LineParser:
    parser, at = LineParser(), 0
    while True:
        try:
            parser.feed(html[at:])
            parser.close()
            break
        except (AssertionError, ValueError, RecursionError):
            # Broken markup: on behind the piece that the parser stopped at.
            line, column = parser.getpos()
            start = at
            for _ in range(line - 1):
                start = html.index("\n", start) + 1
            at = html.find("<", start + column + 1)
            parser.rawdata, parser.lineno, parser.offset = "", 1, 0
            parser.clear_cdata_mode()
            if at < 0:
                break
    parser.flush()
    return parser


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, weights normalised at the ends."""
    if len(ratio) < 2 or sigma <= 0:
        return ratio
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratio, kernel)[reach:reach + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[reach:reach + len(ratio)]


def content_blocks(html: str | None, sigma: float = SIGMA) -> list[str]:
    """The blocks of a page's main text, in order."""
    if not html:
        return []
    page = parse_lines(html)
    lines = page.lines
    if all(x.furniture for x in lines):
        return []
    judge_names(page)
    judge_marks(page, sigma)
    if all(x.furniture for x in lines):
        return []
    ratio, smoothed, limit = ratios(lines, sigma)
    cluster = [k for k, x in enumerate(lines) if not x.furniture and ratio[k] > 0 and smoothed[k] >= limit] \
        or [k for k, x in enumerate(lines) if not x.furniture]
    inside = content_regions(page, cluster, [k for k in cluster if ratio[k] >= limit / 2] or cluster)
    return [x.text for x in lines if inside[x.region] and not x.furniture]


def ratios(lines: list[Line], sigma: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Text-to-tag ratios, as they are and smoothed, and the content cluster's threshold."""
    ratio = np.array([0.0 if x.furniture else min(PARAGRAPH, max(0, len(x.text) - 2 * x.links) / x.tags) for x in lines])
    smoothed = smooth(ratio, sigma)
    return ratio, smoothed, smoothed.std()


def judge_names(page: LineParser) -> None:
    """Which forms and blocks named as furniture wrap the text; the others become furniture."""
    marks, lines = page.marks, page.lines
    if not any(m.kind in SOFT for m in marks):
        return
    kept = [False] * len(marks)
    if page.anchors:
        def around(anchor: tuple[bool, int]) -> tuple[bool, int, int]:
            title, m = anchor
            return (title, marks[m].comments, marks[m].depth) if m >= 0 else (title, 0, 0)

        m = min(page.anchors, key=around)[1]
        while m >= 0:
            kept[m], m = True, marks[m].up
    chars = [0] * len(marks)
    for x in lines:
        if x.mark >= 0 and not x.furniture:
            chars[x.mark] += len(x.text)
    for m in range(len(marks) - 1, -1, -1):
        if marks[m].up >= 0:
            chars[marks[m].up] += chars[m]
    every = sum(len(x.text) for x in lines if not x.furniture)
    articles = any(not title for title, _ in page.anchors)
    gone = [False] * len(marks)
    for m, mark in enumerate(marks):
        most = not articles and mark.kind != "comment" and chars[m] >= REGION_SHARE * every
        gone[m] = mark.kind in SOFT and not kept[m] and not most or mark.up >= 0 and gone[mark.up]
    left = [x for x in lines if not x.furniture and not (x.mark >= 0 and gone[x.mark])]
    if left:
        for x in lines:
            x.furniture = x.furniture or x.mark >= 0 and gone[x.mark]


def judge_marks(page: LineParser, sigma: float) -> None:
    """Decides what is furniture by name only if its content bears that out: wrappers of
    page parts, unless most of the text is in them; and topics inside an article, if they
    are mostly links or none of their lines has a passing ratio, but for titles."""
    marks, lines = page.marks, page.lines
    if not marks:
        return
    for wrapper in (True, False):
        ratio, _, limit = ratios(lines, sigma)
        chars, links, best, titled = ([0] * len(marks) for _ in range(4))
        for k, x in enumerate(lines):
            if x.mark >= 0 and not x.furniture:
                chars[x.mark] += len(x.text)
                links[x.mark] += x.links
                best[x.mark] = max(best[x.mark], ratio[k])
        for m in range(len(marks) - 1, -1, -1):  # a mark's number is larger than that around it
            up, titled[m] = marks[m].up, titled[m] or marks[m].titled
            if up >= 0:
                chars[up] += chars[m]
                links[up] += links[m]
                best[up], titled[up] = max(best[up], best[m]), titled[up] or titled[m]
        every = sum(len(x.text) for x in lines if not x.furniture)
        gone = [False] * len(marks)
        for m, mark in enumerate(marks):
            if mark.kind == ("wrapper" if wrapper else "topic"):
                gone[m] = chars[m] < REGION_SHARE * every if wrapper else \
                    not titled[m] and (2 * links[m] >= chars[m] or best[m] < limit / 2)
            gone[m] = gone[m] or mark.up >= 0 and gone[mark.up]
        for x in lines:
            x.furniture = x.furniture or x.mark >= 0 and gone[x.mark]


def content_regions(page: LineParser, cluster: list[int], plain: list[int]) -> list[bool]:
    """Which regions the text stands in; ``plain`` are the cluster's lines whose own
    ratio, not only their neighbours', tells them from headings and notes."""
    lines, parent, n = page.lines, page.parent, len(page.parent)
    article = [-1] * n  # the outermost article around a region
    for r in range(n):  # a region's number is larger than its parent's
        up = article[parent[r]] if r else -1
        article[r] = up if up >= 0 else r if page.names[r] in ("article", "main") else -1

    def total(of: list[int], worth) -> list[int]:
        votes = [0] * n
        for k in of:
            votes[lines[k].region] += worth(lines[k])
        for r in range(n - 1, 0, -1):
            votes[parent[r]] += votes[r]
        return votes

    def within(top: set[int]) -> list[bool]:
        found = [False] * n
        for r in range(n):
            found[r] = r in top or r > 0 and found[parent[r]]
        return found

    texts, seen = total(cluster, lambda x: len(x.text)), total(cluster, lambda x: 1)
    outer = {a for a in article if a >= 0}
    if sum(texts[a] for a in outer) >= REGION_SHARE * texts[0]:
        return within({a for a in outer if texts[a]})
    core = max(r for r in range(n) if texts[r] >= REGION_SHARE * texts[0])
    held, region, around = total(plain, lambda x: 1), core, {core}
    while held[region] < len(plain):
        region = parent[region]
        around.add(region)
    every = [k for k, x in enumerate(lines) if not x.furniture]
    chars, links = total(every, lambda x: len(x.text)), total(every, lambda x: x.links)
    in_core, found = within({core}), [False] * n
    for r in range(n):
        found[r] = r == region or r > 0 and found[parent[r]] and (
            in_core[r] or r in around or seen[r] > 0 or 2 * links[r] <= chars[r])
    return found


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n\n".join(content_blocks(h.as_py())) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row; blocks are joined by an empty line."""
    ready(pages.sparkSession)
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"{kinds}, text string")
