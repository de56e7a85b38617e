"""HTML page table -> article rows.

Pages arrive as a ``pages(page_id, url, html)`` DataFrame; extraction is a
flat-map over them with ``mapInArrow`` (the only per-row Python step of
ingest, Arrow-batched and partitioned by Spark).  Site rules are *data*
(``ExtractRule``), so adding a site adds a rule, not code.  The Python part
only parses and selects; cleaning (F1), url defaults and absolutising (F10),
source constants (P1) are Catalyst expressions afterwards.

Parsing uses the standard library's ``html.parser`` (entities unescaped,
script/style text ignored, an open ``<p>`` closed by the next block start).
Selectors: a CSS subset -- ``tag``, ``.class``, ``[attr="v"]``, ``[attr]``,
compounds of those, and the descendant combinator (space).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import absolutize_url, clean_text
from ..session import ship_package, spread


@dataclass(frozen=True)
class ExtractRule:
    source: str
    base_url: str
    item: str
    title: str
    content: str | None
    category: str
    url: str | None = None          # selector of the link element; None = page url
    url_attr: str = "href"
    url_from_title: bool = False    # the link is the title element itself
    content_required: bool = True
    content_default: str | None = None
    content_all: bool = False       # join every match instead of the first
    absolutize: bool = False


# The two site rules of the crawler (selectors, defaults,
# categories, source names and base urls).
SITE_RULES = (
    ExtractRule(source="VnExpress", base_url="https://vnexpress.net", item="article.item-news",
                title="h3.title-news a", content="p.description a", category="News",
                url_from_title=True, content_required=True),
    ExtractRule(source="BBC", base_url="https://www.bbc.com", item='[data-testid="edgel"]',
                title="h2", content="p", category="World", url="a",
                content_required=False, content_default="No description", absolutize=True),
)

# Rule for the driver's generic pages: one <article> with an <h1> headline and
# <p> paragraphs; the page's own url is the article url.
PAGE_RULE = ExtractRule(source="web", base_url="", item="article", title="h1", content="p",
                        category="Web", content_all=True, content_required=False, content_default="")

EXTRACT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("item_pos", T.IntegerType()),
    T.StructField("rule", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("page_url", T.StringType()),
])

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
_CLOSES_P = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
             "table", "header", "footer", "nav", "aside", "blockquote", "pre", "form", "main"}
_NO_TEXT = {"script", "style"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        out: list[str] = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in _NO_TEXT:
                stack.extend(reversed(n.children))
        return "".join(out)

    def descendants(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, _Node):
                yield n
                stack.extend(reversed(n.children))


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.stack = [self.root]
        self.open_p = 0  # so that unclosed tags cost no search of the stack

    def _pop(self):
        self.open_p -= self.stack.pop().tag == "p"

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # a marked section: skipped to the next >
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and self.open_p:
            while self.stack[-1].tag != "p":
                self._pop()
            self._pop()
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)
            self.open_p += tag == "p"

    def handle_startendtag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


_COMPOUND = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)?((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$""")
_ATTR = re.compile(r"""\[\s*([\w-]+)\s*(?:=\s*["']?([^"'\]]*)["']?)?\s*\]""")


def _compile(selector: str):
    parts = []
    for comp in selector.split():
        m = _COMPOUND.match(comp)
        if not m:
            raise ValueError(f"unsupported selector: {selector!r}")
        tag, classes, attrs = m.groups()
        parts.append((tag, [c for c in classes.split(".") if c], _ATTR.findall(attrs)))
    return parts


def _matches(node: _Node, comp) -> bool:
    tag, classes, attrs = comp
    if tag and node.tag != tag.lower():
        return False
    if classes:
        have = node.attrs.get("class", "").split()
        if any(c not in have for c in classes):
            return False
    for name, value in attrs:
        if name not in node.attrs or (value and node.attrs[name] != value):
            return False
    return True


def _select(scope: _Node, parts) -> list[_Node]:
    out = []
    for node in scope.descendants():
        if not _matches(node, parts[-1]):
            continue
        i, anc = len(parts) - 2, node.parent
        while i >= 0 and anc is not None:
            if _matches(anc, parts[i]):
                i -= 1
            anc = anc.parent
        if i < 0:
            out.append(node)
    return out


def parse_page(html: str, rules: Sequence[ExtractRule]) -> list[tuple]:
    """``[(item_pos, rule_index, title, url, content)]`` for one page."""
    tb = _TreeBuilder()
    tb.feed(html or "")
    tb.close()
    rows = []
    for ri, rule in enumerate(rules):
        sel_title = _compile(rule.title)
        sel_content = _compile(rule.content) if rule.content else None
        sel_url = _compile(rule.url) if rule.url else None
        for pos, item in enumerate(_select(tb.root, _compile(rule.item))):
            t = _select(item, sel_title)
            if not t:
                continue
            cs = _select(item, sel_content) if sel_content else []
            if not cs and rule.content_required:
                continue
            if cs:
                content = " ".join(c.text() for c in cs) if rule.content_all else cs[0].text()
            else:
                content = rule.content_default
            if rule.url_from_title:
                url = t[0].attrs.get(rule.url_attr, "")
            elif sel_url is not None:
                links = _select(item, sel_url)
                url = links[0].attrs.get(rule.url_attr, "") if links else ""
            else:
                url = None
            rows.append((pos, ri, t[0].text(), url, content))
    return rows


def extract_articles(pages: DataFrame, rules: Sequence[ExtractRule] = SITE_RULES,
                     id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """S6/S7 + P1: one row per matched item of every rule, cleaned.

    Output: ``page_id, item_pos, title, url, content, category, source,
    source_url`` -- title/content whitespace-collapsed (F1), url defaulting to
    the page url for rules without a link selector, '/'-relative urls
    absolutised for rules that ask for it (F10).
    """
    rules = tuple(rules)
    ship_package(pages.sparkSession)  # workers import parse_page from this package

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.name for f in EXTRACT_SCHEMA.fields]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4]
        for batch in batches:
            out = [(pid, pos, ri, title, url, content, page_url)
                   for pid, page_url, html in zip(*(c.to_pylist() for c in batch.columns))
                   for pos, ri, title, url, content in parse_page(html, rules)]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    raw = spread(pages.select(F.col(id_col).cast("long"), url_col, html_col)).mapInArrow(run, EXTRACT_SCHEMA)
    spark = pages.sparkSession
    rule_df = spark.createDataFrame(
        [(i, r["source"], r["base_url"], r["category"], r["absolutize"]) for i, r in
         enumerate(asdict(x) for x in rules)],
        "rule int, source string, source_url string, category string, absolutize boolean")
    joined = raw.join(F.broadcast(rule_df), "rule")  # rules: a handful of rows, fixed by the caller
    url = F.coalesce(F.col("url"), F.col("page_url"), F.lit(""))
    url = F.when(F.col("absolutize"), absolutize_url(url, F.col("source_url"))).otherwise(url)
    return joined.select(
        "page_id", "item_pos", clean_text("title").alias("title"), url.alias("url"),
        clean_text("content").alias("content"), "category", "source", "source_url")
