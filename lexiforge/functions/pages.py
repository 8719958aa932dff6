"""Articles in HTML: a tree that recovers from mark-up as pages have it, their paragraphs with markers, definitions, look-ups by tag."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.markup import CITATION, DISPLAY, INLINE, ITEM

PARAGRAPHS = "addr string, index int, text string, n_words int, definition boolean, status string"
ELEMENTS = "addr string, index int, depth int, tag string, text string"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CELLS, _PARTS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
_IN_TABLE = _CELLS | _PARTS | {"tr", "caption", "colgroup", "col"}
_BLOCKS = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a start tag ends, if it is open above the nearest of the tags it can't reach beyond.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"} | _CELLS, **{c: _CELLS for c in _CELLS}, **{p: _PARTS | {"tr"} | _CELLS for p in _PARTS}}
_WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, **{t: {"table"} for t in _IN_TABLE}}


class _Tree(HTMLParser):
    """Builds elements; `repairs` counts what the mark-up left open, closed twice or put where it can't stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.open, self.repairs, self.seen = [self.root], 0, False

    def _text(self, data: str) -> None:
        node, below = self.open[-1], None
        if data.strip() and node.tag in ("table", "tr", *_PARTS):
            node, below = self._before_table()
        last = node[below - 1] if below else node[-1] if below is None and len(node) else None
        if last is None:
            node.text = (node.text or "") + data
        else:
            last.tail = (last.tail or "") + data

    def _before_table(self) -> tuple[ET.Element, int]:
        """Where content goes that stands in a table but in no cell: before the table."""
        self.repairs += 1
        at = max(i for i, n in enumerate(self.open) if n.tag == "table")
        return self.open[at - 1], list(self.open[at - 1]).index(self.open[at])

    def _end_open(self, tags: set, walls: set) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                del self.open[at:]
                return self._end_open(tags, walls)
            if self.open[at].tag in walls:
                return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen = True
        if tag == "html":
            self.root.attrib.update({k: v or "" for k, v in attrs})
            return
        if tag in _ENDS:
            self._end_open(_ENDS[tag], _WALLS[tag])
        if tag in _BLOCKS:
            self._end_open({"p"}, {"table", "td", "th", "button", "object"})
        node = ET.Element(tag, {k: v or "" for k, v in attrs})
        top = self.open[-1]
        if top.tag in ("table", "tr", *_PARTS) and tag not in _IN_TABLE and tag not in ("script", "style", "template"):
            parent, at = self._before_table()
            parent.insert(at, node)
        else:
            top.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            # Only elements of foreign mark-up may end themselves.
            if any(n.tag in ("math", "svg") for n in self.open):
                self.open.pop()
            else:
                self.repairs += 1

    def handle_endtag(self, tag: str) -> None:
        walls = _WALLS.get(tag, {"table"} if tag not in ("table", "body", "html") else set())
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.repairs += sum(n.tag not in ("p", "li", "dt", "dd", "option", "tr", "td", "th", *_PARTS) for n in self.open[at + 1 :])
                del self.open[at:]
                return
            if self.open[at].tag in walls:
                break
        self.repairs += tag not in VOID and tag not in ("html", "body")

    def handle_data(self, data: str) -> None:
        self.seen = self.seen or bool(data.strip())
        self._text(data)


def parse_html(raw: str | None) -> tuple[ET.Element | None, str]:
    """(root, status): good, recovered (mark-up was mended) or empty."""
    tree = _Tree()
    tree.feed(raw or "")
    tree.close()
    if not tree.seen:
        return None, "empty"
    left = [n for n in tree.open[1:] if n.tag not in ("body", "head", "p", "li", "dt", "dd", "option", "tr", "td", "th", *_PARTS)]
    return tree.root, "recovered" if tree.repairs or left else "good"


def flatten_html(node: ET.Element) -> str:
    """Text of an element: formulas, tables of equations, citations and item numbers as markers; other tables, scripts and styles leave only what follows them."""
    parts = [node.text or ""]
    for child in node:
        if child.tag == "math":
            parts.append({"inline": INLINE, "display": DISPLAY, "block": DISPLAY}.get(child.get("display", ""), ""))
        elif child.tag == "table":
            parts.append(DISPLAY if child.get("class") == "ltx_equation ltx_eqn_table" else "")
        elif child.tag == "cite":
            parts.append(CITATION)
        elif child.tag == "span" and node.get("class") == "ltx_item":
            parts.append(ITEM)
        elif child.tag not in ("script", "style"):
            parts.append(flatten_html(child))
        parts.append(child.tail or "")
    return re.sub(r"\s+", " ", "".join(parts))


def _holds(node: ET.Element, tag: str, css: str | None) -> bool:
    return node.tag == tag and (css is None or css in node.get("class", ""))


def _paragraphs(raw: str | None, tag: str, css: str | None) -> Iterator[tuple]:
    root, status = parse_html(raw)
    found = [] if root is None else [n for n in root.iter(tag) if _holds(n, tag, css)]
    if not found:
        yield None, None, None, None, status
        return
    defined = set()
    for theorem in root.iter("div"):
        if re.search(r"ltx_theorem_[definto]+$", theorem.get("class", "")):
            first = next((n for n in theorem.iter(tag) if _holds(n, tag, css)), None)
            defined.add(id(first))
    for i, node in enumerate(found):
        text = flatten_html(node).strip()
        yield i, text, len(text.split()), id(node) in defined, status


def html_paragraphs(articles: DataFrame, tag: str = "p", css: str | None = None) -> DataFrame:
    """(addr, index, text, n_words, definition, status) of the elements `tag`, with `css` in their class if given, of articles (addr, raw).

    definition: the first such element of a theorem of a defining kind. An article without any has one row of nulls and its status.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARAGRAPHS.split(", ")]
        for batch in batches:
            for addr, raw in zip(batch["addr"], batch["raw"]):
                frame = pd.DataFrame([(addr, *row) for row in _paragraphs(raw, tag, css)], columns=names)
                yield frame.astype({"index": "Int32", "n_words": "Int32", "definition": "boolean"})

    return articles.select(F.col("addr").cast("string").alias("addr"), "raw").mapInPandas(each, PARAGRAPHS)


def elements(articles: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(addr, index, depth, tag, text) of all elements of articles (addr, raw) in the order they begin; those of `skip` go with all below them. text is what stands before the first child."""

    def walk(node: ET.Element, depth: int) -> Iterator[tuple]:
        ahead = [(node, depth)]
        while ahead:
            node, depth = ahead.pop()
            if node.tag not in skip:
                yield depth, node.tag, (node.text or "").strip()
                ahead.extend((child, depth + 1) for child in reversed(node))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for addr, raw in zip(batch["addr"], batch["raw"]):
                root, _ = parse_html(raw)
                rows = [] if root is None else [(addr, i, *row) for i, row in enumerate(walk(root, 0))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENTS.split(", ")]).astype({"index": "int32", "depth": "int32"})

    return articles.select(F.col("addr").cast("string").alias("addr"), "raw").mapInPandas(each, ELEMENTS)


def page_pairs(articles: DataFrame) -> DataFrame:
    """(addr, title, definition) of pages (addr, raw): the first heading without "(mathematics)", in lower case, and the first paragraph after it; only where that holds the title."""
    of = elements(articles, skip=("script", "style", "head", "nav", "header", "footer", "aside"))
    heads = of.where("tag = 'h1' and text <> ''").groupBy("addr").agg(F.min(F.struct("index", "text")).alias("h"))
    title = F.lower(F.trim(F.regexp_replace("h.text", r"\(mathematics\)", "")))
    heads = heads.select("addr", title.alias("title"), F.col("h.index").alias("at"))
    paragraph = of.where("tag in ('p', 'b') and text <> ''").join(heads, "addr").where("index > at")
    first = paragraph.groupBy("addr", "title").agg(F.min(F.struct("index", "text"))["text"].alias("definition"))
    return first.where(F.contains(F.lower("definition"), F.col("title"))).select("addr", "title", "definition")


def site_style(url: Column) -> Column:
    """The rules a page goes by, from its host: wiki, stacks, or null for any other."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(F.contains(host, F.lit("wikipedia")) | F.contains(host, F.lit("subwiki")), "wiki").when(F.contains(host, F.lit("stacks.math")), "stacks")


def _classed(node: ET.Element, name: str) -> bool:
    return name in (node.get("class") or "").split()


def _site_pair(raw: str | None, style: str | None) -> tuple[str | None, str | None, str]:
    """(title, paragraph, status) of one page."""
    root, _ = parse_html(raw)
    if root is None or style is None:
        return None, None, "no style" if style is None else "empty"
    nodes = list(root.iter())
    if style == "wiki":
        head = next((n for n in nodes if n.get("id") == "firstHeading"), None)
        title = None if head is None else "".join(head.itertext()).replace("(mathematics)", "")
        begins = lambda n: n.tag == "span" and "definition" in (n.get("id") or "").lower()
    else:
        head = next((n for n in nodes if _classed(n, "tex-section")), None)
        title = None if head is None else ([t for t in head.itertext() if t] or [""])[-1]
        begins = lambda n: _classed(n, "env-definition")
    if title is None:
        return None, None, "no title"
    title = title.strip().lower()
    at = next((i for i, n in enumerate(nodes) if begins(n)), None)
    if at is None:
        return title, None, "no definition"
    paragraph = next((n for n in nodes[at + 1 :] if n.tag == "p"), None)
    if paragraph is None:
        return title, None, "no paragraph"
    text = "".join(paragraph.itertext())
    return title, text, "pair" if title in text.lower() else "no match"


def site_pairs(pages: DataFrame) -> DataFrame:
    """(addr, title, definition, status) of pages (addr, url, raw) by the rules of their sites: a title without its "(mathematics)", in lower case, and the first paragraph after the place that holds the definition.

    status is pair where the paragraph holds the title, else what is missing; pages of other sites and empty ones have a row too, so that none is skipped in silence.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(a, *_site_pair(r, s)) for a, r, s in zip(batch["addr"], batch["raw"], batch["style"])]
            yield pd.DataFrame(found, columns=["addr", "title", "definition", "status"]).astype(object)

    rows = pages.select(F.col("addr").cast("string").alias("addr"), "raw", site_style(F.col("url")).alias("style"))
    return rows.mapInPandas(each, "addr string, title string, definition string, status string")


# look-ups in XML, by Spark's own path functions


def tag_texts(raw: Column, tag: str) -> Column:
    """Texts of all elements of a tag, in order."""
    return F.xpath(raw, F.lit(f"//{tag}/text()"))


def italic_terms(raw: Column) -> Column:
    """Texts set in italics, the terms that a definition defines."""
    return F.xpath(raw, F.lit("//text[contains(@font, 'italic')]/text()"))


def tag_holds(raw: Column, tag: str, word: str, whole: bool = False) -> Column:
    """Whether the text of an element of a tag holds a word, or is it."""
    quote = '"' if "'" in word else "'"
    test = f"text() = {quote}{word}{quote}" if whole else f"contains(text(), {quote}{word}{quote})"
    return F.xpath_boolean(raw, F.lit(f"//{tag}[{test}]"))
