"""Articles in XML mark-up: paragraphs with markers, definitions, errors; macros with balanced braces; links."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed markers that take the place of mark-up in flattened text.
INLINE, DISPLAY, CITATION, ITEM = "_inline_math_", "_display_math_", "_citation_", "_item_"
PARAGRAPHS = "addr string, index int, text string, n_words int, error boolean, definition boolean, status string"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def flatten(node: ET.Element) -> str:
    """Text of an element: math, citations and items as markers; errors and reference tags go with what follows them."""
    parts = [node.text or ""]
    for child in node:
        kind, tail = _name(child), child.tail or ""
        if kind == "ERROR" or (kind == "tag" and child.get("role") in ("refnum", "typerefnum")):
            continue
        if kind == "Math":
            parts.append(f" {DISPLAY if child.get('mode') == 'display' else INLINE} ")
        elif kind == "cite":
            parts.append(f" {CITATION} ")
        elif kind == "item":
            parts.append(f" {ITEM} {flatten(child)}")
        elif kind == "break":
            parts.append(" ")
        elif kind:
            parts.append(flatten(child))
        parts.append(tail)
    return re.sub(r"\s+", " ", "".join(parts))


def parse(raw: str | None) -> tuple[ET.Element | None, str]:
    """(root, status): good, cleaned (illegal characters were taken out), empty or bad."""
    if raw is None or not raw.strip():
        return None, "empty"
    for text, status in ((raw, "good"), (_ILLEGAL.sub("", raw), "cleaned")):
        try:
            return ET.fromstring(text.encode("utf-8", "ignore") if text.lstrip().startswith("<?xml") else text), status
        except ET.ParseError:
            continue
    return None, "bad"


def _article(raw: str | None) -> Iterator[tuple]:
    root, status = parse(raw)
    if root is None:
        yield None, None, None, None, None, status
        return
    defined = set()
    for theorem in root.iter():
        if _name(theorem) == "theorem" and re.search(r"ltx_theorem_[definto]+$", theorem.get("class", "")):
            first = next((p for p in theorem.iter() if _name(p) == "para"), None)
            if first is not None:
                defined.add(id(first))
    for i, para in enumerate(p for p in root.iter() if _name(p) == "para"):
        text = flatten(para)
        yield i, text, len(text.split()), any(_name(x) == "ERROR" for x in para.iter()), id(para) in defined, status


def paragraphs(articles: DataFrame) -> DataFrame:
    """(addr, index, text, n_words, error, definition, status) of articles (addr, raw); one row of nulls where none can be read."""

    def each(batches):
        names = [c.split()[0] for c in PARAGRAPHS.split(", ")]
        for batch in batches:
            for addr, raw in zip(batch["addr"], batch["raw"]):
                frame = pd.DataFrame([(addr, *row) for row in _article(raw)], columns=names)
                yield frame.astype({"index": "Int32", "n_words": "Int32", "error": "boolean", "definition": "boolean"})

    return articles.select("addr", "raw").mapInPandas(each, PARAGRAPHS)


def definitions(articles: DataFrame, min_words: int = 15) -> DataFrame:
    return paragraphs(articles).where(F.col("definition") & ~F.col("error") & (F.col("n_words") >= min_words))


def without_macro(text: Column, macro: str) -> Column:
    """Text without \\macro{...}, whose braces may nest; an unclosed one stays."""
    opening = "\\" + macro + "{"

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(s):
            if s is None or opening not in s:
                return s
            out, at = [], 0
            while (start := s.find(opening, at)) >= 0:
                depth, i = 1, start + len(opening)
                while i < len(s) and depth:
                    depth += {"{": 1, "}": -1}.get(s[i], 0)
                    i += 1
                if depth:
                    break
                out.append(s[at:start])
                at = i
            return "".join(out) + s[at:]

        return texts.map(one)

    return cut(text)


def links(html: Column) -> Column:
    """Targets of the links of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def article_links(html: Column, must: str = "wiki", n: int | None = None) -> Column:
    """Targets that hold `must` and no sign of another kind of page; the first n if given."""
    kept = F.filter(links(html), lambda h: h.contains(must) & ~h.rlike(r"\?|#|File:|Help:|Special:|Portal:"))
    return kept if n is None else F.slice(kept, 1, n)


def title_contained(title: Column, text: Column) -> Column:
    return F.contains(F.lower(text), F.lower(F.trim(title)))
