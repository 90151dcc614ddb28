"""HTML pages to sections.

A section is a heading with the text blocks below it, up to the next heading
that follows at least one block. Headings are h1 to h5; blocks are paragraphs,
list items and table rows, of which those nested in an item or row belong to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import lean

SECTIONS = "struct<error:string,sections:array<struct<heading:string,text:string,anchor:string,page:int>>>"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# What is cut from the landmark, the preferred body, headings and blocks.
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "form", "aside")
DROPPED_CLASSES = ("toc", "wb-toc")
BODY_CLASS = "field--name-body"
HEADINGS = ("h1", "h2", "h3", "h4", "h5")
BLOCKS = ("p", "li", "tr")


@dataclass(eq=False)
class _Node:
    tag: str
    attrs: dict[str, str]
    parent: _Node | None = None
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self):
        """Nodes below this one in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += reversed(c.children)
        return _clean(" ".join(x.strip() for x in out if x.strip()))

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {})

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str, landmark: str = "main", first: str = "Overview") -> list[dict]:
    """The sections of a page; ValueError without the landmark or without any text in it."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    main = next((n for n in builder.root.walk() if n.tag == landmark), None)
    if main is None:
        raise ValueError(f"no {landmark} landmark")
    for node in list(main.walk()):
        if node.tag in DROPPED_TAGS or any(c in DROPPED_CLASSES for c in node.classes):
            node.parent.children = [c for c in node.parent.children if c is not node]
    body = next((n for n in main.walk() if BODY_CLASS in n.classes), main)
    nested, out, heading, anchor, blocks = set(), [], first, None, []

    def close() -> None:
        if blocks:
            out.append({"heading": heading, "text": "\n\n".join(blocks), "anchor": anchor, "page": None})

    for node in body.walk():
        if node.parent in nested or (node.parent is not None and node.parent.tag in ("li", "tr") and node.parent is not body):
            nested.add(node)
        if node.tag not in HEADINGS and node.tag not in BLOCKS or node.tag in ("p", "li") and node in nested:
            continue
        if not (text := node.text()):
            continue
        if node.tag in BLOCKS:
            blocks.append(text)
            continue
        close()
        heading, blocks = text, []
        anchor = node.attrs.get("id") or node.parent.attrs.get("id") or None
    close()
    if not out:
        raise ValueError("no text in the landmark")
    return out


def with_sections(pages: DataFrame, html_col: str = "html", landmark: str = "main") -> DataFrame:
    """pages with ``parsed``: the sections, or why there are none. Null html is an error like a missing landmark."""
    lean(pages.sparkSession)

    @F.pandas_udf(SECTIONS)
    def run(html: pd.Series) -> pd.DataFrame:
        errors, sections = [], []
        for page in html:
            try:
                sections.append(parse(page or "", landmark))
                errors.append(None)
            except ValueError as e:
                sections.append(None)
                errors.append(str(e))
        return pd.DataFrame({"error": errors, "sections": sections})

    return pages.withColumn("parsed", run(F.col(html_col)))


def sections(pages: DataFrame, id_col: str, html_col: str = "html", landmark: str = "main") -> DataFrame:
    """One row per section: id, zero-based section number, heading, text, anchor, page. Pages in error have none."""
    parsed = with_sections(pages.select(id_col, html_col), html_col, landmark)
    # The plain posexplode would have the optimiser test the number of sections first, and so parse every page twice, in two workers.
    return parsed.select(id_col, F.posexplode_outer("parsed.sections").alias("section", "s")).where("section IS NOT NULL").select(id_col, "section", "s.*")
