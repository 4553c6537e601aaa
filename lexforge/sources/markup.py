"""Paragraphs and titles of XHTML and of broken HTML.

The reader does not fail: what is no tag is text, an unknown entity stays as it is, an end tag without a start is ignored,
and what was not closed ends with what holds it. Elements are not closed by others that begin, as HTML would have it.
"""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.words import slices

# Kinds of elements.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset(("br", "hr", "img"))
DROPPED = frozenset(("script", "style"))
_ROOT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ENTITY = re.compile(r"&(#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);")
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))")


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # elements and strings


def decode(text: str) -> str:
    """Entities as characters; those that do not exist, and a bare ``&``, as they are."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return html.entities.html5.get(name + ";", m[0])
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def events(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(``text``, text, {}), (``start``, name, attributes), (``end``, name, {}) and (``empty``, name, attributes), names without prefixes."""
    at, skip = 0, ""
    for m in _ROOT.finditer(source):
        if m.start() > at and not skip:
            yield "text", decode(source[at : m.start()]), {}
        at = m.end()
        name = (m[2] or "").rpartition(":")[2].lower()
        if skip:
            if m[1] == "/" and name == skip:
                skip = ""
            continue
        if not name:
            continue
        if m[1]:
            yield "end", name, {}
            continue
        attributes = {k.lower(): decode(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        closed = m[3].rstrip().endswith("/")
        if name in DROPPED:
            skip = "" if closed else name
            continue
        yield ("empty" if closed or name in VOID else "start"), name, attributes
    if at < len(source) and not skip:
        yield "text", decode(source[at:]), {}


def tree(source: str) -> Element:
    root = Element("")
    open_ = [root]
    for kind, value, attributes in events(source):
        if kind == "text":
            open_[-1].children.append(value)
        elif kind == "end":
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == value:
                    del open_[k:]
                    break
        else:
            element = Element(value, attributes)
            open_[-1].children.append(element)
            if kind == "start":
                open_.append(element)
    return root


def text_of(element: Element) -> str:
    """All text of an element: line breaks, rules and images are spaces, and blocks inside are set off by spaces."""
    out: list[str] = []
    todo: list = [*reversed(element.children)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name in SPACED:
            out.append(" ")
        elif x.name in BLOCKS:
            out.append(" ")
            todo += [" ", *reversed(x.children)]
        else:
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def _own_text(element: Element) -> bool:
    """Has it text that no block inside it holds?"""
    todo = [*element.children]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        elif x.name not in BLOCKS:
            todo += x.children
    return False


def paragraphs(root: Element) -> list[tuple[str, str]]:
    """(element, text) of the blocks that have text of their own; what is in such a block is part of it, and text outside
    blocks is none."""
    out: list[tuple[str, str]] = []
    todo: list = [*reversed(root.children)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.name in BLOCKS and _own_text(x):
            if text := text_of(x):
                out.append((x.name, text))
        else:
            todo += reversed(x.children)
    return out


def first_element(root: Element, *names: str) -> Element | None:
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.name in names:
            return x
        todo += reversed(x.children)
    return None


def head_title(root: Element) -> str | None:
    head = first_element(root, "head")
    title = first_element(head, "title") if head else None
    return (text_of(title) or None) if title else None


def read_chapter(source: str) -> tuple[list[str], str | None, str | None]:
    """(paragraphs, first h1 or h2, title of the head)."""
    root = tree(source)
    found = paragraphs(root)
    return [t for _, t in found], next((t for name, t in found if name in ("h1", "h2")), None), head_title(root)


#: Bytes of pages that a task reads into Python at once.
AT_ONCE = 1 << 20
_FOUND = [T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("heading", T.StringType()), T.StructField("head_title", T.StringType())]


def parsed_pages(pages: DataFrame, html: str = "html", kept: list[str] | None = None) -> DataFrame:
    """``pages`` (of their columns ``kept``, or all) with ``paragraphs``, ``heading`` and ``head_title``. A task holds the trees of one
    page and the paragraphs of some, however many it reads."""
    kept = pages.columns if kept is None else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, AT_ONCE):
            found = [read_chapter(p or "") for p in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.list_(pa.string()), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *new], [*kept, *(f.name for f in _FOUND)])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in kept), *_FOUND]))


def page_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each paragraph: ``key``, ``block_idx``, ``char_start``, ``char_end`` (two characters part paragraphs), ``text``."""
    rows = parsed_pages(pages.select(key, html), html, [key]).select(key, F.posexplode("paragraphs").alias("block_idx", "text"))
    w = W.partitionBy(key).orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("bigint")
    return rows.select(key, F.col("block_idx").cast("bigint").alias("block_idx"), start.alias("char_start"), (start + F.length("text")).cast("bigint").alias("char_end"), "text")


def page_titles(pages: DataFrame, key: str = "page_id", html: str = "html", path: str = "url") -> DataFrame:
    """The title of each page: its first heading, its head's title, or its path."""
    return parsed_pages(pages.select(key, html, path), html, [key, path]).select(key, F.coalesce("heading", "head_title", path).alias("title"))
