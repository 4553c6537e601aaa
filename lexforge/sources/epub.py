"""EPUB files: container, package, spine, table of contents, chapters and cover."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .markup import Element, first_element, paragraphs, read_chapter, text_of, tree

CHAPTER_SCHEMA = "file_hash string, path string, title string, author string, spine_pos bigint, chapter_title string, href string, paragraphs array<string>, error string"


class NotABook(ValueError):
    """A file that cannot be read as a book, with what is wrong."""


def resolve(base: str, href: str) -> str:
    """A reference from a file of the archive, as a path in it: no fragment, escapes decoded, dots resolved."""
    path = unquote(href.partition("#")[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)).lstrip("/") if path else base


def elements(root: Element, name: str) -> Iterator[Element]:
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.name == name:
            yield x
        todo += reversed(x.children)


@dataclass
class Package:
    path: str
    title: str | None
    author: str | None
    manifest: dict[str, tuple[str, str, str]]  # path, media type, properties
    spine: list[str]
    toc: str | None
    cover: str | None


def package_path(container: str) -> str:
    for e in elements(tree(container), "rootfile"):
        if path := e.attributes.get("full-path"):
            return path
    raise NotABook("the container names no package")


def read_package(path: str, source: str) -> Package:
    root = tree(source)
    first_text = lambda name: next((t for e in elements(root, name) if (t := text_of(e))), None)
    manifest = {e.attributes.get("id", ""): (resolve(path, e.attributes.get("href", "")), e.attributes.get("media-type", ""), e.attributes.get("properties", "")) for e in elements(root, "item")}
    spine = next(elements(root, "spine"), None)
    order = [e.attributes.get("idref", "") for e in elements(spine, "itemref")] if spine else []
    cover = next((i for i, (_, _, p) in manifest.items() if "cover-image" in p.split()), None)
    if cover is None:
        cover = next((e.attributes.get("content") for e in elements(root, "meta") if e.attributes.get("name") == "cover"), None)
    return Package(path, first_text("title"), first_text("creator"), manifest, order, spine.attributes.get("toc") if spine else None, cover)


def nav_titles(path: str, source: str) -> dict[str, str]:
    """Labels of the table of contents (``toc`` alone, of the navigations of a page), the first of each file."""
    out: dict[str, str] = {}
    for nav in elements(tree(source), "nav"):
        if "toc" in nav.attributes.get("epub:type", nav.attributes.get("type", "")).split():
            for a in elements(nav, "a"):
                label = text_of(a)
                if label and a.attributes.get("href"):
                    out.setdefault(resolve(path, a.attributes["href"]), label)
            break
    return out


def ncx_titles(path: str, source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for point in elements(tree(source), "navpoint"):
        label = first_element(point, "navlabel")
        content = next((c for c in elements(point, "content")), None)
        if label and content and (text := text_of(label)) and content.attributes.get("src"):
            out.setdefault(resolve(path, content.attributes["src"]), text)
    return out


class Book:
    """An EPUB file's parts, read from its bytes."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            container = self.text("META-INF/container.xml")
        except (zipfile.BadZipFile, KeyError) as e:
            raise NotABook("not an EPUB file") from e
        path = package_path(container or "")
        source = self.text(path)
        if source is None:
            raise NotABook("the package is missing")
        self.package = read_package(path, source)

    def text(self, path: str) -> str | None:
        try:
            raw = self.zip.read(path)
        except KeyError:
            return None
        return raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")

    def toc(self) -> dict[str, str]:
        """Labels by file, of the navigation page or else of the older index; none if neither can be read."""
        p = self.package
        for path, _, properties in p.manifest.values():
            if "nav" in properties.split() and (source := self.text(path)) is not None:
                if found := nav_titles(path, source):
                    return found
        item = p.manifest.get(p.toc or "") or next((m for m in p.manifest.values() if m[1] == "application/x-dtbncx+xml"), None)
        source = self.text(item[0]) if item else None
        return ncx_titles(item[0], source) if source is not None else {}

    def chapters(self) -> Iterator[tuple[int, str, str, list[str]]]:
        """(place in the spine, path, title, paragraphs); navigation pages, missing files and pages without text are left out."""
        labels = self.toc()
        for k, idref in enumerate(self.package.spine):
            item = self.package.manifest.get(idref)
            if item is None or "nav" in item[2].split():
                continue
            source = self.text(item[0])
            if source is None:
                continue
            found, heading, title = read_chapter(source)
            if found:
                yield k, item[0], heading or labels.get(item[0]) or title or item[0], found

    def cover(self) -> bytes | None:
        """The cover that the package names, or the only image of the first page that has at most one paragraph."""
        p = self.package
        path = p.manifest[p.cover][0] if p.cover in p.manifest else None
        if path is None:
            for idref in p.spine:
                item = p.manifest.get(idref)
                if item is None or "nav" in item[2].split():
                    continue
                root = tree(self.text(item[0]) or "")
                images = [e.attributes.get("src") or e.attributes.get("xlink:href") or e.attributes.get("href") for name in ("img", "image") for e in elements(root, name)]
                images = [i for i in images if i]
                if len(paragraphs(root)) <= 1 and len(images) == 1:
                    path = resolve(item[0], images[0])
                break
        try:
            return self.zip.read(path) if path else None
        except KeyError:
            return None


def read_epubs(files: DataFrame) -> DataFrame:
    """Chapters of EPUB files (``path``, ``content``, as ``binaryFile`` reads them). A file that cannot be read is a row with an
    ``error``. A book is opened in one task; its bytes are not moved."""
    source = files.select(F.sha2("content", 256).alias("file_hash"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHAPTER_SCHEMA.split(", ")]
        for part in batches:
            for row in part.itertuples(index=False):
                try:
                    book = Book(bytes(row.content))
                    p = book.package
                    rows = [(row.file_hash, row.path, p.title, p.author, k, title, href, text, None) for k, href, title, text in book.chapters()]
                    if not rows:
                        raise NotABook("the book has no text")
                except NotABook as e:
                    rows = [(row.file_hash, row.path, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(run, CHAPTER_SCHEMA)


def library_rows(chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, chapters, blocks) of parsed chapters, with places from 0 and stored offsets (two characters part paragraphs).
    Files with the same content are one book, at the first path."""
    good = chapters.where("error is null")
    first = good.groupBy("file_hash").agg(F.min("path").alias("path"))
    own = good.join(first, ["file_hash", "path"])
    books = own.groupBy("file_hash", "path").agg(F.first("title").alias("title"), F.first("author").alias("author"), F.count(F.lit(1)).alias("chapter_count"))
    idx = (F.row_number().over(W.partitionBy("file_hash").orderBy("spine_pos")) - 1).cast("bigint")
    placed = own.withColumn("idx", idx)
    lines = placed.select("file_hash", "idx", F.posexplode("paragraphs").alias("block_idx", "text"))
    w = W.partitionBy("file_hash", "idx").orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("bigint")
    blocks = lines.select("file_hash", "idx", "block_idx", start.alias("char_start"), (start + F.length("text")).alias("char_end"), "text")
    return books, placed.select("file_hash", "idx", F.col("chapter_title").alias("title"), "href"), blocks
