"""Finding and hashing files, and covers."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_book_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(epub|pdf)$")


def format_of(path: Column) -> Column:
    """``epub`` or ``pdf``; others are an error."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending.isin("epub", "pdf"), ending).otherwise(F.raise_error(F.concat(path, F.lit(" isn't an EPUB or PDF"))))


@dataclass
class Scan:
    paths: list[str] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)


def find_books(folder: str) -> Scan:
    """The books under a folder of this machine, folder by folder, each sorted by the bytes of its names. Links are
    followed, a file that is reached twice is listed once, hidden entries are left out, and a loop ends where it closes."""
    out = Scan()
    seen: set[str] = set()

    def walk(path: str) -> None:
        real = os.path.realpath(path)
        if real in seen:
            return
        seen.add(real)
        try:
            entries = sorted(os.scandir(path), key=lambda e: os.fsencode(e.name))
        except OSError:
            out.unreadable.append(path)
            return
        for e in entries:
            if e.name.startswith("."):
                continue
            try:
                if e.is_dir():
                    walk(e.path)
                elif e.is_file() and e.name.lower().endswith((".epub", ".pdf")):
                    own = os.path.realpath(e.path)
                    if own not in seen:
                        seen.add(own)
                        out.paths.append(e.path)
                elif e.is_symlink() and not os.path.exists(e.path):
                    out.unreadable.append(e.path)
            except OSError:
                out.unreadable.append(e.path)

    walk(folder)
    return out


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(``path``, ``content``, ``file_hash``, ``format``) of the books under a folder that Spark reads, whatever store it is in."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.where(is_book_file(F.col("path"))).select("path", "content", F.sha2("content", 256).alias("file_hash"), format_of(F.col("path")).alias("format"))


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: Limits of a cover's file, in bytes, and the key's digits.
COVER_BYTES, COVER_KEY = 20 << 20, 12


def cover_rows(covers: DataFrame) -> DataFrame:
    """``covers`` (``book_id``, ``image``) as they are stored: ``source`` (``none`` without an image, ``unavailable`` if it is no JPEG or
    PNG, or too large), ``thumb`` and ``key`` (both or neither)."""
    head = F.hex(F.substring("image", 1, 8))
    known = head.startswith("FFD8FF") | (head == "89504E470D0A1A0A")
    ok = known & (F.length("image") <= COVER_BYTES)
    source = F.when(F.col("image").isNull(), "none").when(ok, "image").otherwise("unavailable")
    thumb = F.when(ok, F.col("image"))
    return covers.select("book_id", source.alias("source"), thumb.alias("thumb"), F.when(ok, F.substring(F.sha2("image", 256), 1, COVER_KEY)).alias("key"))


def books_without_cover(books: DataFrame, covers: DataFrame) -> DataFrame:
    return books.join(covers.select("book_id"), "book_id", "left_anti").orderBy("book_id")


def parse_spellings(spark: SparkSession, path: str) -> list[list[str]]:
    """Groups of a spellings file: a line each, commas between terms, comments after #."""
    from lexforge.plans.query import Spellings

    return Spellings("\n".join(r["value"] for r in spark.read.text(path).collect())).groups
